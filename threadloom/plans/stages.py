"""Queries of the steps between the stages: arguments, checks, stored tables, lists for a reader."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import lexicons as lx
from threadloom.functions import names as nm
from threadloom.operators import arguments, coref, evaluate, lookup, relations, resolution, segment, spans, store
from threadloom.plans.corpus import _SENT, _scan_sql
from threadloom.plans.evaluation import _clusterings
from threadloom.plans.graph import _EDGES, _edges
from threadloom.plans.resolution import _PROF, _plain_sql, _profiles
from threadloom.plans.spans import _COREF, _REL, found_relations, role_holders
from threadloom.plans.tables import EM, M, entity_mentions, mentions, read


def _role_members(spark, sf_dir):
    """Clusters of a person and the roles that follow it in its sentence, the person as representative."""
    m = mentions(spark, sf_dir).select("mention_id", "article_id", "start", "end", "text")
    h = role_holders(spark, sf_dir)
    roles = m.join(h, "mention_id").select("article_id", F.col("holder").alias("cluster_id"), "start", "end", "text", F.lit("NOMINAL").alias("form"), F.lit(False).alias("is_representative"), "mention_id")
    people = m.join(h.select(F.col("holder").alias("mention_id")).distinct(), "mention_id")
    return roles.unionByName(people.select("article_id", F.col("mention_id").alias("cluster_id"), "start", "end", "text", F.lit("NAMED").alias("form"), F.lit(True).alias("is_representative"), "mention_id"))


def resolved_arguments(spark, sf_dir):
    """Whom each person and role of the mentions stands for: a role means the person before it in its sentence."""
    m = mentions(spark, sf_dir)
    s = m.where("label in ('PERSON', 'ROLE')").select(F.col("mention_id").alias("key"), "article_id", "start", "end", "text")
    return arguments.resolve_arguments(s, m, _role_members(spark, sf_dir), "key")


def coref_role_relations(spark, sf_dir):
    r = relations.coref_role_relations(mentions(spark, sf_dir), _role_members(spark, sf_dir))
    return r.select("relation_id", "subject_id", "object_id", "confidence")


def aligned_members(spark, sf_dir):
    """The mention that each span is linked to, if mentions were a character narrower at either end."""
    m = mentions(spark, sf_dir)
    mine = m.select("article_id", "start", "end", F.col("mention_id").alias("span_id"))
    inner = m.withColumns({"start": F.col("start") + 1, "end": F.col("end") - 1}).where("start < end")
    return coref.align_to_mentions(mine, inner, "article_id", ["span_id"])


def best_overlaps(spark, sf_dir):
    """For each mention the span that overlaps it most, if all spans were moved by three characters."""
    m = mentions(spark, sf_dir)
    o = m.withColumns({"start": F.col("start") + 3, "end": F.col("end") + 3})
    b = spans.best_overlap(m.select("mention_id", "article_id", "start", "end"), o, "article_id", ["mention_id"])
    return b.select("mention_id", F.col("start2").alias("start_at"), F.col("overlap").cast("long").alias("overlap"))


def coref_stats(spark, sf_dir):
    return coref.cluster_stats(coref.rule_clusters(mentions(spark, sf_dir)))


def relation_problems(spark, sf_dir):
    """What is wrong with the relations if the mentions of roles were lost."""
    r, m = found_relations(spark, sf_dir), mentions(spark, sf_dir).where("label <> 'ROLE'")
    return relations.relation_problems(r, m).groupBy("problem").agg(F.count("*").alias("relations"))


def pronoun_links(spark, sf_dir):
    """Pronouns of the documents and the role title before them that they may stand for: whoever is meant by he or she,
    and the office, as if it were an organisation, by the others."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumnRenamed("doc_id", "article_id")
    s = segment.sentences(d, "article_id", "text").withColumnRenamed("id", "article_id")
    m = segment.scan(d, "article_id", "text", segment.alternation(lx.ROLES), True).withColumnRenamed("id", "article_id")
    m = spans.covering_sentence(m, s, "article_id", "start").withColumns({"label": F.explode(F.array(F.lit("PERSON"), F.lit("ORG"))), "mention_id": F.format_string("%d:%d", "article_id", "start")})
    p = coref.pronoun_spans(d, m, s, "article_id", "text")
    roots = m.select(F.col("mention_id").alias("id"), F.col("mention_id").alias("root")).distinct()
    l = coref.pronoun_links(p, m, roots)
    return l.select(F.col("article_id").alias("doc_id"), F.col("start").cast("long").alias("start_at"), F.lower("text").alias("pronoun"), "antecedent")


def sentence_problems(spark, sf_dir):
    """Sentences of the documents with their second one taken out and every fifth made empty: what the check says."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    s = segment.sentences(d, "doc_id", "text").withColumnRenamed("id", "doc_id").where("idx <> 1").withColumn("end", F.when(F.col("idx") % 5 == 0, F.col("start")).otherwise(F.col("end")))
    p = spans.sentence_problems(s, d, "doc_id", "text")
    return p.groupBy("problem").agg(F.count("*").alias("sentences"), F.countDistinct("doc_id").alias("documents"))


def drifted_spans(spark, sf_dir):
    """Role titles found in the documents whose offsets were moved by one where they are even: those no longer there."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    m = segment.scan(d, "doc_id", "text", segment.alternation(lx.ROLES), True).withColumnRenamed("id", "doc_id")
    moved = F.when(F.col("start") % 2 == 0, 1).otherwise(0)
    m = m.withColumns({"at": F.col("start").cast("long"), "start": F.col("start") + moved, "end": F.col("end") + moved})
    return spans.drifted(m, d, "doc_id", "text").select("doc_id", "at", "text")


def profile_contexts(spark, sf_dir):
    """Context of a profile that stands in the first and third sentence of its document."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    s = segment.sentences(d, "doc_id", "text").withColumnRenamed("id", "doc_id")
    m = s.where("idx in (0, 2)").select("doc_id", F.col("idx").alias("sentence_index"), F.format_string("%d:%d", "doc_id", "idx").alias("mention_id"))
    p = m.groupBy(F.col("doc_id").cast("string").alias("profile_id")).agg(F.collect_set("mention_id").alias("mention_ids"))
    c = resolution.profile_contexts(p, m, s, d, "doc_id")
    return c.select("profile_id", F.length("context").alias("chars"), F.sha1("context").alias("sha1"))


def gold_spans(spark, sf_dir):
    """Where the first 'the' of each document's second sentence stands, null where there is none."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    s = segment.sentences(d, "doc_id", "text").withColumnRenamed("id", "doc_id")
    g = d.select("doc_id").withColumns({"sent": F.lit(1), "text": F.lit("the")})
    return evaluate.gold_spans(g, d, s, "doc_id").select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def false_merges(spark, sf_dir):
    """The first pairs that one clustering puts together and the other keeps apart."""
    gold, predicted = _clusterings(spark, sf_dir)
    return evaluate.pair_examples(predicted, gold)


def entity_aliases_normal(spark, sf_dir):
    """Aliases of the entities in normal form, as the store derives them."""
    e = read(spark, sf_dir, "entities", "entity_id", "entity_type", "merge_confidence")
    al = read(spark, sf_dir, "entity_aliases", "entity_id", "alias").groupBy("entity_id").agg(F.collect_set("alias").alias("surfaces"))
    m = entity_mentions(spark, sf_dir).groupBy("entity_id").agg(F.collect_set("mention_id").alias("mention_ids"))
    t = store.entity_tables(e.join(al, "entity_id").join(m, "entity_id", "left"), {"entity_type": "type"})
    return t["entity_aliases"]


def entity_provenance(spark, sf_dir):
    """Which mentions support each entity, by article and method."""
    e = read(spark, sf_dir, "entities", "entity_id", "entity_type", "merge_confidence").withColumn("surfaces", F.array().cast("array<string>"))
    m = entity_mentions(spark, sf_dir).groupBy("entity_id").agg(F.collect_set("mention_id").alias("mention_ids"))
    t = store.entity_tables(e.join(m, "entity_id"), {"entity_type": "type"})
    return t["entity_mentions"].groupBy("entity_id", "article_id", "method").agg(F.count("*").alias("mentions"), F.round(F.max("confidence"), 6).alias("confidence"))


def numbered_entities(spark, sf_dir):
    """Entities numbered by their articles, most first."""
    e = read(spark, sf_dir, "entities", "entity_id", "canonical_name", "entity_type", "article_count")
    n = resolution.numbered_entities(e.select(F.col("entity_id").alias("root"), F.col("canonical_name").alias("normalized"), "entity_type", F.col("article_count").alias("profiles")))
    return n.select("entity_id", "root")


def _reviews(spark, sf_dir):
    p = read(spark, sf_dir, "scored_pairs", "left_id", "right_id", "score", "reason", "decision").where("decision = 'review' and left_id is not null and right_id is not null")
    return p.groupBy("left_id", "right_id").agg(F.max("score").alias("score"), F.max("reason").alias("reason"))


def review_queue(spark, sf_dir):
    """The queue after a second run: reviews settled after the first keep their status."""
    p = _reviews(spark, sf_dir)
    first = store.upsert_reviews(None, p).withColumn("status", F.when(F.col("score") > 0.45, "merged").otherwise("pending"))
    return store.upsert_reviews(first, p.where("left_id < right_id")).select("review_id", "left_profile", "right_profile", "status")


def review_list(spark, sf_dir):
    """Pairs in review with the names of both sides."""
    p = _profiles(spark, sf_dir).withColumn("roles", F.array().cast("array<string>"))
    return lookup.review_rows(_reviews(spark, sf_dir), p).select("left_id", "right_id", "score", "left_name", "right_name", "left_roles")


def entity_list(spark, sf_dir):
    """The table of entities as a reader sees it."""
    e, al = read(spark, sf_dir, "entities"), read(spark, sf_dir, "entity_aliases", "entity_id", "alias").where("alias is not null")
    a = store.attributes_long(e, "entity_id", {"entity_type": "role", "pipeline_version": "country"})
    return lookup.entity_rows(e, al, a).drop("merge_confidence")


def weak_relations(spark, sf_dir):
    """Relations below 0.8, least confident first; their evidence is in no table, so it is empty."""
    r = relations.deduplicate(found_relations(spark, sf_dir)).withColumns({"evidence_start": F.lit(-1), "evidence_end": F.lit(-1)})
    d = read(spark, sf_dir, "articles", "article_id", "body").dropDuplicates(["article_id"])
    return lookup.low_confidence_list(r, d, 0.8, text="body")


def _busiest(edges):
    """The entity with most edges; one row."""
    r = edges.groupBy("subject_entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject_entity_id").first()
    return r[0] if r else ""


def entity_relations_of(spark, sf_dir):
    """Edges of the entity that has most."""
    e, _ = _edges(spark, sf_dir)
    r = lookup.relations_for_entity(e, read(spark, sf_dir, "entities", "entity_id", "canonical_name"), _busiest(e), "holds_position")
    return r.select("edge_id", "predicate", "object_name", F.round("confidence", 6).alias("confidence"), "support_count")


def entity_graph_of(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    g = lookup.entity_graph(e, read(spark, sf_dir, "entities", "entity_id", "canonical_name"), _busiest(e))
    return g.select("predicate", F.size("objects").alias("objects"), F.array_join(F.array_sort(F.transform("objects", lambda o: o["object_name"])), " | ").alias("names"))


def edge_reports(spark, sf_dir):
    """Evidence of the edge with most reports."""
    e, ev = _edges(spark, sf_dir)
    top = e.orderBy(F.desc("support_count"), "edge_id").first()  # one row
    r = relations.deduplicate(found_relations(spark, sf_dir))
    a = read(spark, sf_dir, "articles", "article_id", "title", "collected_at").where("article_id is not null").groupBy("article_id").agg(F.max("title").alias("title"), F.min("collected_at").alias("published_at"))
    return lookup.relation_evidence(ev, r, a, top["edge_id"] if top else "").select("relation_id", "title", "confidence")


def entity_relations_in_memory(spark, sf_dir):
    """Relations whose subject is a mention of the entity that most relations have as subject."""
    em, r = entity_mentions(spark, sf_dir), found_relations(spark, sf_dir)
    n = em.join(r.select(F.col("subject_id").alias("mention_id")), "mention_id").groupBy("entity_id").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "entity_id").first()  # one row
    return lookup.relations_of_mentions(r, em, top[0] if top else "").select("relation_id", "subject_id", "predicate")


def titles_shown(spark, sf_dir):
    a = read(spark, sf_dir, "articles", "article_id", "title", "body", "collected_at").withColumnRenamed("collected_at", "published_at").distinct()
    return lookup.titles_shown(a).select("article_id", "day", "title", "chars").distinct()


def sentence_texts(spark, sf_dir):
    """Every sentence's surface, as a hash."""
    d = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    s = segment.sentences(d, "doc_id", "text").withColumnRenamed("id", "doc_id").join(d, "doc_id")
    return s.select("doc_id", F.col("idx").cast("long").alias("idx"), F.sha1(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("sha1"))


def neighbours_of_vectors(spark, sf_dir):
    """Searches: for every vector whose id is divisible by 20 its five nearest by cosine among all others.

    The queries are few beside the vectors and go out in blocks; each block's best five are kept before they meet.
    """
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    v = e.select("vec_id", unit(F.col("embedding")).alias("v"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(1).alias("k"))
    j = v.withColumn("k", F.lit(1)).join(q, "k").where("vec_id <> query_id").select("query_id", "vec_id", F.round(nm.cosine(F.col("q"), F.col("v")), 9).alias("likeness"))
    w = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "vec_id")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        resolved_arguments, coref_role_relations, aligned_members, best_overlaps, coref_stats, relation_problems, pronoun_links, sentence_problems, drifted_spans, profile_contexts, gold_spans, false_merges, entity_aliases_normal,
        entity_provenance, numbered_entities, review_queue, review_list, entity_list, weak_relations, entity_relations_of, entity_graph_of, edge_reports, entity_relations_in_memory, titles_shown, sentence_texts, neighbours_of_vectors,
    )
}

_HOLD = f"""
WITH {M}, h0 AS (SELECT *, last_value(CASE WHEN label = 'PERSON' THEN mention_id END IGNORE NULLS) OVER (PARTITION BY article_id, sentence_index ORDER BY "start", "end", mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM m),
h AS (SELECT * FROM h0 WHERE label = 'ROLE' AND holder IS NOT NULL),
c AS (SELECT article_id, holder AS cluster_id, "start", "end", 'NOMINAL' AS form FROM h UNION ALL SELECT m.article_id, m.mention_id, m."start", m."end", 'NAMED' FROM m WHERE mention_id IN (SELECT holder FROM h))
"""
_ROLE = segment.alternation(lx.ROLES).replace("\\ ", " ")
_PRON = segment.alternation([*lx.MASCULINE, *lx.FEMININE, *lx.NEUTER, *lx.PLURAL])
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_EDGE1 = _EDGES.rstrip() + """,
e1 AS (SELECT edge_id, subject_entity_id, predicate, object_key, max(object_entity_id) AS object_entity_id, max_by(object_text, (length(object_text), object_text)) AS object_value, least(0.99, 1 - product(1 - CAST(confidence AS DOUBLE))) AS confidence, count(DISTINCT relation_id) AS support_count FROM ek GROUP BY 1, 2, 3, 4),
top AS (SELECT subject_entity_id FROM e1 GROUP BY 1 ORDER BY count(*) DESC, subject_entity_id LIMIT 1),
n1 AS (SELECT e1.*, coalesce(n.canonical_name, object_value) AS object_name FROM e1 JOIN top USING (subject_entity_id) LEFT JOIN entities n ON n.entity_id = e1.object_entity_id)
"""
SQL = {
    "resolved_arguments": _HOLD.rstrip() + """,
s AS (SELECT * FROM m WHERE label IN ('PERSON', 'ROLE')),
o AS (SELECT s.mention_id AS key, arg_min(c.cluster_id, (c."end" - c."start", c.cluster_id, c."start")) AS cluster_id, arg_min(c.form, (c."end" - c."start", c.cluster_id, c."start")) AS form FROM s JOIN c ON s.article_id = c.article_id AND c."start" <= s."start" AND s."end" <= c."end" GROUP BY 1),
p AS (SELECT r.mention_id AS cluster_id, i.mention_id FROM m r JOIN m i ON i.article_id = r.article_id AND i.label = 'PERSON' AND r."start" <= i."start" AND i."end" <= r."end" WHERE r.mention_id IN (SELECT holder FROM h)),
f AS (SELECT cluster_id, mention_id FROM p WHERE cluster_id IN (SELECT cluster_id FROM p GROUP BY 1 HAVING count(DISTINCT mention_id) > 1) UNION SELECT holder, holder FROM h WHERE holder NOT IN (SELECT cluster_id FROM p GROUP BY 1 HAVING count(DISTINCT mention_id) > 1)),
v AS (SELECT DISTINCT key, f.mention_id, true AS via_coref FROM o JOIN f USING (cluster_id) WHERE form = 'NOMINAL'),
a AS (SELECT s.mention_id AS key, arg_min(x.mention_id, (-(least(s."end", x."end") - greatest(s."start", x."start")), x."start", x."end", x.mention_id)) AS mention_id FROM s JOIN m x ON x.article_id = s.article_id AND x."start" < s."end" AND s."start" < x."end" WHERE s.mention_id NOT IN (SELECT key FROM v) GROUP BY 1)
SELECT key, mention_id, via_coref FROM v UNION ALL SELECT key, mention_id, false FROM a""",
    "coref_role_relations": _HOLD + f"""SELECT 'rel_' || substr(sha1(concat_ws('|', article_id, holder, 'holds_position', mention_id)), 1, 12) AS relation_id, holder AS subject_id, mention_id AS object_id, CAST({lx.APPOSITIVE} AS DOUBLE) AS confidence FROM h""",
    "aligned_members": f"""WITH {M}, i AS (SELECT * REPLACE ("start" + 1 AS "start", "end" - 1 AS "end") FROM m WHERE "start" + 1 < "end" - 1), j AS (SELECT r.mention_id AS span_id, x.mention_id AS ner_mention_id, list_position([{_list(lx.LINK_ORDER)}], x.label) AS o, CASE WHEN x."end" = r."end" THEN 0 ELSE 1 END AS t, greatest(r."start", x."start") - least(r."end", x."end") AS v, x."start" AS s
  FROM m r JOIN i x ON r.article_id = x.article_id AND ((r."start" <= x."start" AND x."end" <= r."end") OR (x."start" <= r."start" AND r."end" <= x."end")))
SELECT span_id, arg_min(ner_mention_id, (o, t, v, s, ner_mention_id)) AS ner_mention_id FROM j GROUP BY 1""",
    "best_overlaps": f"""WITH {M}, i AS (SELECT * REPLACE ("start" + 3 AS "start", "end" + 3 AS "end") FROM m), j AS (SELECT g.mention_id, o."start" AS start_at, least(g."end", o."end") - greatest(g."start", o."start") AS overlap, o."end" AS e FROM m g JOIN i o ON g.article_id = o.article_id AND g."start" < o."end" AND o."start" < g."end")
SELECT mention_id, start_at, CAST(overlap AS BIGINT) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY overlap DESC, start_at, e) AS k FROM j) WHERE k = 1""",
    "coref_stats": _COREF + "SELECT count(DISTINCT root) AS clusters, count(*) AS members, count(*) FILTER (form = 'NAMED') AS named, count(*) FILTER (form = 'NOMINAL') AS nominal, count(*) FILTER (form = 'PRONOMINAL') AS pronouns_resolved, count(mention_id) AS linked FROM s WHERE n > 1",
    "relation_problems": _REL + ", k AS (SELECT mention_id FROM m WHERE label <> 'ROLE') SELECT problem, count(*) AS relations FROM (SELECT 'subject is no mention' AS problem FROM rr WHERE subject_id NOT IN (SELECT mention_id FROM k) UNION ALL SELECT 'object is no mention' FROM rr WHERE object_id NOT IN (SELECT mention_id FROM k)) GROUP BY 1",
    "pronoun_links": _SENT.rstrip() + f""",
roles AS ({_scan_sql(_ROLE, "PERSON")}), pr AS ({_scan_sql(_PRON, "P")}),
rs AS (SELECT r.*, coalesce(s.idx, -1) AS si FROM roles r LEFT JOIN sents s ON s.doc_id = r.doc_id AND s.start_at <= r.start_at AND r.start_at < s.end_at),
ps AS (SELECT p.*, coalesce(s.idx, -1) AS si, CASE WHEN lower(p.text) IN ({_list(lx.MASCULINE)}) THEN 'M' WHEN lower(p.text) IN ({_list(lx.FEMININE)}) THEN 'F' END AS g FROM pr p LEFT JOIN sents s ON s.doc_id = p.doc_id AND s.start_at <= p.start_at AND p.start_at < s.end_at
  WHERE NOT EXISTS (SELECT 1 FROM roles r WHERE r.doc_id = p.doc_id AND r.start_at <= p.start_at AND p.end_at <= r.end_at)),
pj AS (SELECT p.doc_id, p.start_at, p.end_at, p.text, p.g, arg_max(r.start_at, (r.start_at, r.end_at)) AS held FROM ps p JOIN rs r ON p.doc_id = r.doc_id AND r.end_at <= p.start_at AND p.si - r.si BETWEEN 0 AND 2 GROUP BY 1, 2, 3, 4, 5),
pw AS (SELECT *, first_value(g IGNORE NULLS) OVER (PARTITION BY doc_id, held ORDER BY start_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fg FROM pj)
SELECT doc_id, start_at, lower(text) AS pronoun, doc_id || ':' || held AS antecedent FROM pw WHERE g IS NULL OR g = fg""",
    "sentence_problems": _SENT.rstrip() + """,
k AS (SELECT doc_id, idx, start_at, CASE WHEN idx % 5 = 0 THEN start_at ELSE end_at END AS end_at FROM sents WHERE idx <> 1),
l AS (SELECT *, lag(end_at) OVER w AS pe, lag(idx) OVER w AS pi FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
z AS (SELECT doc_id, 'empty' AS problem FROM l WHERE start_at >= end_at UNION ALL SELECT doc_id, 'overlaps the one before' FROM l WHERE pe > start_at UNION ALL SELECT doc_id, 'out of sequence' FROM l WHERE idx <> coalesce(pi + 1, 0))
SELECT problem, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM z GROUP BY 1""",
    "drifted_spans": f"WITH r AS ({_scan_sql(_ROLE, 'ROLE')}) SELECT doc_id, start_at AS at, text FROM r WHERE start_at % 2 = 0",
    "profile_contexts": _SENT + f"SELECT CAST(doc_id AS VARCHAR) AS profile_id, CAST(length(c) AS INTEGER) AS chars, sha1(c) AS sha1 FROM (SELECT doc_id, left(string_agg(substr(text, start_at + 1, end_at - start_at), ' ' ORDER BY idx), {lx.CONTEXT}) AS c FROM sents JOIN documents USING (doc_id) WHERE idx IN (0, 2) GROUP BY 1)",
    "gold_spans": _SENT + """SELECT d.doc_id, CASE WHEN p > 0 THEN s.start_at + p - 1 END AS start_at, CASE WHEN p > 0 THEN s.start_at + p + 2 END AS end_at FROM documents d LEFT JOIN (SELECT sents.*, strpos(substr(text, start_at + 1, end_at - start_at), 'the') AS p FROM sents JOIN documents USING (doc_id) WHERE idx = 1) s USING (doc_id) WHERE d.text IS NOT NULL""",
    "false_merges": """WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS item, label AS g, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS p FROM embeddings)
SELECT a.item AS "left", b.item AS "right" FROM x a JOIN x b ON a.p = b.p AND a.g <> b.g AND a.item < b.item ORDER BY 1, 2 LIMIT 5""",
    "entity_aliases_normal": f"WITH x AS (SELECT DISTINCT entity_id, alias, entity_type FROM entity_aliases JOIN entities USING (entity_id) WHERE alias IS NOT NULL) SELECT entity_id, alias, {_plain_sql('alias', 'entity_type')} AS normalized FROM x",
    "entity_provenance": f"WITH {M}, {EM} SELECT entity_id, split_part(mention_id, ':', 1) AS article_id, 'entity_resolution_v1' AS method, count(*) AS mentions, round(max(merge_confidence), 6) AS confidence FROM (SELECT DISTINCT entity_id, mention_id FROM em) JOIN entities USING (entity_id) GROUP BY 1, 2, 3",
    "numbered_entities": "SELECT entity_type || '_' || lpad(CAST(row_number() OVER (ORDER BY article_count DESC, encode(canonical_name), entity_id) - 1 AS VARCHAR), 5, '0') AS entity_id, entity_id AS root FROM entities",
    "review_queue": """WITH p AS (SELECT left_id, right_id, max(score) AS score FROM scored_pairs WHERE decision = 'review' AND left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY 1, 2)
SELECT 'rev_' || substr(sha1(left_id || right_id), 1, 12) AS review_id, left_id AS left_profile, right_id AS right_profile, CASE WHEN score > 0.45 THEN 'merged' ELSE 'pending' END AS status FROM p""",
    "review_list": _PROF.rstrip() + """, p AS (SELECT left_id, right_id, max(score) AS score FROM scored_pairs WHERE decision = 'review' AND left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY 1, 2)
SELECT left_id, right_id, round(score, 3) AS score, coalesce(l.canonical_surface, left_id) AS left_name, coalesce(r.canonical_surface, right_id) AS right_name, '' AS left_roles FROM p LEFT JOIN pr l ON l.profile_id = left_id LEFT JOIN pr r ON r.profile_id = right_id""",
    "entity_list": "SELECT e.entity_id, canonical_name, entity_type, article_count, coalesce(a.aliases, '') AS aliases, coalesce(entity_type, '') AS roles, coalesce(pipeline_version, '') AS countries FROM entities e LEFT JOIN (SELECT entity_id, string_agg(alias, ', ' ORDER BY encode(alias)) AS aliases FROM (SELECT DISTINCT entity_id, alias FROM entity_aliases WHERE alias IS NOT NULL) GROUP BY 1) a USING (entity_id)",
    "weak_relations": _REL + "SELECT relation_id, round(CAST(confidence AS DOUBLE), 2) AS confidence, subject_text, predicate, object_text, false AS via_coref, '' AS evidence FROM dd WHERE confidence < 0.8",
    "entity_relations_of": _EDGE1 + "SELECT edge_id, predicate, object_name, round(confidence, 6) AS confidence, support_count FROM n1 WHERE predicate = 'holds_position'",
    "entity_graph_of": _EDGE1 + "SELECT predicate, CAST(count(*) AS INTEGER) AS objects, string_agg(object_name, ' | ' ORDER BY encode(object_name)) AS names FROM n1 GROUP BY 1",
    "edge_reports": _EDGE1.rstrip() + ", t AS (SELECT edge_id FROM e1 ORDER BY support_count DESC, edge_id LIMIT 1) SELECT DISTINCT dd.relation_id, a.title, CAST(dd.confidence AS DOUBLE) AS confidence FROM ek JOIN t USING (edge_id) JOIN dd ON dd.relation_id = ek.relation_id JOIN a ON a.article_id = dd.article_id",
    "entity_relations_in_memory": _REL.rstrip() + f", {EM}, t AS (SELECT entity_id FROM em JOIN rr ON rr.subject_id = em.mention_id GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1) SELECT relation_id, subject_id, predicate FROM rr WHERE subject_id IN (SELECT mention_id FROM em JOIN t USING (entity_id))",
    "titles_shown": "SELECT DISTINCT article_id, strftime(collected_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, substr(title, 1, 60) AS title, CAST(length(body) AS INTEGER) AS chars FROM articles",
    "sentence_texts": _SENT + "SELECT doc_id, idx, sha1(substr(text, start_at + 1, end_at - start_at)) AS sha1 FROM sents JOIN documents USING (doc_id)",
    "neighbours_of_vectors": """WITH j AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0, least(1, (list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1) / 2)), 9) AS likeness FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY likeness DESC, vec_id) AS rank FROM j) WHERE rank <= 5""",
}
