"""Queries over mentions: merging, forms, as-of joins, adjacency relations, rule-based coreference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom import lexicons as lx
from threadloom.functions import text as tx
from threadloom.operators import coref, relations, spans
from threadloom.operators import mentions as mm
from threadloom.plans.tables import M, mentions, read

NEAR = 80


def merged_mentions(spark, sf_dir):
    m = mm.merge_mentions(mentions(spark, sf_dir))
    return m.select("mention_id", "label", "extractor", F.col("island").cast("long").alias("island"), "is_winner")


def merge_stats(spark, sf_dir):
    return mm.merge_stats(mm.merge_mentions(mentions(spark, sf_dir)))


def label_counts(spark, sf_dir):
    return mentions(spark, sf_dir).groupBy("label", "extractor").agg(F.count("*").alias("mentions"), F.countDistinct("article_id").alias("articles"))


def mapped_labels(spark, sf_dir):
    """Raw labels of two tag sets in the library's own; dropped ones as '(dropped)'."""
    m = mentions(spark, sf_dir)
    lab = F.when(F.col("extractor") == "spacy", tx.map_label(tx.strip_bio(F.col("raw_label")), "spacy")).when(F.col("extractor") == "transformer", tx.map_label(tx.strip_bio(F.col("raw_label")), "transformer")).otherwise(F.col("label"))
    return m.groupBy("extractor", "raw_label", F.coalesce(lab, F.lit("(dropped)")).alias("mapped")).agg(F.count("*").alias("mentions"))


def mention_forms(spark, sf_dir):
    return mentions(spark, sf_dir).where("text is not null").groupBy("label", tx.mention_form(F.col("text")).alias("form")).agg(F.count("*").alias("mentions"))


def role_holders(spark, sf_dir):
    """For each role the nearest person before it in its sentence."""
    w = Window.partitionBy("article_id", "sentence_index").orderBy("start", "end", "mention_id").rowsBetween(Window.unboundedPreceding, -1)
    m = mentions(spark, sf_dir).withColumn("holder", F.last(F.when(F.col("label") == "PERSON", F.col("mention_id")), ignorenulls=True).over(w))
    return m.where("label = 'ROLE' and holder is not null").select("mention_id", "holder")


def nearest_organisation(spark, sf_dir):
    """As-of join: for each country or place the nearest organisation before it, two sentences back at most."""
    m = mentions(spark, sf_dir).select("mention_id", "article_id", "start", "end", "label", "sentence_index")
    p = m.where("label in ('COUNTRY', 'LOCATION')")
    n = spans.nearest_before(p, m.where("label = 'ORG'"), "article_id", ["mention_id"], 2)
    return n.select("mention_id", F.col("near_mention_id").alias("organisation_id"))


def sentence_cover(spark, sf_dir):
    """Range join: the sentence that holds the middle of each document."""
    from threadloom.operators.segment import sentences

    d = read(spark, sf_dir, "documents", "doc_id", "text")
    s = sentences(d, "doc_id", "text").withColumnRenamed("id", "doc_id")
    p = d.where("text is not null").select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("offset"))
    return spans.covering_sentence(p, s, "doc_id", "offset").select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"))


def found_relations(spark, sf_dir):
    """Adjacency relations of the mentions; neighbours in a sentence at most NEAR characters apart count as adjacent, as
    the text between them is not in the tables."""
    m = mentions(spark, sf_dir)
    w = Window.partitionBy("article_id", "sentence_index").orderBy("start", "end", "mention_id")
    return relations.pattern_relations(m, F.when((F.lead("start").over(w) - F.col("end")).between(0, NEAR), "").otherwise("…"))


def pattern_relations(spark, sf_dir):
    return found_relations(spark, sf_dir).select("relation_id", "article_id", "subject_id", "predicate", "object_id", "confidence", "trigger")


def deduplicated_relations(spark, sf_dir):
    return relations.deduplicate(found_relations(spark, sf_dir)).select("relation_id", "predicate", "evidence_count")


def relation_stats(spark, sf_dir):
    return relations.relation_stats(relations.deduplicate(found_relations(spark, sf_dir)))


def coref_clusters(spark, sf_dir):
    c = coref.rule_clusters(mentions(spark, sf_dir))
    return c.select("cluster_id", "mention_id", "is_representative")


def verb_frames(spark, sf_dir):
    """Who does what to whom, over a token table: the lines of an order stand for the words of a sentence."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("i", F.row_number().over(w))
    verbs = F.array(*[F.lit(v) for v in sorted(lx.VERBS)])
    t = l.select(
        F.col("l_orderkey").cast("string").alias("article_id"), "i", F.when(F.col("i") == 1, F.element_at(verbs, (F.col("l_partkey") % len(lx.VERBS) + 1).cast("int"))).otherwise("x").alias("lemma"),
        F.when(F.col("i") == 1, "VERB").otherwise("NOUN").alias("pos"), F.when(F.col("i") == 1, "ROOT").when(F.col("i") == 2, "nsubj").when(F.col("i") == 3, "dobj").otherwise("conj").alias("dep"),
        F.when(F.col("i") <= 3, 1).otherwise(3).alias("head"),
    )
    return relations.dependency_frames(t).groupBy("predicate").agg(F.count("*").alias("frames"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


QUERIES = {
    f.__name__: f
    for f in (merged_mentions, merge_stats, label_counts, mapped_labels, mention_forms, role_holders, nearest_organisation, sentence_cover, pattern_relations, deduplicated_relations, relation_stats, coref_clusters, verb_frames)
}

_TRUST = "CASE " + " ".join(f"WHEN extractor = '{e}' AND label = '{l}' THEN {v}" for e, ls in lx.TRUST.items() for l, v in ls.items()) + f" ELSE {lx.DEFAULT_TRUST} END"
_SPEC = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.SPECIFICITY.items()) + " ELSE 1 END"
_MERGED = f"""
WITH {M}, o AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY article_id ORDER BY "start", "end" DESC, extractor, label, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM m),
i AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY article_id ORDER BY "start", "end" DESC, extractor, label, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island, {_TRUST} AS trust, {_SPEC} AS spec FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY article_id, island ORDER BY trust DESC, spec DESC, "end" - "start" DESC, score DESC, "start", "end" DESC, extractor, label, mention_id) = 1 AS is_winner, count(*) OVER (PARTITION BY article_id, island) > 1 AS contested FROM i)
"""
_MAP = "CASE " + " ".join(f"WHEN extractor = '{e}' AND regexp_replace(raw_label, '^[BIESLU]-', '') = '{k}' THEN {('NULL' if v is None else chr(39) + v + chr(39))}" for e, ls in lx.LABELS.items() for k, v in ls.items()) + " WHEN extractor IN ('spacy', 'transformer') THEN 'MISC' ELSE label END"
_FORM = f"""CASE WHEN lower(trim(text)) IN ({", ".join(f"'{p}'" for p in lx.PRONOUNS)}) THEN 'PRONOMINAL'
  WHEN len(w) = 0 OR lower(w[1]) IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') THEN 'NOMINAL'
  WHEN len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= greatest(1, len(w) - 1) THEN 'NAMED' ELSE 'NOMINAL' END"""
_REL = f"""
WITH {M}, n AS (SELECT *, CASE WHEN lead("start") OVER w - "end" BETWEEN 0 AND {NEAR} THEN true ELSE false END AS near,
  lead(mention_id) OVER w AS n_id, lead(text) OVER w AS n_text, lead(label) OVER w AS n_label,
  lag(mention_id) OVER w AS p_id, lag(raw_label) OVER w AS p_raw FROM m WINDOW w AS (PARTITION BY article_id, sentence_index ORDER BY "start", "end", mention_id)),
n2 AS (SELECT *, lag(near) OVER (PARTITION BY article_id, sentence_index ORDER BY "start", "end", mention_id) AS p_near FROM n),
rel AS (
  SELECT article_id, n_id AS subject_id, n_text AS subject_text, 'holds_position' AS predicate, mention_id AS object_id, text AS object_text, label AS object_label, {lx.ADJACENT} AS confidence, 'role+person' AS trigger FROM n2 WHERE label = 'ROLE' AND n_label = 'PERSON' AND near
  UNION ALL SELECT article_id, n_id, n_text, 'represents', p_id, regexp_extract(p_raw, '^GAZ_DEMONYM:(.*)$', 1), 'COUNTRY', {lx.ADJACENT}, 'demonym+role+person' FROM n2 WHERE label = 'ROLE' AND n_label = 'PERSON' AND near AND p_near AND p_raw LIKE 'GAZ_DEMONYM:_%'
  UNION ALL SELECT article_id, mention_id, text, 'holds_position', n_id, n_text, n_label, {lx.APPOSITIVE}, 'person+role' FROM n2 WHERE label = 'PERSON' AND n_label = 'ROLE' AND near),
rr AS (SELECT *, 'rel_' || substr(sha1(concat_ws('|', article_id, subject_id, predicate, object_id)), 1, 12) AS relation_id FROM rel),
dd AS (SELECT * FROM (SELECT *, count(*) OVER w AS evidence_count, row_number() OVER (PARTITION BY article_id, lower(trim(subject_text)), predicate, lower(trim(object_text)) ORDER BY confidence DESC, relation_id) AS rn FROM rr WINDOW w AS (PARTITION BY article_id, lower(trim(subject_text)), predicate, lower(trim(object_text)))) WHERE rn = 1)
"""
_COREF = f"""
WITH RECURSIVE {M}, l AS (SELECT *, trim(lower(regexp_replace(regexp_replace(trim(text), '^(?i:{"|".join(lx.COREF_HONORIFICS)})\\.?\\s+', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\p{{Z}}\\s]', '', 'g'))) AS norm FROM m WHERE label IN ('PERSON', 'ORG', 'COUNTRY', 'LOCATION', 'EVENT')),
w AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: x <> '') AS t FROM l WHERE norm <> ''),
e AS (SELECT x.mention_id AS a, y.mention_id AS b FROM w x JOIN w y ON x.article_id = y.article_id AND x.label = y.label AND x.mention_id <> y.mention_id
  WHERE x.norm = y.norm OR (x.label = 'PERSON' AND ((list_has_all(x.t, y.t) AND len(list_distinct(x.t)) > len(list_distinct(y.t))) OR (list_has_all(y.t, x.t) AND len(list_distinct(y.t)) > len(list_distinct(x.t)))))),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v),
g AS (SELECT v, min(r) AS root FROM reach GROUP BY 1),
c AS (SELECT m.*, g.root FROM m JOIN g ON g.v = m.mention_id),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, root, "start", "end" ORDER BY mention_id) AS k1 FROM c) WHERE k1 = 1),
f AS (SELECT *, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM u),
h AS (SELECT *, {_FORM} AS form FROM f),
s AS (SELECT *, count(*) OVER (PARTITION BY root) AS n, min("start" * 1000000 + "end") OVER (PARTITION BY root) AS first,
  row_number() OVER (PARTITION BY root ORDER BY CASE form WHEN 'NAMED' THEN 0 WHEN 'NOMINAL' THEN 1 ELSE 2 END, length(text) DESC, "start") AS best FROM h)
"""
from threadloom.plans.corpus import _SENT  # noqa: E402

_VERBS = sorted(lx.VERBS)
_VERB_SQL = f"""
WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_partkey % {len(_VERBS)} + 1 AS v FROM lineitem),
f AS (SELECT l_orderkey, ([{", ".join("'" + lx.VERBS[v] + "'" for v in _VERBS)}])[v] AS predicate FROM t WHERE i = 1),
s AS (SELECT l_orderkey FROM t WHERE i = 2), o AS (SELECT l_orderkey, i FROM t WHERE i >= 3)
SELECT predicate, count(*) AS frames, round(avg({lx.DIRECT}), 6) AS mean_confidence FROM f JOIN s USING (l_orderkey) JOIN o USING (l_orderkey) GROUP BY 1"""

SQL = {
    "verb_frames": _VERB_SQL,
    "merged_mentions": _MERGED + "SELECT mention_id, label, extractor, island, is_winner FROM g",
    "merge_stats": _MERGED + "SELECT extractor, count(*) AS mentions_in, count(*) FILTER (is_winner) AS mentions_out, count(*) FILTER (contested AND is_winner) AS won, count(*) FILTER (contested AND NOT is_winner) AS lost FROM g GROUP BY 1",
    "label_counts": f"WITH {M} SELECT label, extractor, count(*) AS mentions, count(DISTINCT article_id) AS articles FROM m GROUP BY 1, 2",
    "mapped_labels": f"WITH {M} SELECT extractor, raw_label, coalesce({_MAP}, '(dropped)') AS mapped, count(*) AS mentions FROM m GROUP BY 1, 2, 3",
    "mention_forms": f"WITH {M}, f AS (SELECT *, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM m WHERE text IS NOT NULL) SELECT label, {_FORM} AS form, count(*) AS mentions FROM f GROUP BY 1, 2",
    "role_holders": f"""WITH {M}, h AS (SELECT *, last_value(CASE WHEN label = 'PERSON' THEN mention_id END IGNORE NULLS) OVER (PARTITION BY article_id, sentence_index ORDER BY "start", "end", mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM m)
SELECT mention_id, holder FROM h WHERE label = 'ROLE' AND holder IS NOT NULL""",
    "nearest_organisation": f"""WITH {M} SELECT mention_id, organisation_id FROM (SELECT p.mention_id, o.mention_id AS organisation_id, row_number() OVER (PARTITION BY p.mention_id ORDER BY o."start" DESC, o."end" DESC, o.sentence_index DESC) AS k
FROM m p JOIN m o ON p.article_id = o.article_id AND o.label = 'ORG' AND p.label IN ('COUNTRY', 'LOCATION') AND o."end" <= p."start" AND p.sentence_index - o.sentence_index BETWEEN 0 AND 2) WHERE k = 1""",
    "sentence_cover": _SENT + "SELECT d.doc_id, coalesce(s.idx, -1) AS sentence_index FROM documents d LEFT JOIN sents s ON d.doc_id = s.doc_id AND s.start_at <= length(d.text) // 2 AND length(d.text) // 2 < s.end_at WHERE d.text IS NOT NULL",
    "pattern_relations": _REL + "SELECT relation_id, article_id, subject_id, predicate, object_id, CAST(confidence AS DOUBLE) AS confidence, trigger FROM rr",
    "deduplicated_relations": _REL + "SELECT relation_id, predicate, evidence_count FROM dd",
    "relation_stats": _REL + "SELECT predicate, 'patterns' AS extractor, count(*) AS relations, CAST(0 AS BIGINT) AS via_coref FROM dd GROUP BY 1",
    "coref_clusters": _COREF
    + "SELECT article_id || ':coref' || lpad(CAST(dense_rank() OVER (PARTITION BY article_id ORDER BY first, root) - 1 AS VARCHAR), 3, '0') AS cluster_id, mention_id, best = 1 AS is_representative FROM s WHERE n > 1",
}
