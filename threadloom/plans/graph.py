"""Queries to the graph: lookup, provenance, co-occurrence, edges, audits, table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import lookup, relations, store
from threadloom.plans.spans import _REL, found_relations
from threadloom.plans.tables import EM, M, A, articles, entity_mentions, mentions, read

NAME, KEYWORD, ENTITY, EDGE_ROWS = "Continental Clearing Council", "housing credit", "org_00000000", 25


def find_entity(spark, sf_dir):
    return lookup.find_entity(read(spark, sf_dir, "entities"), read(spark, sf_dir, "entity_aliases"), NAME)


def entity_profiles(spark, sf_dir):
    """Every entity with its aliases."""
    e = read(spark, sf_dir, "entities", "entity_id", "canonical_name", "entity_type", "article_count")
    al = read(spark, sf_dir, "entity_aliases", "entity_id", "alias").groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), " | ").alias("aliases"))
    return e.join(al, "entity_id", "left")


def people_about(spark, sf_dir):
    r = lookup.in_articles_about(articles(spark, sf_dir), entity_mentions(spark, sf_dir), read(spark, sf_dir, "entities"), KEYWORD)
    return r.select("entity_id", "canonical_name", "articles", "mentions")


def co_occurrence(spark, sf_dir):
    """Pairs of entities by the number of articles they share; flagship."""
    return lookup.co_occurring(entity_mentions(spark, sf_dir), read(spark, sf_dir, "entities"))


def co_occurring_with(spark, sf_dir):
    return lookup.co_occurring(entity_mentions(spark, sf_dir), read(spark, sf_dir, "entities"), ENTITY, 10)


def articles_for_entity(spark, sf_dir):
    r = lookup.articles_for_entity(entity_mentions(spark, sf_dir), mentions(spark, sf_dir), articles(spark, sf_dir), ENTITY)
    return r.select("article_id", "title", "source", "mentions", "surfaces")


def _edges(spark, sf_dir):
    return store.build_edges(relations.deduplicate(found_relations(spark, sf_dir)), entity_mentions(spark, sf_dir), articles(spark, sf_dir))


def graph_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)[0]
    return e.select("edge_id", "subject_entity_id", "predicate", "object_key", "object_value", F.round("confidence", 6).alias("confidence"), "support_count")


def edge_evidence(spark, sf_dir):
    e, ev = _edges(spark, sf_dir)
    return ev.join(e.select("edge_id", "predicate"), "edge_id").groupBy("predicate").agg(F.countDistinct("edge_id").alias("edges"), F.count("*").alias("evidence"))


def low_confidence(spark, sf_dir):
    """The least confident relations, as a report."""
    r = lookup.low_confidence_relations(relations.deduplicate(found_relations(spark, sf_dir)), articles(spark, sf_dir), 0.95, EDGE_ROWS)
    return r.select("relation_id", "title", "predicate", "confidence")


def pending_reviews(spark, sf_dir):
    p = read(spark, sf_dir, "scored_pairs", "left_id", "right_id", "score", "decision").distinct()
    return lookup.pending_reviews(p, EDGE_ROWS)


def weakly_supported(spark, sf_dir):
    return lookup.weakly_supported(read(spark, sf_dir, "entities")).select("entity_id", "canonical_name", "merge_confidence", "article_count")


def entity_attributes(spark, sf_dir):
    """Attributes in long form."""
    return store.attributes_long(read(spark, sf_dir, "entities"), "entity_id", {"entity_type": "type", "pipeline_version": "version"})


def by_attribute(spark, sf_dir):
    e = read(spark, sf_dir, "entities")
    a = store.attributes_long(e, "entity_id", {"entity_type": "type", "pipeline_version": "version"})
    return lookup.by_attribute(a, e, "type", "org").select("entity_id", "canonical_name", "article_count")


TABLES = ("articles", "documents", "mentions", "entities", "entity_aliases", "scored_pairs", "fetch_results", "sources")


def table_counts(spark, sf_dir):
    return store.table_counts({t: read(spark, sf_dir, t) for t in TABLES})


def snapshot_upsert(spark, sf_dir):
    """Customers in debt get a new row, the others stay."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    new = c.where("c_acctbal < 0").withColumn("c_name", F.upper("c_name"))
    return store.upsert(c, new, ["c_custkey"])


def orphan_rows(spark, sf_dir):
    """Foreign keys that lead nowhere, by table."""
    a, e = read(spark, sf_dir, "articles", "article_id"), read(spark, sf_dir, "entities", "entity_id")
    parts = [(store.orphans(read(spark, sf_dir, t, k), p, k, k), t) for t, k, p in (("mentions", "article_id", a), ("fetch_results", "article_id", a), ("entity_aliases", "entity_id", e))]
    out = None
    for df, t in parts:
        n = df.agg(F.count("*").alias("orphans")).select(F.lit(t).alias("table_name"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        find_entity, entity_profiles, people_about, co_occurrence, co_occurring_with, articles_for_entity, graph_edges, edge_evidence, low_confidence, pending_reviews, weakly_supported, entity_attributes, by_attribute, table_counts,
        snapshot_upsert, orphan_rows,
    )
}

_EDGES = (
    _REL.rstrip()
    + f""", {EM}, {A},
ed AS (SELECT r.*, s.entity_id AS subject_entity_id, o.entity_id AS object_entity_id, coalesce(o.entity_id, lower(trim(r.object_text))) AS object_key, a.published_at FROM dd r JOIN (SELECT DISTINCT mention_id, entity_id FROM em) s ON s.mention_id = r.subject_id LEFT JOIN (SELECT DISTINCT mention_id, entity_id FROM em) o ON o.mention_id = r.object_id JOIN a ON a.article_id = r.article_id),
ek AS (SELECT *, 'edge_' || substr(sha1(concat_ws('|', subject_entity_id, predicate, object_key)), 1, 12) AS edge_id FROM ed)
"""
)
SQL = {
    "find_entity": f"SELECT DISTINCT entity_id, canonical_name, entity_type, article_count, mention_count FROM entities e LEFT JOIN entity_aliases a USING (entity_id) WHERE lower(canonical_name) = lower('{NAME}') OR lower(alias) = lower('{NAME}') OR a.normalized = lower('{NAME}')",
    "entity_profiles": "SELECT e.entity_id, canonical_name, entity_type, article_count, a.aliases FROM entities e LEFT JOIN (SELECT entity_id, string_agg(alias, ' | ' ORDER BY encode(alias)) AS aliases FROM (SELECT DISTINCT entity_id, alias FROM entity_aliases WHERE alias IS NOT NULL) GROUP BY 1) a USING (entity_id)",
    "people_about": f"WITH {M}, {EM}, {A} SELECT entity_id, canonical_name, count(DISTINCT article_id) AS articles, count(DISTINCT mention_id) AS mentions FROM em JOIN a USING (article_id) JOIN entities USING (entity_id) WHERE (a.title ILIKE '%{KEYWORD}%' OR a.body ILIKE '%{KEYWORD}%') AND entity_type = 'PERSON' GROUP BY 1, 2",
    "co_occurrence": f"WITH {M}, {EM}, ea AS (SELECT DISTINCT entity_id, article_id FROM em) SELECT x.entity_id, y.entity_id AS other_id, count(*) AS shared_articles FROM ea x JOIN ea y USING (article_id) WHERE x.entity_id < y.entity_id GROUP BY 1, 2",
    "co_occurring_with": f"WITH {M}, {EM}, ea AS (SELECT DISTINCT entity_id, article_id FROM em) SELECT entity_id, shared_articles, canonical_name, entity_type FROM (SELECT y.entity_id, count(*) AS shared_articles FROM ea x JOIN ea y USING (article_id) WHERE x.entity_id = '{ENTITY}' AND y.entity_id <> '{ENTITY}' GROUP BY 1) JOIN entities USING (entity_id) ORDER BY shared_articles DESC, encode(canonical_name), entity_id LIMIT 10",
    "articles_for_entity": f"WITH {M}, {EM}, {A} SELECT article_id, title, source, g.mentions, g.surfaces FROM (SELECT article_id, count(*) AS mentions, string_agg(DISTINCT text, ', ' ORDER BY text) AS surfaces FROM (SELECT DISTINCT mention_id, m.article_id, m.text FROM em JOIN m USING (mention_id) WHERE entity_id = '{ENTITY}') GROUP BY 1) g JOIN a USING (article_id)",
    "graph_edges": _EDGES + "SELECT edge_id, subject_entity_id, predicate, object_key, max_by(object_text, (length(object_text), object_text)) AS object_value, round(least(0.99, 1 - product(1 - CAST(confidence AS DOUBLE))), 6) AS confidence, count(DISTINCT relation_id) AS support_count FROM ek GROUP BY 1, 2, 3, 4",
    "edge_evidence": _EDGES + "SELECT predicate, count(DISTINCT edge_id) AS edges, count(*) AS evidence FROM (SELECT DISTINCT edge_id, relation_id, predicate FROM ek) GROUP BY 1",
    "low_confidence": _REL.rstrip() + f", {A} SELECT relation_id, title, predicate, CAST(confidence AS DOUBLE) AS confidence FROM dd JOIN a USING (article_id) WHERE confidence < 0.95 ORDER BY confidence, relation_id LIMIT {EDGE_ROWS}",
    "pending_reviews": f"SELECT left_id, right_id, score, decision FROM (SELECT DISTINCT left_id, right_id, score, decision FROM scored_pairs WHERE decision = 'review') ORDER BY score DESC NULLS LAST, left_id, right_id LIMIT {EDGE_ROWS}",
    "weakly_supported": "SELECT entity_id, canonical_name, merge_confidence, article_count FROM entities WHERE merge_confidence < 0.65 AND article_count > 1",
    "entity_attributes": "SELECT DISTINCT entity_id, 'type' AS attr_type, entity_type AS value FROM entities WHERE entity_type IS NOT NULL UNION SELECT entity_id, 'version', pipeline_version FROM entities WHERE pipeline_version IS NOT NULL",
    "by_attribute": "SELECT entity_id, canonical_name, article_count FROM entities WHERE lower(entity_type) = 'org'",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "snapshot_upsert": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer",
    "orphan_rows": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS orphans FROM {t} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {p})" for t, k, p in (("mentions", "article_id", "articles"), ("fetch_results", "article_id", "articles"), ("entity_aliases", "entity_id", "entities"))),
}
