"""Queries of evaluation: one extractor against another, one clustering against another."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import evaluate as ev
from threadloom.plans.tables import M, mentions, read


def _sides(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return m.where("extractor = 'transformer'"), m.where("extractor = 'spacy'")


def label_scores(spark, sf_dir):
    """Labels that two extractors find in the same sentence."""
    g, p = _sides(spark, sf_dir)
    return ev.set_scores(g, p, ["article_id", "sentence_index", "label"], ["label"])


def overall_scores(spark, sf_dir):
    g, p = (x.withColumn("all", F.lit("all")) for x in _sides(spark, sf_dir))
    return ev.set_scores(g, p, ["article_id", "sentence_index", "label", "all"], ["all"])


def relaxed_scores(spark, sf_dir):
    """Overlapping spans of one label, one to one: gold spans shifted by two characters against themselves."""
    g = mentions(spark, sf_dir)
    p = g.withColumns({"start": F.col("start") + 2, "end": F.col("end") + 2})
    r = ev.relaxed_matches(g, p)
    return ev.with_prf(r.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def _clusterings(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    bucket = F.when(F.element_at("embedding", 1) > 0, 2).otherwise(0) + F.when(F.element_at("embedding", 2) > 0, 1).otherwise(0)
    return e.select(F.col("vec_id").alias("item"), F.col("label").alias("cluster")), e.select(F.col("vec_id").alias("item"), bucket.alias("cluster"))


def muc_scores(spark, sf_dir):
    return ev.muc(*_clusterings(spark, sf_dir))


def b_cubed_scores(spark, sf_dir):
    return ev.b_cubed(*_clusterings(spark, sf_dir))


def pairwise_scores(spark, sf_dir):
    return ev.pairwise(*_clusterings(spark, sf_dir))


def windowed_events(spark, sf_dir):
    """Stream of events: counts and sums in tumbling hours, late data up to two hours kept."""
    from threadloom.streaming.events import hourly_counts

    return hourly_counts(spark, sf_dir)


QUERIES = {f.__name__: f for f in (label_scores, overall_scores, relaxed_scores, muc_scores, b_cubed_scores, pairwise_scores, windowed_events)}

_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
_SETS = f"""WITH {M}, g AS (SELECT DISTINCT article_id, sentence_index, label FROM m WHERE extractor = 'transformer'), p AS (SELECT DISTINCT article_id, sentence_index, label FROM m WHERE extractor = 'spacy'),
j AS (SELECT coalesce(g.label, p.label) AS label, g.article_id IS NOT NULL AS ing, p.article_id IS NOT NULL AS inp FROM g FULL JOIN p ON g.article_id = p.article_id AND g.sentence_index = p.sentence_index AND g.label = p.label),
s AS (SELECT {{key}}, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM j GROUP BY 1) SELECT {{name}}, tp, fp, fn, {_PRF} FROM s"""
_CELLS = 'WITH x AS (SELECT label AS g, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS p FROM embeddings), c AS (SELECT g, p, count(*) AS n FROM x GROUP BY 1, 2)'
SQL = {
    "label_scores": _SETS.format(key="label", name="label"),
    "overall_scores": _SETS.format(key="'all' AS all_", name='all_ AS "all"'),
    "muc_scores": _CELLS
    + ", r AS (SELECT sum(n - k) / sum(n - 1) AS recall FROM (SELECT g, sum(n) AS n, count(*) AS k FROM c GROUP BY 1)), q AS (SELECT sum(n - k) / sum(n - 1) AS precision FROM (SELECT p, sum(n) AS n, count(*) AS k FROM c GROUP BY 1)) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r, q",
    "b_cubed_scores": _CELLS
    + ", s AS (SELECT sum(n * n / pn) / sum(n) AS precision, sum(n * n / gn) / sum(n) AS recall FROM c JOIN (SELECT g, sum(n) AS gn FROM c GROUP BY 1) USING (g) JOIN (SELECT p, sum(n) AS pn FROM c GROUP BY 1) USING (p)) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s",
    "pairwise_scores": _CELLS
    + f", s AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM c) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM c GROUP BY p)) AS pp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM c GROUP BY g)) AS gp), t AS (SELECT CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(gp - tp AS BIGINT) AS fn FROM s) SELECT tp, fp AS false_merges, fn AS false_splits, {_PRF} FROM t",
    "windowed_events": "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
