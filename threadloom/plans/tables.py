"""Views of the test tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


def read(spark, sf_dir, name, *cols):
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    t = t.select(*cols) if cols else t
    # a table of one file and row group is one task; texts are worth spreading then, larger tables have splits enough
    if name in ("documents", "articles") and "text" in t.columns + ["text"] * ("body" in t.columns):
        n = spark.sparkContext.defaultParallelism
        return t.repartition(n) if t.rdd.getNumPartitions() < n // 2 else t
    return t


def mentions(spark, sf_dir):
    """The different mentions, with span columns named start and end."""
    m = read(spark, sf_dir, "mentions").drop("model_version").distinct()
    return m.withColumnsRenamed({"start_char": "start", "end_char": "end"})


M = """m AS (SELECT DISTINCT mention_id, article_id, start_char AS "start", end_char AS "end", text, label, raw_label, score, sentence_index, extractor, coref_cluster_id FROM mentions)"""


def articles(spark, sf_dir):
    """Each article once, with the time of its first delivery."""
    a = read(spark, sf_dir, "articles", "article_id", "title", "source", "body", "collected_at").where("article_id is not null")
    return a.groupBy("article_id").agg(F.max("title").alias("title"), F.max("source").alias("source"), F.max("body").alias("body"), F.min("collected_at").alias("published_at"))


A = "a AS (SELECT article_id, max(title) AS title, max(source) AS source, max(body) AS body, min(collected_at) AS published_at FROM articles WHERE article_id IS NOT NULL GROUP BY 1)"


def entity_mentions(spark, sf_dir):
    """Mentions whose text is an alias, with the alias's entities."""
    al = read(spark, sf_dir, "entity_aliases", "entity_id", F.col("alias").alias("text")).distinct()
    return mentions(spark, sf_dir).select("mention_id", "article_id", "text").join(al, "text").select("entity_id", "mention_id", "article_id").distinct()


EM = "em AS (SELECT DISTINCT e.entity_id, m.mention_id, m.article_id FROM m JOIN entity_aliases e ON e.alias = m.text)"
