"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.timestamps import published_instants, with_instant


def _tables(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/articles.parquet").select("article_id", "source", "published_at")
    return a, spark.read.parquet(f"{sf_dir}/sources.parquet").select("source", "time_zone", "date_order")


def p7_found(spark, sf_dir):
    return published_instants(*_tables(spark, sf_dir))


def p7_unfixed(spark, sf_dir):
    """Values that fix no instant, by source."""
    a, s = _tables(spark, sf_dir)
    t = with_instant(a.join(s, "source", "left"), "published_at", "time_zone", "date_order")
    return t.where("published_us is null").groupBy("source", F.col("published_at").isNull().alias("is_null")).agg(F.countDistinct("article_id").alias("articles"))


QUERIES = {"p7_found": p7_found, "p7_unfixed": p7_unfixed}
SQL: dict[str, str] = {}
