"""Structured Streaming: windowed counts, and articles deduplicated within a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import StageTables, shared_dir


def _run(stream: DataFrame, mode: str, spark: SparkSession, schema) -> DataFrame:
    """Runs an available-now query into a table of the shared folder and reads it."""
    keep = StageTables(spark, "stream")
    out, state = f"{keep.root}/out", f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"

    def sink(df: DataFrame, epoch: int) -> None:  # a batch repeated after a failure replaces its own rows
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour_us, event_type, events, total) of the events table read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", "2 hours")
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    g = g.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "events", F.round("total", 4).alias("total"))
    r = _run(g, "complete", spark, g.schema)
    # a complete result stands in the last batch
    last = _last_batch(spark, r)
    return last.select("hour_us", "event_type", "events", "total")


def _last_batch(spark: SparkSession, r: DataFrame) -> DataFrame:
    b = r.select(F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long").alias("b"), *r.columns)
    top = b.agg(F.max("b")).first()[0]
    return b.where(F.col("b") == (top if top is not None else -1)).drop("b")


def first_articles(articles: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of articles with each article_id once, as long as its repeats come within the delay."""
    return articles.where("article_id is not null").withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["article_id"])
