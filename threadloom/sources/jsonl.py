"""JSON-lines records in and out, a registry of readers, fetched pages, gold annotations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.ingest import stale_documents

ARTICLE = (
    "article_id string, title string, source string, published_at string, body string, url string, language string, collected_at timestamp, extra map<string,string>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, line_no): the lines of text files with their numbers from 1.

    A split's lines are numbered where they are read, and the lines before it in its file are added from one count for
    each split; no text is shuffled. A missing file is an error.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    n = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col("file").alias("__f"), F.col("block").alias("__b"), "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    j = raw.join(n, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    return j.select(F.trim("value").alias("line"), "file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = numbered_lines(spark, path).where("line <> ''")
    r = raw.withColumn("r", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return r.withColumn("good", F.col("line").startswith("{") & F.col("r._bad").isNull())


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """One record for each line that is a JSON object, with its file and line number; blank and broken lines and other
    values are left out (bad_lines() has them). A missing file is an error."""
    return _parsed(spark, path, schema).where("good").select("r.*", "file", "line_no").drop("_bad")


def bad_lines(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    return _parsed(spark, path, schema).where("not good").select("file", "line_no", "line")


def read_documents(spark: SparkSession, path: str, schema: str, text: str = "text", fingerprint: str = "text_sha256") -> DataFrame:
    """Documents written as nested JSON, with stale: the text no longer has the fingerprint it was written with."""
    return stale_documents(spark.read.schema(schema).json(path), text, fingerprint)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".jsonl": read_jsonl, ".ndjson": read_jsonl, ".parquet": lambda s, p: s.read.parquet(p)}


def register_reader(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[extension] = reader


def read_any(spark: SparkSession, path: str) -> DataFrame:
    for ext, reader in READERS.items():
        if path.rstrip("/").endswith(ext):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}; known: {', '.join(READERS)}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested_documents(documents: DataFrame, id_col: str, **children: DataFrame) -> DataFrame:
    """documents with each child table as an array column, for nested JSON."""
    out = documents
    for name, child in children.items():
        cols = [c for c in child.columns if c != id_col]
        out = out.join(child.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name)), id_col, "left")
    return out


def fetch_pages(urls: DataFrame, url_col: str, fetcher: Callable[[str], dict]) -> DataFrame:
    """(url, title, body, published_at, error) by a caller's fetcher; blank and repeated urls are fetched once or not
    at all, and a failure of one is its error only."""
    u = urls.select(F.trim(F.col(url_col)).alias("url")).where("url <> ''").distinct()

    def run(batches):
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    got = fetcher(url)
                    rows.append((url, got.get("title"), got.get("body"), got.get("published_at"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "title", "body", "published_at", "error"], dtype=object)

    return u.mapInPandas(run, "url string, title string, body string, published_at string, error string")


def manual_article(spark: SparkSession, body: str, title: str = "", source: str = "manual", now: Column | None = None) -> DataFrame:
    title = title.strip() or body.strip()[:60]
    d = spark.createDataFrame([(title, source, body)], "title string, source string, body string")
    return d.withColumn("published_at", now if now is not None else F.current_timestamp())


def read_gold(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mentions, clusters, relations, links and aliases of a JSON file of annotations; keys that begin with _ are comments."""
    said = "array<struct<sent:int,text:string,label:string>>"
    article = f"struct<mentions:{said},coref_clusters:array<array<struct<sent:int,text:string>>>,relations:array<struct<subject:string,predicate:string,object:string>>,entity_links:array<struct<text:string,entity:string>>>"
    raw = spark.read.text(path, wholetext=True)
    g = raw.select(F.from_json("value", "entities string, articles string").alias("g")).select(F.from_json("g.entities", "map<string,string>").alias("entities"), F.from_json("g.articles", f"map<string,{article}>").alias("articles"))
    arts = g.select(F.explode("articles").alias("article_id", "a"))
    each = lambda c: arts.select("article_id", F.explode(f"a.{c}").alias("x")).select("article_id", "x.*")
    clusters = arts.select("article_id", F.posexplode("a.coref_clusters").alias("cluster", "c")).select("article_id", "cluster", F.explode("c").alias("x")).select("article_id", "cluster", "x.*")
    names = g.select(F.explode("entities").alias("entity", "v")).where("not startswith(entity, '_')").select("entity", F.explode(F.from_json("v", "array<string>")).alias("alias"))
    return {"mentions": each("mentions"), "clusters": clusters, "relations": each("relations"), "links": each("entity_links"), "aliases": names}


def write_entities(entities: DataFrame, reviews: DataFrame, path: str) -> None:
    """Entities with sorted sets, and the review queue, as JSON lines with rounded scores."""
    sets = [c for c, t in entities.dtypes if t.startswith("array")]
    write_jsonl(entities.withColumns({c: F.sort_array(c) for c in sets} | {"merge_confidence": F.round("merge_confidence", 3)}), f"{path}/entities.jsonl")
    write_jsonl(reviews.select(F.col("left_profile").alias("left"), F.col("right_profile").alias("right"), F.round("score", 3).alias("score"), "explanation"), f"{path}/review_queue.jsonl")
