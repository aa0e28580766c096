"""Token counts by a public tokenizer, and ranks within groups of any size."""

from __future__ import annotations

import functools
import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A vocabulary file of the tokenizers library; every executor must find it there.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ROWS_PER_BUCKET = 200_000


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def with_token_counts(df: DataFrame, id_col: str, text_col: str, others: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """(id, *others, tokens); a null or empty text has 0 tokens, others are strings."""
    d = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in others], F.col(text_col).alias("__text"))

    def count(batches):
        t = tokenizer(path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                n = [len(e.ids) for e in t.encode_batch([x or "" for x in part["__text"]], add_special_tokens=False)]
                yield part.drop(columns="__text").assign(tokens=n)

    schema = ", ".join([f"id {d.schema['id'].dataType.simpleString()}", *[f"`{c}` string" for c in others], "tokens long"])
    return d.mapInPandas(count, schema)


def ranked(df: DataFrame, keys: list[str], order: Column, rows: int, out: str = "rank") -> DataFrame:
    """df with the row's place, from 0, among the rows of its keys in the order of a column of evenly spread longs.

    A group is cut into buckets of neighbouring order values; the buckets' counts give each its first place. So no
    task sorts more than a bucket, though a third of all rows may have the same keys.
    """
    buckets = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    # the upper 31 bits of the order, scaled to the number of buckets, keep the order
    d = df.withColumn("__o", order).withColumn("__b", F.shiftright((F.shiftright(F.col("__o"), 33) + (1 << 30)) * buckets, 31).cast("int"))
    n = d.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    n = n.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), "__first")
    here = Window.partitionBy(*keys, "__b").orderBy("__o", "id")
    d = d.withColumn("__r", F.row_number().over(here) - 1)
    same = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return d.join(n, same).withColumn(out, F.col("__first") + F.col("__r")).select(*df.columns, out)
