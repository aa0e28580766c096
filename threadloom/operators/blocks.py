"""Joins that stand hot keys: pairs within blocks, and lookups of one key by very many rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block that meet in one cell at most, on average; a larger block is a grid of cells.
CELL = 2_000


def pairs_within(rows: DataFrame, key: str, by: str, suffix: str = "2", cell: int = CELL, once: Callable[[], Column] | None = None) -> DataFrame:
    """Every ordered pair of different rows of a block: the first row's columns, and the second's with a suffix.

    once gives a further condition on both rows' columns; then only pairs in order of column by are made. They are tested
    where they meet, over more tasks than the few bytes of the blocks would get.

    A block of n rows is cut into ceil(n / cell) slots by the hash of column by, and a pair meets in the one cell of its
    two slots, so no pair is lost or made twice and no task gets more than a cell's rows of a block. Null keys pair nothing.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count("*") / cell).cast("int").alias("__g")).where("__g > 1")
    d = rows.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn("__g", F.coalesce("__g", F.lit(1)))
    d = d.withColumns({"__s": F.pmod(F.xxhash64(by), F.col("__g")).cast("int"), "__o": F.sequence(F.lit(0), F.col("__g") - 1)})
    left = d.select(key, *[F.col(c) for c in rows.columns if c != key], F.col("__s").alias("__r"), F.explode("__o").alias("__c"))
    right = d.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{c}{suffix}") for c in rows.columns if c != key], F.explode("__o").alias("__r2"), F.col("__s").alias("__c2"))
    meet = (F.col(key) == F.col("__k")) & (F.col("__r") == F.col("__r2")) & (F.col("__c") == F.col("__c2"))
    if once is None:
        meet &= F.col(by) != F.col(f"{by}{suffix}")
    else:
        meet &= (F.col(by) < F.col(f"{by}{suffix}")) & once()
        spark = rows.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        left, right = left.repartition(n, key, "__r", "__c"), right.repartition(n, "__k", "__r2", "__c2")
    j = left.join(right, meet)
    return j.drop("__k", "__r", "__c", "__r2", "__c2")


#: Rows of one key that a join leaves together at most, on average.
HOT_ROWS = 500_000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, counts: DataFrame | None = None, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """big joined with small on keys, where one key may hold a large part of big's rows.

    The rows of a key with more than hot_rows are spread by the hash of column by over as many parts as needed, and
    small's rows of that key are repeated for each. counts (keys, n) gives big's rows by key if they are known already.
    The list of hot keys is broadcast: there are at most big's rows / hot_rows of them.
    """
    n = counts if counts is not None else big.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = n.where(F.col("n") > hot_rows).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.ceil(F.col("n") / hot_rows).cast("int").alias("__g"))

    def parts(df: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)]
        return df.join(F.broadcast(hot), on, "left").withColumn("__g", F.coalesce("__g", F.lit(1))).drop(*[f"__h{i}" for i in range(len(keys))])

    left = parts(big).withColumn("__s", F.pmod(F.xxhash64(by), F.col("__g")).cast("int")).drop("__g")
    right = parts(small).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__g") - 1))).drop("__g")
    return left.join(right, [*keys, "__s"], how).drop("__s")
