"""Measures against a gold standard, as aggregates: no pair of a cluster is ever written out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_prf(df: DataFrame, digits: int = 6) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1; zero where nothing is there to divide by."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = ratio(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return df.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f, digits)})


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Scores of predicted against gold as sets of keys, by some of the keys."""
    g, p = gold.select(*keys).distinct().withColumn("__g", F.lit(1)), predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    j = g.alias("g").join(p.alias("p"), keys, "full_outer")
    s = j.groupBy(*by).agg(F.count_if(F.col("__g").isNotNull() & F.col("__p").isNotNull()).alias("tp"), F.count_if(F.col("__g").isNull()).alias("fp"), F.count_if(F.col("__p").isNull()).alias("fn"))
    return with_prf(s)


def _joint(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(item, g, p): an item that one side lacks is a cluster of its own there."""
    g, p = gold.select("item", F.col("cluster").cast("string").alias("g")), predicted.select("item", F.col("cluster").cast("string").alias("p"))
    j = g.join(p, "item", "full_outer")
    own = F.concat(F.lit("\x00"), F.col("item").cast("string"))
    return j.select("item", F.coalesce("g", own).alias("g"), F.coalesce("p", own).alias("p"))


def muc(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Link-based scores of two clusterings (item, cluster)."""
    cells = _joint(gold, predicted).groupBy("g", "p").agg(F.count("*").alias("n"))
    side = lambda c, a: cells.groupBy(c).agg(F.sum("n").alias("size"), F.count("*").alias("parts")).agg(F.sum(F.col("size") - F.col("parts")).alias(f"{a}_hit"), F.sum(F.col("size") - 1).alias(f"{a}_all")).withColumn("k", F.lit(1))
    j = side("g", "r").join(side("p", "p"), "k")
    j = j.withColumns({"precision": ratio(F.col("p_hit"), F.col("p_all")), "recall": ratio(F.col("r_hit"), F.col("r_all"))})
    return j.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"))


def b_cubed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mention-based scores: from the sizes of the cells, each of whose items scores alike."""
    cells = _joint(gold, predicted).groupBy("g", "p").agg(F.count("*").alias("n"))
    c = cells.join(cells.groupBy("g").agg(F.sum("n").alias("gn")), "g").join(cells.groupBy("p").agg(F.sum("n").alias("pn")), "p")
    s = c.agg(F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("gn")).alias("b"), F.sum("n").alias("n"))
    s = s.withColumns({"precision": ratio(F.col("a"), F.col("n")), "recall": ratio(F.col("b"), F.col("n"))})
    return s.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"))


def pairwise(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores over pairs in one cluster, with the numbers of false merges and splits, from sizes only."""
    cells = gold.select("item", F.col("cluster").cast("string").alias("g")).join(predicted.select("item", F.col("cluster").cast("string").alias("p")), "item").groupBy("g", "p").agg(F.count("*").alias("n"))
    pairs = lambda d: F.sum(F.expr("n * (n - 1) div 2")).alias(d)
    both = cells.agg(pairs("tp")).withColumn("k", F.lit(1))
    g = cells.groupBy("g").agg(F.sum("n").alias("n")).agg(pairs("g_pairs")).withColumn("k", F.lit(1))
    p = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(pairs("p_pairs")).withColumn("k", F.lit(1))
    j = both.join(g, "k").join(p, "k").select("tp", (F.col("p_pairs") - F.col("tp")).alias("fp"), (F.col("g_pairs") - F.col("tp")).alias("fn"))
    return with_prf(j).withColumnRenamed("fp", "false_merges").withColumnRenamed("fn", "false_splits")


@F.pandas_udf(T.LongType())
def _one_to_one(gold: pd.Series, predicted: pd.Series) -> pd.Series:
    """How many predicted spans, in the order of the text, take a gold span of their own that they overlap."""
    out = []
    for g, p in zip(gold, predicted):
        left = [(x["start"], x["end"]) for x in (g if g is not None else [])]
        tp = 0
        for x in p if p is not None else []:
            k = next((k for k, (a, b) in enumerate(left) if x["start"] < b and a < x["end"]), None)
            if k is not None:
                left.pop(k)
                tp += 1
        out.append(tp)
    return pd.Series(out, dtype="int64")


def relaxed_matches(gold: DataFrame, predicted: DataFrame, doc: str = "article_id") -> DataFrame:
    """(doc, label, tp, fp, fn): spans of one label that overlap, matched one to one in the order of the text.

    The matching is sequential within a document and label, so such a group is one row of sorted spans; it is as
    large as a document, not as the corpus.
    """
    g = gold.select(doc, "label", "start", "end").distinct().withColumn("gold", F.lit(True))
    p = predicted.select(doc, "label", "start", "end").distinct().withColumn("gold", F.lit(False))
    span = F.struct("start", "end")
    s = g.unionByName(p).groupBy(doc, "label").agg(F.sort_array(F.collect_list(F.when(F.col("gold"), span))).alias("g"), F.sort_array(F.collect_list(F.when(~F.col("gold"), span))).alias("p"))
    s = s.withColumn("tp", _one_to_one("g", "p"))
    return s.select(doc, "label", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("g") - F.col("tp")).alias("fn"))


def canonical_arguments(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations with subject and object under their entity's name, dots and case aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("."), F.lit("")), r"\s+", " "))
    a = aliases.select(plain(F.col("alias")).alias("__a"), F.col("entity").alias("__e")).dropDuplicates(["__a"])
    for c in ("subject", "object"):
        relations = relations.withColumn("__k", plain(F.col(c))).join(a, F.col("__k") == F.col("__a"), "left").withColumn(c, F.coalesce("__e", "__k")).drop("__k", "__a", "__e")
    return relations


def gold_spans(gold: DataFrame, documents: DataFrame, sentences: DataFrame, doc: str = "article_id", text: str = "text") -> DataFrame:
    """gold (doc, sent, text, ...) with start and end: the first place of the text in its sentence, null if it is not there."""
    s = sentences.select(F.col(doc).alias("__sd"), F.col("idx").alias("__i"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    d = documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t"))
    j = gold.join(s, (F.col(doc) == F.col("__sd")) & (F.col("sent") == F.col("__i")), "left").join(d, F.col(doc) == F.col("__d"), "left")
    at = F.instr(F.substring("__t", F.col("__s") + 1, F.col("__e") - F.col("__s")), F.col("text"))
    start = F.when(at > 0, F.col("__s") + at - 1)
    j = j.withColumn("__at", start)
    return j.withColumns({"start": F.col("__at").cast("int"), "end": (F.col("__at") + F.length("text")).cast("int")}).drop("__sd", "__i", "__s", "__e", "__d", "__t", "__at")


def unresolved_gold(spans: DataFrame) -> DataFrame:
    return spans.where("start is null")


def pair_examples(together: DataFrame, apart: DataFrame, n: int = 5) -> DataFrame:
    """(left, right), left < right: the first n pairs that are in one cluster of together (item, cluster) and in different
    ones of apart. With the gold standard as apart they are false merges, the other way round false splits.

    The first n pairs of a cluster lie among the first 2 n items of its first 2 n parts, so no cluster is paired whole.
    """
    j = together.select("item", F.col("cluster").cast("string").alias("t")).join(apart.select("item", F.col("cluster").cast("string").alias("a")), "item", "left")
    j = j.withColumns({"item": F.col("item").cast("string"), "a": F.coalesce("a", F.concat(F.lit("\x00"), F.col("item").cast("string")))})
    j = j.withColumns({"k": F.row_number().over(Window.partitionBy("t", "a").orderBy("item")), "first": F.min("item").over(Window.partitionBy("t", "a"))}).where(F.col("k") <= 2 * n)
    j = j.withColumn("part", F.dense_rank().over(Window.partitionBy("t").orderBy("first"))).where(F.col("part") <= 2 * n)
    o = j.select(F.col("t").alias("t2"), F.col("a").alias("a2"), F.col("item").alias("right"))
    p = j.join(o, (F.col("t") == F.col("t2")) & (F.col("a") != F.col("a2")) & (F.col("item") < F.col("right")))
    return p.select(F.col("item").alias("left"), "right").distinct().orderBy("left", "right").limit(n)
