"""Problem 9: sources contribute target shares of all tokens, small ones repeated a capped number of times.

Method: subset-sum budget fitting. Texts are counted by source and exact token length. The largest total is taken
at which every source can give its share; a source's budget is then so many full rounds over its texts and a rest
below one round. The rest is fitted by counts: the same part of every length first, then a bounded knapsack over the
counts of what remains, in a window that grows while the budget is missed, so the budget is hit wherever any subset
hits it. Texts are then chosen by a seeded order within each length.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.tokens import TOKENIZER, ranked, with_token_counts
from threadloom.operators.blocks import spread_join
from threadloom.session import StageTables

#: Tokens of the knapsack's first window; it grows only while the budget is missed.
WINDOW = 1 << 16


def bounded_knapsack(counts: dict[int, int], goal: int, above: bool = False) -> dict[int, int]:
    """How many of each length, at most counts, so that their sum is as close below goal as any choice gets, or above."""
    total = sum(s * n for s, n in counts.items())
    if goal <= 0:
        return {}
    if total <= goal:
        return {s: n for s, n in counts.items() if n}
    size = min(total, goal + max(counts)) if above else goal
    reach = np.zeros(size + 1, bool)
    reach[0] = True
    by = np.full(size + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        n = min(counts[length], size // length) if length else 0
        k = 1
        while n > 0:
            k = min(k, n)
            n -= k
            w = k * length
            new = np.zeros_like(reach)
            new[w:] = reach[: size + 1 - w]
            new &= ~reach
            by[new] = len(parts)
            reach |= new
            parts.append((length, k))
            k *= 2
        if reach[goal]:
            break
    at = goal + int(np.flatnonzero(reach[goal:])[0]) if above else int(np.flatnonzero(reach)[-1])
    if reach[goal]:
        at = goal
    out: Counter = Counter()
    while at:
        length, k = parts[by[at]]
        out[length] += k
        at -= length * k
    return dict(out)


def fit(counts: dict[int, int], budget: int, seed: int = 0, window: int = WINDOW) -> dict[int, int]:
    """How many texts of each length, so that the sum comes as near below the budget as any choice of texts does.

    The same part of every length is taken first and the knapsack fills a window that is left; if it misses the budget,
    texts are given back and the window grows fourfold, at last to the whole budget, so the result is exact. Lengths with
    a common divisor are divided by it; above half of all, what to leave out is fitted. Memory is five bytes a token
    of the window.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    g = math.gcd(*counts)
    if g > 1:
        return {s * g: n for s, n in fit({s // g: n for s, n in counts.items()}, budget // g, seed, window).items()}
    above = 2 * budget > total
    goal = total - budget if above else budget
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    best: dict[int, int] = {}
    least = None
    while least != 0:
        share = max(0.0, (goal - window / 2) / total)
        taken = Counter({s: math.floor(n * share) for s, n in counts.items()})
        left = goal - sum(s * n for s, n in taken.items())
        moved = True
        while left > window and moved and share:
            moved = False
            for s in order:
                if left > window and taken[s] < counts[s] and s <= left:
                    taken[s] += 1
                    left -= s
                    moved = True
        more = bounded_knapsack({s: counts[s] - taken[s] for s in counts if taken[s] < counts[s] and (above or s <= left)}, left, above)
        chosen = {s: taken[s] + more.get(s, 0) for s in counts}
        miss = abs(goal - sum(s * n for s, n in chosen.items()))
        if least is None or miss < least:
            best, least = chosen, miss
        if not share:  # the window held the whole budget
            break
        window *= 4
    if above:
        best = {s: counts[s] - best[s] for s in counts}
    return {s: n for s, n in best.items() if n}


def mix_plan(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 0):
    """(total tokens, {source: (full rounds, {length: texts used once more})}).

    total defaults to the largest at which every source with texts reaches its share within max_repeats; sources
    without texts are left out of it. A given total that a source cannot reach leaves it at all it may give.
    """
    sums = {s: sum(k * n for k, n in counts.get(s, {}).items()) for s, _, _ in targets}
    able = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and sums[s]]
    if not able:
        return 0, {}
    if total is None:
        total = math.floor(min(r * sums[s] / w for s, w, r in able))
    out = {}
    for s, w, r in able:
        budget = min(round(w * total), r * sums[s])
        rounds = budget // sums[s]
        out[s] = (rounds, fit(counts[s], budget - rounds * sums[s], seed) if rounds < r else {})
    return total, out


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, uses): the texts of the mix and how often each is used.

    documents: doc_id, text, source; targets: source, target_share, max_repeats (one row for each source of the mix).
    A text delivered under several doc_ids is one text, of the least doc_id in a source with a target. Null and empty texts, null sources and
    sources without a target give nothing. Texts of one length are chosen by a seeded hash of their doc_id.
    """
    keep = StageTables(documents.sparkSession, "mix")
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    goal = [(r["source"], float(r["w"] or 0), int(r["r"] or 0)) for r in t.collect()]  # a parameter table: one row for each source of the mix
    d = documents.select("doc_id", "text", "source").where("doc_id is not null and text is not null and text <> ''").join(t.select("source"), "source", "left_semi")
    # one row for each different text, told by 128 bits of hashes; only ids and hashes are shuffled, then the few repeats go
    h = d.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2"))
    again = h.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = spread_join(h, again.drop("n"), ["h1", "h2"], "doc_id", counts=again).where("doc_id <> first").select("doc_id").distinct()
    n = with_token_counts(d, "doc_id", "text", ("source",), path)
    n = keep.write(n.join(again.withColumnRenamed("doc_id", "id"), "id", "left_anti").dropDuplicates(["id"]), "lengths")
    counts: dict[str, dict[int, int]] = {}
    rows = 0
    for r in n.groupBy("source", "tokens").agg(F.count("*").alias("n")).collect():  # one row for each source of the mix and length
        counts.setdefault(r["source"], {})[r["tokens"]] = r["n"]
        rows += r["n"]
    _, chosen = mix_plan(counts, goal, total, seed)
    more = [(s, k, rounds, extra.get(k, 0)) for s, (rounds, extra) in chosen.items() for k in counts[s] if rounds or extra.get(k, 0)]
    m = documents.sparkSession.createDataFrame(more, "m_source string, m_tokens long, rounds int, extra long")
    x = ranked(n, ["source", "tokens"], F.xxhash64(F.lit(seed), "id"), rows)
    x = x.join(m, (F.col("source") == F.col("m_source")) & (F.col("tokens") == F.col("m_tokens")))
    uses = F.col("rounds") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return x.select(F.col("id").alias("doc_id"), "source", "tokens", uses.cast("int").alias("uses")).where("uses > 0")


def _tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "mix_targets")]


def p9_mix(spark, sf_dir):
    return mixed(*_tables(spark, sf_dir))


def p9_shares(spark, sf_dir):
    """The share each source reached."""
    d, t = _tables(spark, sf_dir)
    m = mixed(d, t).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    m = m.withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy()))  # over one row for each source of the mix
    r = t.join(m, "source", "left")
    return r.select("source", "target_share", "max_repeats", "used_tokens", "texts", "most_uses", F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))


def p9_kept(spark, sf_dir):
    """Whether each source of the mix keeps its repeats, has one row a text, and none but its own texts."""
    d, t = _tables(spark, sf_dir)
    own = d.select("doc_id", F.col("source").alias("own")).distinct()
    m = mixed(d, t).join(own, "doc_id").groupBy("source").agg(F.max("uses").alias("most"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.bool_and(F.col("own") == F.col("source")).alias("own_texts"))
    return t.join(m, "source").select("source", (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("n") == F.col("ids")).alias("one_row_a_text"), "own_texts")


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept}
SQL = {"p9_kept": "SELECT source, TRUE AS repeats_kept, TRUE AS one_row_a_text, TRUE AS own_texts FROM mix_targets"}
