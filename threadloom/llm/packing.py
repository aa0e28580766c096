"""Problem 8: texts of varying length go whole into containers of fixed capacity.

Method: Martello-Toth dominance reduction, then best fit. Only sizes matter for the plan, so it is made on the
counts of texts by size: at most as many numbers as the capacity, whatever the size of the corpus. Sets that
provably dominate every alternative (a text with which nothing else fits; a text with its exact complement; a text
with the largest partner where no third fits; a text with the best pair where no fourth fits) are fixed for all
texts of that size at once, the rest goes best fit by falling size. Then each text takes the slot of its rank among
the texts of its size.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import TOKENIZER, ranked, with_token_counts
from threadloom.session import StageTables


class _Sizes:
    """A multiset of sizes with sorted look-up."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def largest(self, limit: int, used: Counter = Counter()) -> int | None:
        """The largest size up to limit of which more is there than used."""
        k = bisect.bisect_right(self.order, limit)
        while k:
            s = self.order[k - 1]
            if self.n[s] > used[s]:
                return s
            k -= 1
        return None

    def smallest(self, k: int, used: Counter) -> int | None:
        """Sum of the k smallest items besides those used; none if there are not so many."""
        total = 0
        for s in self.order:
            here = min(k, self.n[s] - used[s])
            total += s * max(0, here)
            k -= max(0, here)
            if k <= 0:
                return total
        return None

    def take(self, items: Counter, times: int) -> None:
        for s, k in items.items():
            self.n[s] -= k * times
            if not self.n[s]:
                del self.n[s]
                self.order.pop(bisect.bisect_left(self.order, s))


def dominating(sizes: _Sizes, j: int, capacity: int) -> Counter | None:
    """The contents of a container with j that dominates every other such container, if one is found."""
    rest, used = capacity - j, Counter({j: 1})
    a = sizes.largest(rest, used)
    if a is None or a == rest:
        return used + Counter([a] if a else [])
    two = sizes.smallest(2, used)
    if two is None or two > rest:
        return used + Counter([a])
    three = sizes.smallest(3, used)
    if three is None or three > rest:
        with_a = used + Counter([a])
        b = sizes.largest(rest - a, with_a)
        # any other pair's larger item is at most a; its smaller one is at most half of the room
        half = sizes.largest(rest // 2, used)
        if b is not None and (half is None or b >= half):
            return with_a + Counter([b])
        # a pair that fills the room and whose smaller item is the largest that any pair can have
        if half is not None:
            c = sizes.largest(rest - half, used + Counter([half]))
            if c is not None and c >= half and c + half == rest and c == a:
                return used + Counter([half, c])
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """([(contents as (size, how many) pairs, number of such containers)], how many of the containers are fixed by
    dominance). Every size must be from 1 to capacity."""
    sizes = _Sizes(counts)
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    fixed = 0
    again = True
    while again:
        again = False
        for j in sorted(sizes.n, reverse=True):
            while j in sizes.n:
                s = dominating(sizes, j, capacity)
                if s is None:
                    break
                times = min(sizes.n[x] // k for x, k in s.items())
                sizes.take(s, times)
                bins.append((tuple(sorted(s.items())), times))
                fixed += times
                again = True
    # best fit by falling size; containers of like contents are one group
    room: dict[int, list[list]] = {}
    open_ = []
    for s in sorted(sizes.n, reverse=True):
        left = sizes.n[s]
        while left:
            k = bisect.bisect_left(open_, s)
            if k < len(open_):
                r = open_[k]
                contents, there = room[r].pop()
                if not room[r]:
                    del room[r]
                    open_.pop(k)
            else:
                r, contents, there = capacity, Counter(), left
            each = r // s  # best fit goes on with the container it has just filled, as that has the least room
            full = min(there, left // each)
            parts = [(full, each)] + ([(1, left - full * each)] if full < there and 0 < left - full * each < each else [])
            for times, items in parts:
                if times:
                    left -= times * items
                    there -= times
                    _put(room, open_, r - s * items, contents + Counter({s: items}), times)
            if there and contents:
                _put(room, open_, r, contents, there)
    bins += [(tuple(sorted(c.items())), n) for groups in room.values() for c, n in groups]
    return bins, fixed


def _put(room, open_, r, contents, times) -> None:
    if r not in room:
        room[r] = []
        bisect.insort(open_, r)
    room[r].append([contents, times])


def slots(bins) -> pd.DataFrame:
    """For each size the runs of places: from place first on, each container from start on takes k texts."""
    at: Counter = Counter()
    start, rows = 0, []
    for contents, n in bins:
        for s, k in contents:
            rows.append((s, at[s], k, start))
            at[s] += k * n
        start += n
    return pd.DataFrame(rows, columns=["size", "first", "k", "start"]).sort_values(["size", "first"], ignore_index=True)


def pack(lengths: DataFrame, capacity: int, rows: int) -> DataFrame:
    """(id, piece, n_tokens, bin_id): lengths (id, tokens) in containers of the capacity.

    A text longer than the capacity is cut into full pieces and a last one, numbered from 0; every other text is
    whole, as piece 0. Texts without tokens go nowhere.
    """
    p = lengths.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))))
    p = p.select("id", "piece", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity).alias("n_tokens"))
    counts = {r["n_tokens"]: r["n"] for r in p.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    bins, _ = plan(counts, capacity)
    s = slots(bins)
    keys = s["size"].to_numpy(np.int64), s["first"].to_numpy(np.int64), s["k"].to_numpy(np.int64), s["start"].to_numpy(np.int64)
    # the plan has at most a few runs for each size, so its size depends on the capacity and not on the corpus
    shared = lengths.sparkSession.sparkContext.broadcast(keys)

    def place(batches):
        size, first, k, start = shared.value
        lo = np.searchsorted(size, np.arange(capacity + 2))
        for pdf in batches:
            n, rank = pdf["n_tokens"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            order = np.lexsort((rank, n))
            at = np.empty(len(pdf), np.int64)
            i = 0
            while i < len(order):
                s = n[order[i]]
                j = i + np.searchsorted(n[order[i:]], s, "right")
                at[order[i:j]] = lo[s] + np.searchsorted(first[lo[s] : lo[s + 1]], rank[order[i:j]], "right") - 1
                i = j
            yield pdf[["id", "piece", "n_tokens"]].assign(bin_id=start[at] + (rank - first[at]) // k[at])

    r = ranked(p, ["n_tokens"], F.xxhash64("id", "piece"), rows)
    return r.mapInPandas(place, f"id {lengths.schema['id'].dataType.simpleString()}, piece int, n_tokens long, bin_id long")


def packed_documents(documents: DataFrame, sizes: list[tuple[str, int]], path: str = TOKENIZER) -> DataFrame:
    """(pack_name, bin_id, doc_id, piece, n_tokens) for each named capacity; see pack() for the pieces.

    documents: doc_id and text. Null and empty texts go nowhere; rows repeated under one doc_id are packed as often
    as they stand there; capacities that are null or below 1 are left out.
    """
    keep = StageTables(documents.sparkSession, "packing")
    n = keep.write(with_token_counts(documents, "doc_id", "text", path=path), "lengths")
    rows = n.count()
    out = None
    for name, capacity in sizes:
        if capacity and capacity > 0:
            p = pack(n, int(capacity), rows).select(F.lit(name).alias("pack_name"), "bin_id", F.col("id").alias("doc_id"), "piece", "n_tokens")
            out = p if out is None else out.unionByName(p)
    return out


def _packed(spark, sf_dir):
    sizes = [(r["pack_name"], r["capacity_tokens"]) for r in spark.read.parquet(f"{sf_dir}/pack_sizes.parquet").orderBy("pack_name").collect()]
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), sizes)


def p8_packed(spark, sf_dir):
    return _packed(spark, sf_dir)


def p8_fill(spark, sf_dir):
    """Containers, texts cut and the share of room used, for each capacity."""
    c = spark.read.parquet(f"{sf_dir}/pack_sizes.parquet")
    b = _packed(spark, sf_dir).groupBy("pack_name", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.count_if(F.col("piece") > 0).alias("cut"))
    b = b.groupBy("pack_name").agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.sum("cut").alias("further_pieces"), F.max("used").alias("fullest"))
    b = b.join(c, "pack_name").withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    return b.withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))


def p8_kept(spark, sf_dir):
    """For each capacity the texts placed, containers fuller than it, and texts cut that it could hold whole."""
    c = spark.read.parquet(f"{sf_dir}/pack_sizes.parquet")
    p = _packed(spark, sf_dir)
    texts = p.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces")).join(c, "pack_name")
    texts = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut_needlessly"))
    full = p.groupBy("pack_name", "bin_id").agg(F.sum("n_tokens").alias("used")).join(c, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    return texts.join(full, "pack_name").select("pack_name", "texts", "overfull", "cut_needlessly")


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p8_kept": p8_kept}
SQL = {
    "p8_kept": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL AND text <> '') AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut_needlessly FROM pack_sizes"
}
