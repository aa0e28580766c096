"""Problems 8 and 9."""

import random
from collections import Counter

from pyspark.sql import functions as F

from threadloom.llm import mixing, packing, registry, tokens


def check(counts, capacity, bins):
    got = Counter()
    for contents, n in bins:
        assert sum(s * k for s, k in contents) <= capacity and n > 0
        for s, k in contents:
            got[s] += k * n
    assert got == Counter({s: n for s, n in counts.items() if n})


def least_bins(items, capacity):
    """Fewest containers, by trying everything."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            j = rooms.index(r)
            go(k + 1, rooms[:j] + [r - items[k]] + rooms[j + 1 :])
        go(k + 1, rooms + [capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plans_hold_all_and_reduction_is_safe():
    rng = random.Random(8)
    for _ in range(150):
        c = rng.randint(5, 30)
        items = [rng.randint(1, c) for _ in range(rng.randint(1, 9))]
        counts = Counter(items)
        bins, fixed = packing.plan(dict(counts), c)
        check(counts, c, bins)
        best = least_bins(items, c)
        assert sum(n for _, n in bins) <= best * 11 // 9 + 1
        # what dominance fixes leaves a rest that can still be packed as well as possible
        fixed_bins, rest = [], Counter(counts)
        for contents, n in bins[: next((k for k in range(len(bins) + 1) if sum(n for _, n in bins[:k]) == fixed), 0)]:
            fixed_bins.append(n)
            for s, k in contents:
                rest[s] -= k * n
        assert sum(fixed_bins) + least_bins([s for s, n in rest.items() for _ in range(n)], c) == best
    assert packing.plan({}, 10) == ([], 0)
    check({10: 3}, 10, packing.plan({10: 3}, 10)[0])


def test_large_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(20_000))
    bins, _ = packing.plan(dict(counts), 2048)
    check(counts, 2048, bins)
    assert sum(n for _, n in bins) <= -(-sum(s * n for s, n in counts.items()) // 2048) * 1.005 + 1


def test_packing_of_texts(spark):
    df = spark.createDataFrame([(i, "one two three " * (i % 40), "z") for i in range(200)] + [(900, None, "z"), (901, "", "z"), (902, "word " * 500, "z"), (902, "word " * 500, "z")], "doc_id long, text string, bin_id string")
    p = packing.packed_documents(df, [("a", 64), ("b", None)]).cache()
    n = {r["id"]: r["tokens"] for r in tokens.with_token_counts(df, "doc_id", "text").collect()}
    assert p.groupBy("bin_id").agg(F.sum("n_tokens").alias("s")).where("s > 64").count() == 0 and {r["pack_name"] for r in p.collect()} == {"a"}
    sums = {r["doc_id"]: r["s"] for r in p.groupBy("doc_id").agg(F.sum("n_tokens").alias("s")).collect()}
    assert sums == {i: k * (2 if i == 902 else 1) for i, k in n.items() if k} and p.where("piece > 0").select("doc_id").distinct().count() == len([k for k in n.values() if k > 64])
    assert packing.packed_documents(df.limit(0), [("a", 64)]).count() == 0


def test_ranks_are_each_place_once(spark, monkeypatch):
    monkeypatch.setattr(tokens, "ROWS_PER_BUCKET", 10)
    df = spark.range(300).select("id", (F.col("id") % 3 == 0).alias("hot"))
    r = tokens.ranked(df, ["hot"], F.xxhash64("id"), 300).collect()
    for hot in (True, False):
        assert sorted(x["rank"] for x in r if x["hot"] == hot) == list(range(sum(x["hot"] == hot for x in r)))


def brute_fit(counts, budget):
    reach = {0}
    for s, n in counts.items():
        reach = {r + s * k for r in reach for k in range(n + 1) if r + s * k <= budget}
    return max(reach)


def test_knapsack_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        b = rng.randint(0, 150)
        got = mixing.bounded_knapsack(counts, b)
        assert sum(s * n for s, n in got.items()) == brute_fit(counts, b) and all(0 < n <= counts[s] for s, n in got.items())
        fit = mixing.fit(counts, b, window=8)
        assert sum(s * n for s, n in fit.items()) == brute_fit(counts, b) and all(n <= counts[s] for s, n in fit.items())
    assert sum(s * n for s, n in mixing.fit({77475: 3, 32791: 1, 86586: 4, 92626: 2}, 346_344).items()) == 346_344
    counts = {k: 50 for k in range(3, 200)}
    assert sum(s * n for s, n in mixing.fit(counts, 400_000).items()) == 400_000


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, "word " * rng.randint(1, 60) + str(i), rng.choice("ABBBBCCD"), "c") for i in range(400)]
    docs += [(1000, docs[0][1], "A", "c"), (1001, None, "A", "c"), (1002, "", "B", "c"), (1003, "text", None, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rank string")
    t = spark.createDataFrame([("A", 0.4, 3), ("B", 0.3, 1), ("C", 0.3, 2), ("Z", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(df, t).cache()
    s = {r["source"]: r["t"] for r in m.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).collect()}
    total = sum(s.values())
    assert all(abs(s[k] / total - w) < 0.002 for k, w in (("A", 0.4), ("B", 0.3), ("C", 0.3))) and set(s) == {"A", "B", "C"}
    assert m.where("(source = 'A' and uses > 3) or (source = 'B' and uses > 1) or (source = 'C' and uses > 2)").count() == 0
    assert m.where("doc_id in (1000, 1001, 1002, 1003)").count() == 0 and m.select("doc_id").distinct().count() == m.count()
    small = mixing.mixed(df, t, total=300)
    assert 0 < small.agg(F.sum(F.col("tokens") * F.col("uses"))).first()[0] <= 300
    assert mixing.mixed(df.limit(0), t).count() == 0


def test_every_problem_has_queries():
    q = registry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 10)} <= set(q) and {"p8_packed", "p9_mix"} <= set(q) and set(registry.oracle_sql()) <= set(q)


def test_first_copy_without_target(spark):
    d = spark.createDataFrame([("a", "one two three", None), ("b", "one two three", "other"), ("c", "one two three", "s"), ("d", "four five", "s")], "doc_id string, text string, source string")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert {r["doc_id"] for r in mixing.mixed(d, t).collect()} == {"c", "d"}
