import functools
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import names as nm
from threadloom.operators import blocks, evaluate, graph, ingest, lookup, resolution, store
from threadloom.sources import jsonl


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("s,kind,want", [("Mr. Narendra Módi", "PERSON", "narendra modi"), ("Prime Minister Narendra Modi", "PERSON", "narendra modi"), ("PM Modi", "PERSON", "modi"), ("Md Salim", "PERSON", "md salim"), ("Reliance Industries Ltd.", "ORG", "reliance industries"), ("The Board of Control for Cricket in India", "ORG", "board control cricket india"), ("Group", "ORG", ""), ("", "PERSON", "")])
def test_plain_name(spark, s, kind, want):
    d = spark.createDataFrame([(s, kind)], "s string, k string")
    assert d.select(nm.plain_name(nm.strip_accents("s"), F.col("k"))).first()[0] == want


def test_phonetic_keys_and_features(spark):
    d = spark.createDataFrame([("sergey", "sergei"), ("mohamed", "muhammad"), ("ashcraft", "ashcroft")], "a string, b string")
    assert all(r[0] == r[1] for r in d.select(nm.phonetic_code(F.col("a")), nm.phonetic_code(F.col("b"))).collect())
    assert d.select(nm.phonetic_code(F.col("a"))).collect()[2][0] == "a226"
    k = spark.createDataFrame([("narendra modi", "PERSON"), ("new development bank", "ORG"), ("ndb", "ORG"), ("", "ORG")], "n string, k string").select(nm.blocking_keys(F.col("n"), F.col("k"))).collect()
    assert k[0][0] == ["full:narendra modi", "init:n_modi", "phon:m300", "sur:modi"] and "acr:ndb" in k[1][0] and "acr:ndb" in k[2][0] and k[3][0] == []
    p = spark.createDataFrame([("a b", "a b"), ("modi", "narendra modi"), ("ndb", "new development bank"), ("un", "united nations"), ("sergey lavrov", "sergei ryabkov"), ("", "x")], "a string, b string")
    got = [r[0] for r in p.select(nm.name_compatibility(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.8, 0.8] and 0 < got[3] <= 0.7 and 0 < got[4] <= 0.7 and got[5] == 0
    assert nm.token_set_ratio("a b", "b a c") == 100.0
    c = spark.createDataFrame([("vladimir putin", "alexei putin"), ("v putin", "vladimir putin"), ("putin", "vladimir putin")], "a string, b string")
    assert [r[0] for r in c.select(nm.given_name_conflict(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_indel_equals_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert abs(nm._indel(a, b) - (2 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in root)


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("hub", f"x{i}") for i in range(40)] + [(f"r{rng.randint(0, 50)}", f"r{rng.randint(0, 50)}") for _ in range(60)] + [("s", "s"), (None, "q"), ("b", "a"), ("a", "b")]
    assert rows(graph.components(spark.createDataFrame(edges, "a string, b string"), "a", "b")) == brute_components(edges)
    assert graph.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    assert rows(graph.components(spark.createDataFrame(edges, "a string, b string").repartition(3), "a", "b", one_task=5)) == brute_components(edges)
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(edges, "a string, b string").repartition(3), "a", "b", max_rounds=1, one_task=5)


def test_group_components(spark):
    rng = random.Random(8)
    links = [(f"g{g}", f"g{g}-{rng.randint(0, 30)}", f"g{g}-{rng.randint(0, 30)}") for g in range(9) for _ in range(25)] + [("g0", "g0-1", None), (None, "x", "y")]
    got = rows(graph.group_components(spark.createDataFrame(links, "g string, a string, b string"), "g", "a", "b"))
    assert got == brute_components([(a, b) for g, a, b in links if g])


def test_pairs_within_blocks_cut_into_cells(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None]), f"r{i}", i) for i in range(60)]
    df = spark.createDataFrame(data, "key string, id string, n int")
    want = sorted((k, i, j) for k, i, _ in data for k2, j, _ in data if k is not None and k == k2 and i != j)
    for cell in (1000, 7, 1):
        assert rows(blocks.pairs_within(df, "key", "id", cell=cell), "key", "id", "id2") == want
    assert blocks.pairs_within(df.limit(0), "key", "id").count() == 0


def test_spread_join_equals_join(spark):
    rng = random.Random(9)
    big = spark.createDataFrame([(rng.choice(["hot", "hot", "hot", "a", "b", None, "c"]), i) for i in range(200)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 4)], "k string, v int")
    told = lambda df: sorted(str(tuple(r)) for r in df.select("k", "i", "v").collect())
    for how in ("inner", "left"):
        assert told(blocks.spread_join(big, small, ["k"], "i", how=how, hot_rows=7)) == told(big.join(small, "k", how))


def profiles(spark, data):
    return spark.createDataFrame([(i, t, n, [n], r, [], c, "2024-10-22") for i, t, n, r, c in data], "profile_id string, entity_type string, normalized string, norm_surfaces array<string>, roles array<string>, orgs array<string>, countries array<string>, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))


def test_decisions_clusters_and_soundness(spark):
    p = profiles(spark, [("a", "PERSON", "narendra modi", ["prime minister"], ["India"]), ("b", "PERSON", "narendra modi", ["prime minister"], ["India"]), ("c", "PERSON", "nirav modi", [], ["India"]), ("d", "PERSON", "modi", [], []), ("e", "ORG", "modi", [], []), ("f", "PERSON", "narendra modi", [], ["Nepal"])])
    pairs = resolution.candidate_pairs(resolution.blocks(p))
    d = {(r["left_id"], r["right_id"]): r for r in resolution.pair_features(pairs, p).collect()}
    assert d["a", "b"]["decision"] == "match" and d["a", "c"]["veto"] == "given names differ" and d["a", "d"]["decision"] == "no_match" or d["a", "d"]["decision"] == "review"
    assert d["d", "e"]["veto"] == "entity type differs" and d["a", "f"]["veto"] == "countries differ" and d["a", "b"]["reason"].startswith("name=1.00x0.35")
    m = spark.createDataFrame([("a", "d"), ("d", "c")], "left_id string, right_id string").withColumn("score", F.lit(0.6))
    c = resolution.match_clusters(p, m)
    assert len({r["root"] for r in c.where("profile_id in ('a', 'c', 'd')").collect()}) == 1
    s = {r["profile_id"]: r["root"] for r in resolution.sound_clusters(c, p).collect()}
    assert s == {x: x for x in "abcdef"}  # narendra and nirav must not be one
    ok = resolution.sound_clusters(resolution.match_clusters(p, spark.createDataFrame([("a", "b"), ("b", "d")], "left_id string, right_id string")), p)
    assert {r["root"] for r in ok.where("profile_id in ('a', 'b', 'd')").collect()} == {"a"}
    report = resolution.blocking_report(p, pairs).first()
    assert report["all_pairs"] == 15 and report["generated"] == pairs.count()


def test_context_rank(spark):
    p = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.0), ("b", "c", 0.0), ("c", "d", 0.5)], "left_id string, right_id string, raw double")
    assert rows(resolution.context_rank(p, "raw"), "left_id", "right_id", F.round("context", 4).alias("c")) == [("a", "b", 0.0), ("a", "c", 0.3333), ("b", "c", 0.6667), ("c", "d", 1.0)]
    assert rows(resolution.context_rank(p, "raw", "neutral"), "left_id", "context") == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("c", 1.0)]
    assert resolution.context_rank(p.limit(1), "raw").first()["context"] == 0.5


@pytest.mark.parametrize("ties", ["position", "neutral"])
def test_context_rank_with_more_columns(spark, ties):
    """Ranks over many partitions and values, with columns beside the ids: as by one sort in Python."""
    p = spark.range(20_000).select(F.format_string("l%05d", "id").alias("left_id"), F.lit("r").alias("right_id"), (F.xxhash64("id") % 3000).cast("double").alias("raw"), F.col("id").alias("extra"), F.lit(None).cast("string").alias("note"))
    got = {r["left_id"]: r for r in resolution.context_rank(p, "raw", ties).collect()}
    order = sorted(p.collect(), key=lambda r: (r["raw"], r["left_id"]))
    first = {}
    for k, r in enumerate(order):
        first.setdefault(r["raw"], k)
        want = (k if ties == "position" else first[r["raw"]]) / 19_999
        assert got[r["left_id"]]["context"] == pytest.approx(want) and got[r["left_id"]]["extra"] == r["extra"]


def test_profiles_and_bare_surnames(spark):
    m = spark.createDataFrame([("m1", "d", 0, "Narendra Modi", "PERSON", "k1", "narendra modi"), ("m2", "d", 50, "Modi", "PERSON", "k1", "modi"), ("m3", "d", 70, "Putin", "PERSON", None, "putin"), ("m4", "d", 90, "Vladimir Putin", "PERSON", None, "vladimir putin"), ("m5", "d", 99, "Rs", "ORG", None, "rs")], "mention_id string, article_id string, start_char int, text string, label string, coref_cluster_id string, norm string")
    p = resolution.profiles(m)
    assert rows(p, "profile_id", "canonical_surface", F.size("surfaces").alias("n")) == [("d:p000", "Narendra Modi", 2), ("d:p001", "Putin", 1), ("d:p002", "Vladimir Putin", 1)]
    assert rows(resolution.surname_attachments(p)) == [("d:p001", "d:p002")]


def test_ingest_status(spark):
    long, at = "x" * 120, "2024-01-01T00:00:00Z"
    a = spark.createDataFrame([("a", "t", "s", at, "short", 1), ("a", "t", "s", at, long, 2), ("a", "t", "s", at, long, 3), ("b", None, "s", at, long, 4), ("c", "t", "s", "2024-01-01 00:00:00", long, 5), ("a", "t", "s", at, "short", 6)], "article_id string, title string, source string, published_at string, body string, line int")
    s = ingest.with_status(a, ["line"])
    assert [r["status"] for r in s.orderBy("line").collect()] == ["too_short", "kept", "duplicate", "invalid", "invalid", "duplicate"]
    assert tuple(ingest.ingestion_stats(s).first()) == (6, 1, 2, 2, 1) and ingest.kept_articles(s).count() == 1


def test_store_and_lookup(spark):
    rel = spark.createDataFrame([("r1", "art_a", "m1", "Modi", "met", "m2", "Putin", "PERSON", 0.75), ("r2", "art_b", "m3", "Modi", "met", "m4", "Vladimir Putin", "PERSON", 0.75), ("r3", "art_b", "m3", "Modi", "said", "m9", " AI ", "TOPIC", 0.4)], "relation_id string, article_id string, subject_id string, subject_text string, predicate string, object_id string, object_text string, object_label string, confidence double")
    em = spark.createDataFrame([("E1", "m1", "art_a"), ("E2", "m2", "art_a"), ("E1", "m3", "art_b"), ("E2", "m4", "art_b")], "entity_id string, mention_id string, article_id string")
    art = spark.createDataFrame([("art_a", "A", "s", "2024-10-22", "Modi met Putin"), ("art_b", "B", "s", "2024-11-05", "x")], "article_id string, title string, source string, published_at string, body string")
    ent = spark.createDataFrame([("E1", "Narendra Modi", "PERSON", 2, 2, 0.9), ("E2", "Vladimir Putin", "PERSON", 2, 2, 0.5)], "entity_id string, canonical_name string, entity_type string, article_count int, mention_count int, merge_confidence double")
    al = spark.createDataFrame([("E1", "PM Modi", "modi")], "entity_id string, alias string, normalized string")
    edges, ev = store.build_edges(rel, em, art)
    met = edges.where("predicate = 'met'").first()
    assert met["support_count"] == 2 and abs(met["confidence"] - 0.9375) < 1e-12 and met["object_value"] == "Vladimir Putin" and met["object_entity_id"] == "E2"
    assert edges.where("predicate = 'said'").first()["object_key"] == "ai" and ev.count() == 3
    assert [r["entity_id"] for r in lookup.find_entity(ent, al, "pm modi").collect()] == ["E1"] and lookup.find_entity(ent, al, "x' OR '1'='1").count() == 0
    assert rows(lookup.in_articles_about(art, em, ent, "putin"), "entity_id", "articles") == [("E1", 1), ("E2", 1)]
    assert rows(lookup.co_occurring(em, ent, "E1"), "entity_id", "shared_articles") == [("E2", 2)] and rows(lookup.co_occurring(em, ent)) == [("E1", "E2", 2)]
    assert lookup.relations_for_entity(edges, ent, "E1", min_confidence=0.5).first()["object_name"] == "Vladimir Putin" and lookup.entity_graph(edges, ent, "E1").count() == 2
    assert lookup.low_confidence_relations(rel, art, 0.5).count() == 1 and lookup.relation_evidence(ev, rel, art, met["edge_id"]).count() == 2
    assert rows(lookup.weakly_supported(ent), "entity_id") == [("E2",)] and lookup.organisations_of(edges, ent, "E1").count() == 0
    at = store.attributes_long(ent.withColumn("tags", F.array(F.lit("x"), F.lit(None))), "entity_id", {"entity_type": "type", "tags": "tag"})
    assert rows(at.where("entity_id = 'E1'")) == [("E1", "tag", "x"), ("E1", "type", "PERSON")] and lookup.by_attribute(at, ent, "type", "person").count() == 2
    assert lookup.entity_profile(ent, al, at, "E1").first()["attributes"]["tag"] == ["x"] and lookup.search_entities(ent, al, "modi").count() == 1
    mem = spark.createDataFrame([("k", "m1", "Narendra Modi", True), ("k", "m3", "he", False)], "cluster_id string, mention_id string, text string, is_representative boolean")
    assert rows(lookup.resolve_mention(spark.createDataFrame([("m3", "he"), ("m8", "z")], "mention_id string, text string"), mem)) == [("m3", "Narendra Modi"), ("m8", "z")]
    assert rows(store.upsert(ent.select("entity_id", "article_count"), spark.createDataFrame([("E1", 9)], "entity_id string, article_count int"), ["entity_id"])) == [("E1", 9), ("E2", 2)]
    assert rows(store.orphans(rel, em, "object_id", "mention_id"), "object_id") == [("m9",)] and rows(store.table_counts({"e": ent, "a": art})) == [("a", 2), ("e", 2)]


def test_measures(spark):
    c = lambda d: spark.createDataFrame([(i, k) for k, xs in d.items() for i in xs], "item string, cluster string")
    gold, merged = c({"1": "ab", "2": "cd"}), c({"x": "abcd"})
    assert evaluate.muc(gold, merged).first()["recall"] == 1.0 and evaluate.b_cubed(gold, merged).first()["precision"] == 0.5
    p = evaluate.pairwise(gold, merged).first()
    assert (p["tp"], p["false_merges"], p["false_splits"]) == (2, 4, 0)
    g, q = (spark.createDataFrame([(x, "L") for x in s], "k string, label string") for s in ("abc", "bcd"))
    assert tuple(evaluate.set_scores(g, q, ["k", "label"], ["label"]).first())[1:4] == (2, 1, 1)
    s = "article_id string, label string, start int, end int"
    r = evaluate.relaxed_matches(spark.createDataFrame([("d", "P", 0, 5), ("d", "P", 10, 15)], s), spark.createDataFrame([("d", "P", 3, 12), ("d", "P", 11, 14), ("d", "O", 0, 5)], s))
    assert rows(r, "label", "tp", "fp", "fn") == [("O", 0, 1, 0), ("P", 2, 0, 0)]


def test_sources(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"title": "a", "body": "b", "extra": {"k": "v"}}\nnot json\n\n[1, 2]\n')
    got = jsonl.read_any(spark, str(f))
    assert got.count() == 1 and got.first()["extra"] == {"k": "v"} and jsonl.bad_lines(spark, str(f)).count() == 2
    with pytest.raises(ValueError):
        jsonl.read_any(spark, "x.xyz")

    def fetch(url):
        if "bad" in url:
            raise OSError("no")
        return {"title": "t", "body": "b"}

    u = spark.createDataFrame([(" http://a ",), ("http://a",), ("",), (None,), ("http://bad",)], "u string")
    assert rows(jsonl.fetch_pages(u, "u", fetch), "url", "title", "error") == [("http://a", "t", None), ("http://bad", None, "OSError: no")]
    n = jsonl.nested_documents(spark.createDataFrame([(1,)], "id int"), "id", sentences=spark.createDataFrame([(1, 5), (1, 2)], "id int, start int")).first()
    assert [x["start"] for x in n["sentences"]] == [2, 5] and jsonl.manual_article(spark, "b" * 80).first()["title"] == "b" * 60


def test_every_core_query_runs(spark, sf):
    from threadloom.plans import registry

    q, s = registry.queries(), registry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 55
    for name in ("co_occurrence", "graph_edges", "windowed_events", "resolved_entities", "coref_clusters", "sentence_cover"):
        assert q[name](spark, sf).columns
    assert registry.flagship(spark, sf).count() > 0 and q["windowed_events"](spark, sf).count() > 0


def test_spellings_equal_token_set_ratio():
    """Many pairs at once as each alone: other alphabets, names longer than a word of bits, many tokens, nulls, new batches."""
    rng, s = random.Random(6), nm.Spellings()
    known = ["ab", "abc", "foods", "ñá", "x" * 20, "αβ", "kelvar"]
    name = lambda: " ".join(rng.choice(known) if rng.random() < 0.7 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 12 if rng.random() < 0.1 else 4)))
    for k in range(3):
        a, b = ([None, "", "α" * 70, "".join(map(chr, range(300, 380)))] + [name() for _ in range(700)] for _ in range(2))
        rng.shuffle(b)
        assert s.of(nm.pa.array(a), nm.pa.array(b)).tolist() == [nm.token_set_ratio(x or "", y or "") for x, y in zip(a, b)]
        s.KEPT = (nm.Spellings.KEPT, 900, 100)[k]  # rows are given up, then batches halved


def random_profiles(spark, n=150):
    rng = random.Random(7)
    some = lambda xs: sorted(rng.sample(xs, rng.randint(0, 2)))
    data = [(f"p{i % (n - 3):03d}", rng.choice(["PERSON", "ORG", None]), rng.choice([None, ""] + 9 * [" ".join(rng.choices(["ana", "a", "moro", "foods", "kelvar", "af", "lines"], k=rng.randint(1, 3)))]), some(["x", "y", "z"]), some(["r", "s"]), some(["o"] * 2), some(["c", "d"]), f"2024-10-{rng.randint(1, 28):02d}") for i in range(n)]
    return spark.createDataFrame(data, "profile_id string, entity_type string, normalized string, norm_surfaces array<string>, roles array<string>, orgs array<string>, countries array<string>, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp"))


def test_features_where_pairs_meet(spark, monkeypatch):
    """Pairs under their least key in cells, with equal and repeated ids too, give the rows of pairs made distinct and joined with both profiles."""
    p = random_profiles(spark)
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    want = told(resolution.pair_features(resolution.candidate_pairs(resolution.blocks(p)), p))
    assert told(resolution.features(resolution.met_pairs(p))) == want and len(want) > 500
    monkeypatch.setattr(resolution, "pairs_within", functools.partial(blocks.pairs_within, cell=7))
    assert told(resolution.features(resolution.met_pairs(p))) == want


def test_texts_of_features(spark):
    x = spark.createDataFrame([(v,) for v in [0.0, 0.005, 0.015, 0.125, 0.345, 0.35, 0.7, 0.995, 1.0, 1.5, -0.2] + [k / 1000 for k in range(1001)]], "x double")
    assert x.where(nm._two_places(F.col("x"), "name=", "x0.35") != F.format_string("name=%.2fx0.35", "x")).count() == 0


def test_matches_equal_decisions(spark):
    """Leaving out the pairs that can't match where they meet loses none that do."""
    p = random_profiles(spark)
    met = resolution.features(resolution.met_pairs(p))
    want = rows(met.where("decision = 'match'"), "left_id", "right_id", "score")
    assert rows(resolution.matches(p)) == want and 5 < len(want) < met.count()
    sets = p.withColumns({c: F.array_distinct(c) for c in resolution.SETS.values()})
    assert len(want) <= resolution.met_pairs(sets, resolution._may_match).count() < met.count()


def test_measured_then_scored(spark):
    """The pipeline's way: pairs measured where they meet or in blocks of a size, ranked, then scored; as by joins with the profiles."""
    p = random_profiles(spark).dropDuplicates(["profile_id"])
    for most in (None, 40):
        pairs = resolution.candidate_pairs(resolution.blocks(p), most).withColumn("raw", F.lit(0.0))
        want = rows(resolution.pair_features(resolution.context_rank(pairs, "raw").drop("raw"), p).select("left_id", "right_id", "context", "score", "decision", "reason"))
        measured = resolution.measured_pairs(p, most).withColumn("raw", F.lit(0.0))
        assert "context" not in measured.columns
        got = resolution.scored(resolution.context_rank(measured, "raw").drop("raw"))
        assert rows(got.select("left_id", "right_id", "context", "score", "decision", "reason")) == want and len(want) > 100
