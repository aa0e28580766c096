"""Problems 1, 3, 5 and 6."""

import random

from pyspark.sql import functions as F

from threadloom.llm import components, lookalikes, name_variants, repeated_lines


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def brute_groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in root)


def test_components_equal_union_find_in_many_small_cells(spark):
    rng = random.Random(2)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"x{i}") for i in range(200)]
    rand = [(f"r{rng.randint(0, 300)}", f"r{rng.randint(0, 300)}") for _ in range(200)]
    edges = chain + star + rand + [("s", "s"), (None, "q"), ("q", None), ("b", "a"), ("a", "b"), ("a", "b")]
    df = spark.createDataFrame([(a, b, "v") for a, b in edges], "left_id string, right_id string, vertex string")
    assert rows(components.connected_components(df, edges_per_cell=40)) == brute_groups(edges)
    assert rows(components.connected_components(df)) == brute_groups(edges)
    assert components.connected_components(df.limit(0)).count() == 0


def test_groups_use_any_match(spark):
    df = spark.createDataFrame([("a", "b", "match"), ("b", "a", "no_match"), ("b", "c", None), ("d", "e", "review")], "left_id string, right_id string, decision string")
    assert rows(components.groups_of_pairs(df)) == [("a", "a"), ("b", "a")]


def test_every_local_solution_keeps_the_least_priority():
    import numpy as np

    u, v = np.array(["a", "b", "d"], object), np.array(["b", "c", "e"], object)
    got = components._local_union_find(u, v, np.array([5, 1, 7]), np.array([1, 9, 3]))
    assert dict(zip(got.vertex, got.rep)) == {"a": "b", "b": "b", "c": "b", "d": "e", "e": "e"}


def test_lookalike_classes_are_transitive():
    of = {m: k for k, c in enumerate(lookalikes.lookalike_classes()) for m in c}
    assert of["ﬁ"] == of["fi"] and of["Ａ"] == of["A"] == of["А"] == of["Α"] and of[" "] == of["\xa0"] == of["　"] and of["é"] == of["e\u0301"]
    assert of["\u200b"] == of[""] and of["l"] != of.get("I") and of["o"] != of.get("0") and of.get("²") != of.get("2", -1) and of["-"] == of["‑"]


def test_rewriting_reaches_one_form():
    a, b = "Zoë’s final café offer, ok\n", "Ｚｏё’s\u200b ﬁnal caf\u0435\u0301 o\ufb00er, оk\n"
    counts = {}
    for ch in a * 3 + b:
        counts[ch] = counts.get(ch, 0) + 1
    counts |= {s: (a * 3 + b).count(s) for s in lookalikes._strings()}
    r = lookalikes.Rewriter(lookalikes.rewriting(counts))
    assert r(a) == r(b) == a and r("") == "" and r(None) is None


def test_lookalike_pairs(spark):
    base = ("Bank talks", "The office said so. " * 2000)
    data = [
        ("a", *base), ("a", *base), ("b", "Ваnk talks", base[1]), ("c", "Bank talks", base[1].replace(" ", "\u00a0")), ("d", "Bank ta1ks", base[1]), ("e", *base),
        ("f", None, "x"), ("g", None, "x\u200b"), ("h", "", ""), ("i", "", "\u2060"), ("j", None, None), (None, *base),
    ]
    df = spark.createDataFrame([(*r, "raw", 1) for r in data], "id string, title string, body string, look string, raw int")
    got = rows(lookalikes.lookalike_pairs_of_rows(df, "id", ["title", "body"]))
    assert got == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "e"), ("c", "e"), ("f", "g"), ("h", "i")]
    assert lookalikes.lookalike_pairs_of_rows(df.limit(0), "id", ["title", "body"]).count() == 0
    n = lookalikes.normalise_lookalikes(df, ["title"], lookalikes.rewriting(lookalikes.corpus_counts(df.select("title", "body"))))
    assert n.where("id = 'b'").first()["title"] == "Bank talks" and n.where("id = 'j'").first()["title"] is None


def test_repeated_lines(spark):
    notice, other = "All rights reserved by the Ledger, 2024 edition", "Nobody may copy this text without permission"
    bodies = [f"Story {chr(97 + i) * 3} is told in many words here\n{notice.replace('2024', str(2000 + i)).upper() if i % 2 else notice}\n\n {other}\t" for i in range(6)]
    data = [(f"a{i}", "S", b, "k1") for i, b in enumerate(bodies)] + [("a0", "S", bodies[0], "k1"), ("b0", "T", notice, "x"), ("n", None, notice, "x"), ("m", "S", None, "x"), ("e", "S", "", "x"), (None, "S", notice, "x")]
    df = spark.createDataFrame(data, "article_id string, source string, body string, k1 string")
    f = repeated_lines.repeated_lines(df)
    assert rows(f, "id", "line_no") == sorted((f"a{i}", k) for i in range(6) for k in (1, 3)) and len({r["block"] for r in f.collect()}) == 1
    clean = {r["article_id"]: r["body"] for r in repeated_lines.without_lines(df.dropna(subset=["article_id"]), f).collect()}
    assert clean["a1"] == "Story bbb is told in many words here\n" and clean["b0"] == notice and clean["m"] is None and clean["e"] == ""
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_parsing_of_names():
    p = name_variants.parse_person
    for t in ("José Notulsard", "NOTULSARD, Jose", "jose notulsard", "JoséNotulsard", "José W. Notulsard", "Pepe Notulsard", "Prof. jose notulsard"):
        assert p(t)[:2] == ("full", ["jose", "notulsard"]), t
    assert p("T.Stenednini") == ("initial", ["stenednini"], "t", False) and p("Dr. Sanedvan")[:2] == ("surname", ["sanedvan"]) and p("")[0] == "none" and p("O'Kagetdan, Jo")[1] == ["joseph", "okagetdan"]
    o = name_variants.tokens_of_org
    assert o("The Klaj Engy Intl G.m.b.H.") == o("Klaj Energy International GmbH") == ["klaj", "energy", "international"]
    assert [name_variants.edits(*x) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("fsrid", "faird"), ("abcd", "zzzz"))] == [0, 1, 1, 2, 3]
    assert set(name_variants.block_keys(["maria", "grazursan"], True)) & set(name_variants.block_keys(["maria", "grazurscn"], True))


def test_linked_names(spark):
    ent = spark.createDataFrame([("p1", "PERSON", "Marie Grazursan", 1), ("p2", "PERSON", "Grazursan, Marie", 2), ("p3", "PERSON", "Hugo Grazursan", 3), ("p4", "PERSON", "Hugo Vonedsov", 4), ("o1", "ORG", "Klaj Shipping Group Ltd", 5), ("o2", "ORG", "Klaj Shpg Grp", 6), ("o3", "ORG", "Klaj Foods Group Ltd", 7), ("z", "PERSON", None, 8)], "entity_id string, entity_type string, canonical_name string, cluster int")
    al = spark.createDataFrame([("p1", "Marie Grazursan"), ("p1", "Marie Grazursan"), ("p2", "Grazursan, Marie"), ("p3", "Hugo Grazursan"), ("p4", "Hugo Vonedsov"), ("o1", "Klaj Shipping Group Ltd"), ("o2", "Klaj Shpg Grp"), ("z", None), (None, "x")], "entity_id string, alias string")
    ms = [("m1", "d1", "Maire Grazursan", "PERSON"), ("m2", "d1", "Grazursan", "PERSON"), ("m3", "d2", "Dr. Vonedsov", "PERSON"), ("m4", "d3", "Grazursan", "PERSON"), ("m5", "d3", "Klaj Shipping", "ORG"), ("m6", "d3", "Marie Grazursan", "PERSON"), ("m7", "d4", "", "ORG"), ("m8", "d4", None, "ORG"), ("m9", "d4", "Nobody Known", "PERSON"), ("mx", "d4", "Marie Grazursan", "TOPIC"), ("m1", "d1", "Maire Grazursan", "PERSON"), ("my", "d5", "Grazursan", "PERSON")]
    ms += [(f"w{i}", f"e{i}", t, k) for i, (t, k) in enumerate([("Marie Grazursan", "PERSON"), ("Klaj Shipping Group Ltd", "ORG"), ("Other Shipping Group Inc", "ORG"), ("Third Shipping Group plc", "ORG"), ("Fourth Foods Group AG", "ORG"), ("Fifth Foods Group AG", "ORG"), ("Sixth Foods Group", "ORG")] * 3)]
    m = spark.createDataFrame([(*r, "c") for r in ms], "mention_id string, article_id string, text string, label string, node string")
    got = set(rows(name_variants.linked_names(m, al, ent)))
    assert {("p1", "p2"), ("o1", "o2"), ("m1", "p1"), ("m1", "p2"), ("m3", "p4"), ("m2", "p1"), ("m2", "p2"), ("m4", "p1"), ("m5", "o1"), ("m5", "o2")} <= got
    assert not {("p1", "p3"), ("p2", "p3"), ("p3", "p4"), ("o1", "o3"), ("o2", "o3")} & got and not [x for x in got if x[0] in ("m6", "m7", "m8", "m9", "mx", "my")]
    assert name_variants.linked_names(m.limit(0), al.limit(0), ent.limit(0)).count() == 0
    assert all(r["left_id"] < r["right_id"] for r in name_variants.linked_names(m, al, ent).where(F.col("left_id").isNotNull()).collect())


def test_frequent_misspelling(spark):
    texts = ["Camille Trtulvez"] * 5 + ["Camille Tratulvez"] * 10 + ["Hugo Barnelov"] * 5 + ["Hugo Varnelov"] * 10 + ["Ana Barnelov"] * 4
    m = spark.createDataFrame([(f"m{k}", "d", t, "PERSON") for k, t in enumerate(texts)], "mention_id string, article_id string, text string, label string")
    names = [("p1", "Camille Trtulvez"), ("p2", "Camille Tratulvez"), ("p3", "Hugo Barnelov"), ("p4", "Hugo Varnelov")]
    e = spark.createDataFrame([(i, "PERSON", t) for i, t in names], "entity_id string, entity_type string, canonical_name string")
    got = {(r["left_id"], r["right_id"]) for r in name_variants.linked_names(m, spark.createDataFrame(names, "entity_id string, alias string"), e).collect()}
    assert ("p1", "p2") in got and ("p3", "p4") not in got  # Barnelov is known from another person


def test_no_accepted_pair_is_left_out_before_the_comparison(spark):
    rng = random.Random(12)

    def typo(w):
        k = rng.randrange(len(w) - 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + rng.choice("aeln") + w[k:], w[:k] + rng.choice("aeln") + w[k + 1 :]])

    data = []
    for _ in range(1500):
        a, b = sorted("".join(rng.choice("aelnrst") for _ in range(rng.randint(2, 10))) for _ in range(2))
        x, y = a, b
        for _ in range(rng.randint(0, 3)):
            x, y = (typo(x), y) if rng.random() < 0.5 and len(x) > 1 else (x, typo(y) if len(y) > 1 else y)
        data.append((rng.choice(["PERSON", "PERSON", "ORG"]), a, b, *rng.choice([(x, y), (y, x)])))
    data += [("PERSON", "betty", "moro", "elizabeth", "moro"), ("ORG", "klaj", "bank", "klja", "bank")]
    df = spark.createDataFrame(data, "type string, a string, b string, a2 string, b2 string")
    got = df.select(name_variants._may_be_one().alias("may"), name_variants._compare(F.col("type") == "PERSON", "a", "b", "a2", "b2").alias("c")).groupBy("may", "c.ok").count().collect()
    n = {(r["may"], r["ok"]): r["count"] for r in got}
    assert n.get((False, True), 0) == 0 and n[True, True] > 300 and n[False, False] > 100, n
