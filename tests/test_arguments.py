"""Arguments, checks of clusters and relations, gold spans, stored tables."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import arguments, coref, evaluate, lookup, relations, resolution, store


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


TEXT = "Modi and Putin met. The two leaders spoke. He left. Nobody saw them."
MENTIONS = [("m1", "d", 0, 4, "Modi", "PERSON", 0), ("m2", "d", 9, 14, "Putin", "PERSON", 0), ("m3", "d", 52, 58, "Nobody", "MISC", 3)]
MEMBERS = [("d", "c0", 0, 14, "Modi and Putin", "NAMED", True, "m1"), ("d", "c0", 20, 35, "The two leaders", "NOMINAL", False, None), ("d", "c1", 9, 14, "Putin", "NAMED", True, "m2"), ("d", "c1", 43, 45, "He", "PRONOMINAL", False, None)]


@pytest.fixture(scope="module")
def tables(spark):
    m = spark.createDataFrame(MENTIONS, "mention_id string, article_id string, start int, end int, text string, label string, sentence_index int")
    c = spark.createDataFrame(MEMBERS, "article_id string, cluster_id string, start int, end int, text string, form string, is_representative boolean, mention_id string")
    d = spark.createDataFrame([("d", TEXT)], "article_id string, text string")
    s = spark.createDataFrame([("d", 0, 0, 19), ("d", 1, 20, 42), ("d", 2, 43, 51), ("d", 3, 52, 68)], "article_id string, idx int, start int, end int")
    return m, c, d, s


def test_resolved_arguments(spark, tables):
    m, c, _, _ = tables
    spans = [("named", "d", 0, 4, "Modi"), ("leaders", "d", 24, 27, "two"), ("he", "d", 43, 45, "He"), ("them", "d", 63, 67, "them"), ("nobody", "d", 52, 58, "Nobody"), ("none", "d", 36, 41, "spoke"), ("other", "e", 0, 4, "Modi")]
    p = spark.createDataFrame(spans, "key string, article_id string, start int, end int, text string")
    assert rows(arguments.resolve_arguments(p, m, c, "key"), "key", "mention_id", "via_coref") == [("he", "m2", True), ("leaders", "m1", True), ("leaders", "m2", True), ("named", "m1", False), ("nobody", "m3", False)]
    assert rows(arguments.covering_members(p, c, "key"), "key", "cluster_id") == [("he", "c1"), ("leaders", "c0"), ("named", "c0")]
    assert arguments.resolve_arguments(p.limit(0), m, c, "key").count() == 0


def test_problems_are_found(spark, tables):
    m, c, d, s = tables
    assert coref.cluster_problems(c, d, "article_id", "text").count() == 0
    bad = c.where("cluster_id = 'c0'").limit(1).withColumns({"end": F.lit(99)}).unionByName(c.where("cluster_id = 'c1'").withColumn("text", F.lit("x")))
    assert rows(coref.cluster_problems(bad, d, "article_id", "text")) == [("c0", "one span"), ("c0", "outside the text"), ("c1", "text differs"), ("c1", "text differs")]
    r = spark.createDataFrame([("r1", "d", "m1", "m2"), ("r2", "d", "m1", "gone"), ("r3", "d", "lost", "m1")], "relation_id string, article_id string, subject_id string, object_id string")
    e = relations.with_evidence(r, m, s)
    assert rows(e, "relation_id", "evidence_start", "evidence_end") == [("r1", 0, 19), ("r2", 0, 19), ("r3", -1, -1)]
    assert rows(relations.relation_problems(e.withColumn("evidence_end", F.when(F.col("relation_id") == "r1", 999).otherwise(F.col("evidence_end"))), m, d)) == [("r1", "evidence outside the text"), ("r2", "object is no mention"), ("r3", "subject is no mention")]
    st = coref.cluster_stats(c).first()
    assert (st["clusters"], st["members"], st["named"], st["nominal"], st["pronouns_resolved"], st["linked"]) == (2, 4, 2, 1, 1, 2)


def test_gold_spans(spark, tables):
    _, _, d, s = tables
    g = spark.createDataFrame([("d", 1, "two", "X"), ("d", 0, "two", "X"), ("d", 9, "two", "X"), ("d", 0, "Putin", "PERSON")], "article_id string, sent int, text string, label string")
    got = evaluate.gold_spans(g, d, s)
    assert rows(got.where("start is not null"), "text", "start", "end") == [("Putin", 9, 14), ("two", 24, 27)] and evaluate.unresolved_gold(got).count() == 2


def test_pair_examples_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(4):
        a = {f"{i:02d}": rng.randint(0, 2) for i in range(25)}
        b = {f"{i:02d}": rng.choice([0, 0, 0, 0, 1]) for i in range(25)}
        want = [(x, y) for x, y in itertools.combinations(sorted(a), 2) if a[x] == a[y] and b[x] != b[y]][:5]
        df = lambda d: spark.createDataFrame(list(d.items()), "item string, cluster int")
        assert rows(evaluate.pair_examples(df(a), df(b))) == want


def test_stored_tables(spark):
    e = spark.createDataFrame([("r1", "PERSON", "Ana Moro", "ana moro", 2, ["Ana Moro", "A. Moro"], ["d:0-4:PERSON", "e:1-3:PERSON"], 0.8, ["mayor"], ["India"]), ("r2", "ORG", "Kelvar", "kelvar", 3, ["Kelvar"], ["d:7-9:ORG"], 1.0, [], []), ("r3", "ORG", "Abel", "abel", 2, ["Abel"], ["d:1-2:ORG"], 1.0, [], [])], "root string, entity_type string, canonical_name string, normalized string, profiles int, surfaces array<string>, mention_ids array<string>, merge_confidence double, roles array<string>, countries array<string>")
    n = resolution.numbered_entities(e)
    assert rows(n, "entity_id", "canonical_name") == [("ORG_00000", "Kelvar"), ("ORG_00001", "Abel"), ("PERSON_00002", "Ana Moro")]
    t = store.entity_tables(n, {"roles": "role", "countries": "country"})
    assert rows(t["entity_aliases"], "alias", "normalized") == [("A. Moro", "a moro"), ("Abel", "abel"), ("Ana Moro", "ana moro"), ("Kelvar", "kelvar")]
    assert rows(t["entity_attributes"], "attr_type", "value") == [("country", "India"), ("role", "mayor")] and rows(t["entity_mentions"], "article_id", "method")[0] == ("d", "entity_resolution_v1")
    p = spark.createDataFrame([("a", "b", 0.4, "why", "review"), ("a", "c", 0.5, "why", "review")], "left_id string, right_id string, score double, reason string, decision string")
    q = store.upsert_reviews(None, p)
    done = q.withColumn("status", F.when(F.col("right_profile") == "b", "merged").otherwise("pending"))
    again = store.upsert_reviews(done, p.where("right_id = 'b'").withColumn("score", F.lit(0.45)))
    assert rows(again, "right_profile", "score", "status") == [("b", 0.45, "merged"), ("c", 0.5, "pending")]
    prof = spark.createDataFrame([("a", "Ana Moro", ["mayor", "envoy"])], "profile_id string, canonical_surface string, roles array<string>")
    assert rows(lookup.review_rows(p, prof), "right_name", "left_name", "left_roles") == [("b", "Ana Moro", "envoy, mayor"), ("c", "Ana Moro", "envoy, mayor")]
    shown = lookup.entity_rows(n.withColumn("article_count", F.lit(1)), t["entity_aliases"], t["entity_attributes"], "PERSON").first()
    assert shown["aliases"] == "A. Moro, Ana Moro" and shown["roles"] == "mayor" and shown["countries"] == "India"


def test_contexts(spark, tables):
    m, _, d, s = tables
    p = spark.createDataFrame([("p1", ["m1", "m3"]), ("p2", ["m2"])], "profile_id string, mention_ids array<string>")
    assert rows(resolution.profile_contexts(p, m, s, d)) == [("p1", "Modi and Putin met. Nobody saw them."), ("p2", "Modi and Putin met.")]
    v = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0])], "profile_id string, embedding array<double>")
    pairs = spark.createDataFrame([("p1", "p2"), ("p1", "p9"), ("p1", "p1")], "left_id string, right_id string")
    assert rows(resolution.context_similarity(pairs, v), "right_id", F.round("raw", 3).alias("raw"))[0] == ("p1", 1.0)
