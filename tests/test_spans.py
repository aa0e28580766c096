from pyspark.sql import functions as F

from threadloom.operators import coref, mentions, relations, spans

MENTION = "mention_id string, article_id string, start int, end int, text string, label string, raw_label string, score double, sentence_index int, extractor string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merge_keeps_one_of_each_chain(spark):
    m = spark.createDataFrame(
        [
            ("a", "d", 0, 10, "x", "ORG", "", 0.9, 0, "spacy"), ("b", "d", 5, 12, "x", "PERSON", "", 0.5, 0, "transformer"), ("c", "d", 11, 20, "x", "MISC", "", 0.9, 0, "spacy"), ("e", "d", 20, 25, "x", "COUNTRY", "", 0.9, 0, "gazetteer"),
            ("f", "d", 20, 25, "x", "LOCATION", "", 0.9, 0, "spacy"),
        ],
        MENTION,
    )
    got = mentions.merge_mentions(m)
    assert rows(got.where("is_winner"), "mention_id", "island") == [("b", 1), ("e", 2)]
    assert rows(mentions.merge_stats(got), "extractor", "mentions_in", "won", "lost") == [("gazetteer", 1, 1, 0), ("spacy", 3, 0, 3), ("transformer", 1, 1, 0)]


def test_range_joins(spark):
    s = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 6, 10)], "doc string, idx int, start int, end int")
    p = spark.createDataFrame([("d", 3), ("d", 5), ("d", 9), ("z", 1)], "doc string, at int")
    assert rows(spans.covering_sentence(p, s, "doc", "at"), "doc", "at", "sentence_index") == [("d", 3, 0), ("d", 5, -1), ("d", 9, 1), ("z", 1, -1)]
    a = spark.createDataFrame([("d", 0, 10), ("d", 20, 30)], "doc string, start int, end int")
    b = spark.createDataFrame([("d", 8, 12), ("d", 2, 7), ("d", 4, 9)], "doc string, start int, end int")
    assert rows(spans.best_overlap(a, b, "doc", ["start"]), "start", "start2", "overlap") == [(0, 2, 5)]
    assert rows(spans.uncovered(b, a, "doc"), "start") == [(8,)]
    t = spark.createDataFrame([("d", "abcdefghij")], "doc string, text string")
    assert spans.sentence_problems(s, t, "doc", "text").count() == 0
    bad = spark.createDataFrame([("d", 0, 0, 5), ("d", 2, 4, 99)], "doc string, idx int, start int, end int")
    assert {r["problem"] for r in spans.sentence_problems(bad, t, "doc", "text").collect()} == {"outside the text", "overlaps the one before", "out of sequence"}
    m = spark.createDataFrame([("d", 0, 3, "abc"), ("d", 3, 5, "xx")], "doc string, start int, end int, surface string")
    assert rows(spans.drifted(m, t, "doc", "text", "surface"), "start", "now") == [(3, "de")]


def test_coreference_rules(spark):
    m = spark.createDataFrame(
        [
            ("m1", "d", 0, 13, "Narendra Modi", "PERSON", "", 1.0, 0, "x"), ("m2", "d", 30, 34, "Modi", "PERSON", "", 1.0, 1, "x"), ("m3", "d", 40, 45, "Putin", "PERSON", "", 1.0, 1, "x"), ("m4", "d", 90, 98, "Mr. Modi", "PERSON", "", 1.0, 5, "x"),
            ("m5", "d", 110, 120, "State Bank", "ORG", "", 1.0, 5, "x"), ("m6", "d", 130, 134, "Bank", "ORG", "", 1.0, 5, "x"),
        ],
        MENTION,
    )
    p = spark.createDataFrame([("d", 50, 52, "he", "M", True, 1), ("d", 55, 58, "she", "F", True, 1), ("d", 80, 82, "he", "M", True, 4)], "article_id string, start int, end int, text string, gender string, wants_person boolean, sentence_index int")
    got = coref.rule_clusters(m, p)
    clusters = {}
    for r in got.collect():
        clusters.setdefault(r["cluster_id"], []).append((r["text"], r["is_representative"]))
    assert {k: sorted(v) for k, v in clusters.items()} == {"d:coref000": [("Modi", False), ("Mr. Modi", False), ("Narendra Modi", True)], "d:coref001": [("Putin", True), ("he", False)]}
    al = coref.align_to_mentions(spark.createDataFrame([("d", 0, 20)], "article_id string, start int, end int"), m, "article_id", ["start"])
    assert rows(al, "ner_mention_id") == [("m1",)]
    d = spark.createDataFrame([("d", "He and the herd saw her.")], "article_id string, text string")
    s = spark.createDataFrame([("d", 0, 0, 24)], "article_id string, idx int, start int, end int")
    assert rows(coref.pronoun_spans(d, m.limit(0), s, "article_id", "text"), "text", "start", "gender") == [("He", 0, "M"), ("her", 20, "F")]


def test_pattern_relations(spark):
    text = "Indian Prime Minister Narendra Modi met. Tata, chairman of Reliance spoke."
    at = lambda s: (text.index(s), text.index(s) + len(s))
    data = [("a", "Indian", "MISC", "GAZ_DEMONYM:India", 0), ("b", "Prime Minister", "ROLE", "", 0), ("c", "Narendra Modi", "PERSON", "", 0), ("e", "Tata", "PERSON", "", 1), ("f", "chairman", "ROLE", "", 1), ("g", "Reliance", "ORG", "", 1)]
    m = spark.createDataFrame([(i, "d", *at(t), t, l, r, 1.0, s, "x") for i, t, l, r, s in data], MENTION)
    g = relations.with_gaps(m, spark.createDataFrame([("d", text)], "doc string, body string").withColumnRenamed("doc", "article_id"), "article_id", "body")
    r = relations.pattern_relations(g, F.col("gap"))
    assert rows(r, "subject_text", "predicate", "object_text", "confidence") == [
        ("Narendra Modi", "holds_position", "Prime Minister", 0.9), ("Narendra Modi", "represents", "India", 0.9), ("Tata", "holds_position", "chairman", 0.78), ("Tata", "works_for", "Reliance", 0.85),
    ]
    twice = r.unionByName(r.withColumns({"confidence": F.lit(0.5), "relation_id": F.lit("rel_0")}))
    assert {x["evidence_count"] for x in relations.deduplicate(twice).collect()} == {2} and relations.deduplicate(twice).where("confidence = 0.5").count() == 0
    members = spark.createDataFrame([("k", "c", True), ("k", "f", False)], "cluster_id string, mention_id string, is_representative boolean")
    assert rows(relations.coref_role_relations(m, members), "subject_text", "object_text") == [("Narendra Modi", "chairman")]


def test_verb_frames(spark):
    # "Modi and Putin may meet Xi and Lula" / "Xi was met by Modi" / "Modi did not meet Xi" / "hold talks with Xi"
    def doc(d, *tokens):
        return [(d, i, *t) for i, t in enumerate(tokens)]

    t = spark.createDataFrame(
        doc("1", ("Modi", "PROPN", "nsubj", 4), ("and", "CC", "cc", 0), ("Putin", "PROPN", "conj", 0), ("may", "AUX", "aux", 4), ("meet", "VERB", "ROOT", 4), ("Xi", "PROPN", "dobj", 4), ("Lula", "PROPN", "conj", 5))
        + doc("2", ("Xi", "PROPN", "nsubjpass", 2), ("be", "AUX", "auxpass", 2), ("meet", "VERB", "ROOT", 2), ("by", "ADP", "agent", 2), ("Modi", "PROPN", "pobj", 3))
        + doc("3", ("Modi", "PROPN", "nsubj", 2), ("not", "PART", "neg", 2), ("meet", "VERB", "ROOT", 2), ("Xi", "PROPN", "dobj", 2))
        + doc("4", ("Modi", "PROPN", "nsubj", 1), ("hold", "VERB", "ROOT", 1), ("talk", "NOUN", "dobj", 1), ("with", "ADP", "prep", 1), ("Xi", "PROPN", "pobj", 3)),
        "article_id string, i int, lemma string, pos string, dep string, head int",
    )
    got = {(r["article_id"], r["predicate"], r["subject"], r["object"]): round(r["confidence"], 4) for r in relations.dependency_frames(t).collect()}
    assert got == {("1", "met", s, o): 0.525 for s in (0, 2) for o in (5, 6)} | {("2", "met", 4, 0): 0.75, ("4", "met", 0, 2): 0.75, ("4", "met", 0, 4): 0.65}


def test_long_chain_of_conjuncts(spark):
    from threadloom.operators.relations import dependency_frames

    rows = [("d", 0, "Ana", "PROPN", "nsubj", 1), ("d", 1, "meet", "VERB", "ROOT", 1), ("d", 2, "p2", "PROPN", "dobj", 1)] + [("d", k, f"p{k}", "PROPN", "conj", k - 1) for k in range(3, 40)]
    got = dependency_frames(spark.createDataFrame(rows, "article_id string, i int, lemma string, pos string, dep string, head int")).collect()
    assert sorted(r["object"] for r in got) == list(range(2, 40))
