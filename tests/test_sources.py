"""Files in and out, the sample corpus, settings."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom import config
from threadloom.operators import ingest
from threadloom.plans import pipeline as pl
from threadloom.sources import jsonl, sample


def test_line_numbers_over_splits(spark, tmp_path):
    """Numbers as by reading the files line by line, whatever the splits."""
    for k in range(3):
        (tmp_path / f"f{k}.jsonl").write_text("".join(json.dumps({"title": f"t{k}-{i}", "body": "x" * (i * 7 % 50)}) + "\n" + ("\n" if i % 5 == 0 else "") + ("{bad\n" if i % 7 == 3 else "") for i in range(60)))
    want = {}
    for k in range(3):
        for n, line in enumerate((tmp_path / f"f{k}.jsonl").read_text().split("\n"), 1):
            if line.startswith('{"'):
                want[json.loads(line)["title"]] = n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        got = {r["title"]: r["line_no"] for r in jsonl.read_jsonl(spark, str(tmp_path / "*.jsonl")).collect()}
        assert jsonl.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and jsonl.bad_lines(spark, str(tmp_path)).count() == 27


def test_sample_corpus(spark, tmp_path):
    n = sample.write(tmp_path / "s.jsonl")
    a = jsonl.read_jsonl(spark, str(tmp_path / "s.jsonl"))
    assert n == len(sample.records()) + 1 and a.count() == n - 1 and "why" not in a.columns and jsonl.bad_lines(spark, str(tmp_path / "s.jsonl")).first()["line_no"] == n
    s = {r["url"][-1] + r["status"]: 1 for r in ingest.with_status(a.withColumn("article_id", F.col("url")), ["line_no"]).collect()}
    assert set(s) == {"1kept", "1duplicate", "2kept", "3kept", "4kept", "5too_short", "6invalid"}


def test_gold_and_entities_files(spark, tmp_path):
    g = {"entities": {"_comment": "x", "Ana Moro": ["A. Moro", "Moro"]}, "articles": {"a": {"mentions": [{"sent": 0, "text": "Moro", "label": "PERSON"}], "coref_clusters": [[{"sent": 0, "text": "Moro"}, {"sent": 1, "text": "She"}]], "relations": [{"subject": "Moro", "predicate": "met", "object": "X"}], "entity_links": []}, "b": {}}}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    t = {k: sorted(tuple(r) for r in v.collect()) for k, v in jsonl.read_gold(spark, str(tmp_path / "g.json")).items()}
    assert t == {"mentions": [("a", 0, "Moro", "PERSON")], "clusters": [("a", 0, 0, "Moro"), ("a", 0, 1, "She")], "relations": [("a", "Moro", "met", "X")], "links": [], "aliases": [("Ana Moro", "A. Moro"), ("Ana Moro", "Moro")]}
    e = spark.createDataFrame([("e1", ["b", "a"], 0.123456)], "entity_id string, aliases array<string>, merge_confidence double")
    q = spark.createDataFrame([("l", "r", 0.45678, "why")], "left_profile string, right_profile string, score double, explanation string")
    jsonl.write_entities(e, q, str(tmp_path))
    assert spark.read.json(str(tmp_path / "entities.jsonl")).first()["aliases"] == ["a", "b"] and spark.read.json(str(tmp_path / "review_queue.jsonl")).first()["score"] == 0.457
    d = spark.createDataFrame([("a", "x", "no"), ("b", "y", None)], "article_id string, text string, text_sha256 string").withColumn("text_sha256", F.when(F.col("article_id") == "b", F.sha2("text", 256)).otherwise(F.col("text_sha256")))
    jsonl.write_jsonl(d, str(tmp_path / "docs"))
    assert {r["article_id"]: r["stale"] for r in jsonl.read_documents(spark, str(tmp_path / "docs"), "article_id string, text string, text_sha256 string").collect()} == {"a": True, "b": False}


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"pipeline": {"min_body": 50, "recognisers": ["gazetteer"], "max_block": None}, "other": 1}))
    (tmp_path / ".env").write_text("# comment\nTHREADLOOM__PIPELINE__MIN_BODY='70'\nTHREADLOOM__PIPELINE__CONTEXT=yes\n")
    c = config.load(pl.Config, tmp_path / "c.json", dotenv=tmp_path / ".env", env={"THREADLOOM__PIPELINE__MIN_SCORE": "0.5", "THREADLOOM__PIPELINE__MAX_BLOCK": "9", "OTHER": "1", "THREADLOOM__PIPELINE__RECOGNISERS": "names, gazetteer"})
    assert (c.min_body, c.context, c.min_score, c.max_block, c.recognisers, c.segmenter) == (70, True, 0.5, 9, ("names", "gazetteer"), "rules")
    assert config.load(pl.Config, tmp_path / "none.json", env={}) == pl.Config() and config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        config.load(pl.Config, env={"THREADLOOM__PIPELINE__NOTHING": "1"})
    with pytest.raises(ValueError):
        config.load(pl.Config, env={"THREADLOOM__PIPELINE__CONTEXT": "maybe"})
