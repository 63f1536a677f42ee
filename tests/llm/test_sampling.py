"""Samples of tables in which one content fills most rows."""

from __future__ import annotations

from collections import Counter

from polislake.llm import pii, url_filter
from polislake.llm.common import lowest


def test_url_sample_keeps_the_shares(spark):
    rows = spark.range(20000).selectExpr("if(id % 10 < 9, array('host:com', 'path0:hot'), array('host:org', concat('path0:', id % 70 div 10))) as _tokens", "if(id % 10 < 9, 'allow', 'block') as _label")
    got = Counter((tuple(r["_tokens"]), r["_label"]) for r in url_filter.sampled(rows, 1000).collect())
    assert got[("host:com", "path0:hot"), "allow"] == 900
    assert len(got) == 8 and 93 <= sum(got.values()) - 900 <= 107
    assert sorted(url_filter.sampled(rows, 20000).collect()) == sorted(rows.collect())
    rules = {tuple(r["tokens"]): r["verdict"] for r in url_filter.mine(rows, 0.01, 0.9, 1000).collect()}
    assert rules["host:org",] == "block" and rules["host:com",] == "allow"


def test_lowest_is_never_short(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 100 < 99, 0, id) as key")
    for key in ("key", "id"):
        for value in range(4):
            assert lowest(rows.selectExpr("id", f"{key} + {value} as k"), 20, "k").count() == 20
    assert lowest(rows.select("key"), 30, "key", distinct=True).count() == 30


def test_windows_of_one_content_do_not_fill_the_sample(spark, monkeypatch):
    """Thousands of copies of a text, under one id, none, or their own."""
    hot, seen = "Write to hot.1@mail1.example.com for it. " + "x" * 30, {}
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, ids, tags, epochs: seen.update(n=len({row.tobytes() for row in ids})) or self)
    rare = [(100000 + i, f"The office of {i} is at {i}.rare{i}@mail{i}.example.com, number {i} of all") for i in range(300)]
    for key in (7, None):
        docs = spark.createDataFrame([(key, hot)] * 3000 + rare, "doc_id bigint, text string")
        assert pii.train(docs, max_windows=40) is not None
        assert seen["n"] > 40
