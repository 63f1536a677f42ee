"""The pipeline against brute force of its stages, each on its own input."""

from __future__ import annotations

from llm.helpers import counts, drop_lines, near_components

import corpus_pipeline
from polislake.llm.common import stored, table
from polislake.llm.decontaminate import fold

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    items = [fold(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        docs = stored(stage(spark, docs, SF), name)
        if name == "pack":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = texts(docs)
        if name == "quality_rules":
            failed = {d for d, t in before.items() if (c := counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not failed & set(after) and len(after) > 0.5 * len(before)
        elif name == "line_dedup":
            assert after == dict(drop_lines(sorted(before.items())))
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_dedup":
            assert set(after) == set(near_components(sorted(before.items()), 5, 80).values())
        elif name == "decontaminate":
            leaked = {d for d, t in before.items() if any(i in fold(t) for i in items)}
            assert not leaked & set(after) and set(before) - set(after) >= leaked


def test_run_has_the_rows_of_the_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*columns, "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r)[:5] for r in docs.collect())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
