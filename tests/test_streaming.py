"""Sweep state against a plain fold, streams against batches, files read back."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from polislake.sources import readers
from polislake.streaming import ingest, sweep

LOG = "seq long, source_name string, stream_name string, action string, pages_attempted long, seen long, created long, updated long, failed long, end_reached boolean, advance boolean, source_total long, error string"


def fold(rows):
    state = {}
    for r in sorted(rows, key=lambda r: r[0]):
        _, src, stream, action, pages, seen, created, updated, failed, end, adv, total, err = r
        s = state.setdefault((src, stream), dict(page=0, seen=0, created=0, updated=0, failed=0, sweeps=0, total=None, status=None, error=None))
        if action == "reset":
            s.update(page=0, seen=0, created=0, updated=0, failed=0, sweeps=0, status="reset", error=None)
        elif action == "fail":
            s["failed"] += 1
            s["status"], s["error"] = "failed", err or ""
            s["page"] += 1 if adv else 0
        else:
            s["seen"] += seen
            s["created"] += created
            s["updated"] += updated
            s["failed"] += failed
            s["total"] = total if total is not None else s["total"]
            s["error"] = err
            if not adv:
                s["status"] = "completed_no_advance"
            elif end:
                s["page"], s["status"] = 0, "completed_end_of_source"
                s["sweeps"] += 1
            else:
                s["page"] += pages
                s["status"] = "completed"
    return state


def test_replay_equals_fold(spark):
    rnd = random.Random(7)
    rows = [
        (i, "s", f"t{0 if rnd.random() < 0.6 else rnd.randrange(4)}", rnd.choice(["complete"] * 6 + ["fail", "reset"]), rnd.randrange(1, 5), rnd.randrange(50), rnd.randrange(9), rnd.randrange(9), rnd.randrange(3),
         rnd.random() < 0.2, rnd.random() < 0.8, rnd.choice([None, rnd.randrange(100)]), rnd.choice([None, "bad"]))
        for i in range(400)
    ]
    got = {(r["source_name"], r["stream_name"]): r for r in sweep.replay(spark.createDataFrame(rows, LOG)).collect()}
    want = fold(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g["page_number"], g["total_seen"], g["total_created"], g["total_updated"], g["total_failed"], g["sweeps_completed"], g["source_total"], g["last_status"], g["last_error"]) == (
            w["page"], w["seen"], w["created"], w["updated"], w["failed"], w["sweeps"], w["total"], w["status"], w["error"])


def test_step_by_step_equals_replay(spark):
    states = sweep.new_states(spark.createDataFrame([("s", "t")], "source_name string, stream_name string"), spark.createDataFrame([], "source_name string, stream_name string, page_number long, total_seen long, total_created long, total_updated long, total_failed long, sweeps_completed long, source_total long, last_status string, last_error string"))
    run = spark.createDataFrame([("s", "t", 3, 10, 1, 2, 0, False, True, 99, None)], "source_name string, stream_name string, pages_attempted long, seen long, created long, updated long, failed long, end_reached boolean, advance boolean, source_total long, error string")
    after = sweep.fail(sweep.complete(states, run), spark.createDataFrame([("s", "t", "x" * 3000, False)], "source_name string, stream_name string, error string, advance boolean"), error_length=2000)
    r = after.first()
    assert (r["page_number"], r["total_seen"], r["total_failed"], r["source_total"], r["last_status"], len(r["last_error"])) == (3, 10, 1, 99, "failed", 2000)
    with pytest.raises(ValueError):
        sweep.plan_runs(after, 0)


def test_stream_twice_is_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    src = f"{folder}/in"
    spark.createDataFrame([(1, "a", 5), (2, "", 6), (1, "b", 7)], "k int, t string, n int").write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, t string, n int").parquet(src)
    for run in "ab":
        ingest.write_changes(stream(), lambda d: d, ["k"], [F.desc("n")], f"{folder}/out", f"{folder}/cp-{run}", valid=F.col("t") != "").awaitTermination()
    got = ingest.current_rows(spark.read.parquet(f"{folder}/out/records"), ["k"], {"t": "keep_if_null_new", "n": "greatest"})
    assert [tuple(r) for r in got.select("k", "t", "n").collect()] == [(1, "b", 7)]
    assert spark.read.parquet(f"{folder}/out/rejects").count() == 1


def test_column_rules_over_batches(spark):
    rows = [(1, 0, "a", None, 3), (1, 1, "", "x", 9), (1, 2, "c", "y", 4)]
    df = spark.createDataFrame(rows, "k int, batch_id int, keep string, fill string, top int")
    r = ingest.current_rows(df, ["k"], {"keep": "keep_if_null_new", "fill": "fill_if_null_old", "top": "greatest"}).first()
    assert (r["keep"], r["fill"], r["top"]) == ("c", "x", 9)


def test_csv_rows_are_numbered_and_checked(spark):
    from polislake.operators import votes

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    head = "Contest_ID,Contest_Name,Province_ID,Province_Name,Party_ID,Party_Name,Candidate_ID,Candidate_Name,Votes"
    with open(f"{folder}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write(head + "\nC1,Contest,P1,Prov,P001,One,,,100\nC1,Contest,P1,Prov,P002,Two,,,\"1,250\"\nC1,Contest,P1,Prov,P003,Three,,,not-a-number\n")
    rows = readers.read_vote_csv(spark, f"{folder}/a.csv")
    renamed = rows.select("row_number", F.lit("m").alias("manifest_key"), *[F.col(c).alias(c.lower()) for c in head.split(",")])
    got = {r["row_number"]: (r["vote_total"], r["failure"]) for r in votes.validate(renamed).collect()}
    assert got == {2: (100, None), 3: (1250, None), 4: (None, "Votes must be a non-negative integer")}
    with open(f"{folder}/b.csv", "w") as f:
        f.write("Contest_ID\n1\n")
    with pytest.raises(ValueError, match="MissingColumns"):
        readers.read_vote_csv(spark, f"{folder}/b.csv")


def test_url_lists(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/u.txt", "w") as f:
        f.write("# head\n\n https://b \nhttps://a\n")
    found = readers.read_url_list(spark, f"{folder}/u.txt")
    merged = readers.merged_urls(found, spark.createDataFrame([("https://a",), ("https://c",)], "url string"))
    assert [r["url"] for r in merged.collect()] == ["https://a", "https://b", "https://c"]
    readers.write_url_list(merged, f"{folder}/out")
    assert spark.read.text(f"{folder}/out").count() == 3


def test_streams_over_a_folder_and_an_empty_backlog(spark, tmp_path):
    """The registered streams on tables of three files, and on tables without rows."""
    import shutil

    import __spark_entry__ as entry

    small = "/root/testdata/sf0.001"
    names = ["ST06_stream_ingest", "ST07_idempotent_reingest", "ST08_stream_dedup", "ST09_run_life_cycle_stream", "ST10_failure_rates_stream"]
    for kind in ("split", "empty"):
        folder = tmp_path / kind
        folder.mkdir()
        for table in ("orders", "events"):
            rows = spark.read.parquet(f"{small}/{table}.parquet")
            (rows.repartition(3) if kind == "split" else rows.limit(0)).write.parquet(str(folder / f"{table}.parquet"))
        for table in ("customer", "supplier", "part", "lineitem", "nation", "region", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
            shutil.copy(f"{small}/{table}.parquet", folder / f"{table}.parquet")
        for name in names:
            got = sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()), key=str)
            if kind == "split":
                assert got == sorted(map(tuple, entry.queries()[name](spark, small).collect()), key=str), name
            else:
                assert got in ([], [(0,)]), name


def test_compaction_and_dedup_on_read(spark):
    from polislake.streaming import ingest

    rows = [(k, b, f"t{k}{b}" if (k + b) % 3 else None, k * b) for k in range(4) for b in range(5) if (k + b) % 4]
    changes = spark.createDataFrame(rows, "k int, batch_id int, t string, n int")
    rules = {"t": "keep_if_null_new", "n": "greatest"}
    want = sorted(map(tuple, ingest.current_rows(changes, ["k"], rules).collect()))
    assert sorted(map(tuple, ingest.current_rows(ingest.compacted(changes, ["k"], rules, 2), ["k"], rules).collect())) == want
    assert ingest.deduplicated(changes, ["k"]).count() == 4


def test_merge_with_a_hot_null_key(spark):
    from polislake.operators.merge import merge_upsert

    old = spark.createDataFrame([(None, i) for i in range(50)] + [(i, i) for i in range(100)], "k int, v int")
    new = spark.createDataFrame([(None, 7), (5, 8), (500, 9)], "k int, v int")
    got = [tuple(r) for r in merge_upsert(old, new, ["k"], {}).collect()]
    assert len(got) == 151 and got.count((None, 7, "updated")) == 50 and (5, 8, "updated") in got and (500, 9, "created") in got


def test_stuck_runs_of_a_log_in_three_files(spark, tmp_path):
    from polislake.streaming import ingest, runs

    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    log = []
    for run in range(30):
        log.append((run, "start", 5 * run))
        if run % 3:
            log.append((run, "finish", 5 * run + (10 if run % 3 == 1 else 30)))
    log += [(1000, "start", 600), (1000, "finish", 601), (1001, "progress", 602)]
    log.sort(key=lambda e: e[2])
    for i in range(3):
        part = log[i * len(log) // 3 : (i + 1) * len(log) // 3]
        spark.createDataFrame([(r, k, hour(h)) for r, k, h in part], "run_id int, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema = "run_id int, kind string, ts timestamp"
    whole = runs.stuck(spark.read.schema(schema).parquet(str(tmp_path / "log")), 24)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    ingest.write_batches(runs.stuck(stream, 24, "2 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    want = {r for r in range(30) if r % 3 != 1}
    assert {r["run_id"] for r in whole.collect()} == want
    got = [r["run_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want)
