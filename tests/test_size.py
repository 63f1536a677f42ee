"""What must hold at size: bounded broadcasts, hot names, compact files, repeated keys."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from polislake import session
from polislake.operators import evidence, linking, mentions, resolve, votes
from polislake.operators.buckets import BucketedTable, snapshot_changes
from polislake.plans.bindings import Tables

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_a_smaller_broadcast_threshold_stays_and_a_larger_one_is_lowered(spark):
    before = spark.conf.get(BROADCAST)
    try:
        for named, held in (("256k", "256k"), ("-1", "-1"), ("32m", str(session.BROADCAST)), ("33554432b", str(session.BROADCAST))):
            spark.conf.set(BROADCAST, named)
            session.configure(spark)
            assert spark.conf.get(BROADCAST) == held
    finally:
        spark.conf.set(BROADCAST, before)


def test_the_default_broadcast_threshold_is_lowered_where_a_session_names_none(spark):
    before = spark.conf.get(BROADCAST)
    try:
        spark.conf.unset(BROADCAST)
        session.configure(spark)
        assert spark.conf.get(BROADCAST) == str(session.BROADCAST)
    finally:
        spark.conf.set(BROADCAST, before)


def test_a_small_file_whose_rows_multiply_is_not_broadcast_by_its_size(spark, tmp_path):
    spark.range(20000).coalesce(1).select("id", F.concat(F.lit("part "), "id").alias("name")).write.parquet(str(tmp_path / "part.parquet"))
    words = spark.read.parquet(str(tmp_path / "part.parquet")).select("id", F.explode(F.split(F.repeat(F.concat("name", F.lit(" ")), F.lit(50)), " ")).alias("word"))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        session.configure(spark)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        met = spark.range(1 << 30).select(F.col("id").cast("string").alias("word")).join(words, "word")
        assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_a_name_of_all_rows_is_dealt_to_many_tasks(spark):
    facts = spark.range(4000).select("id", F.expr("case when id % 50 = 0 then null when id % 10 = 0 then concat('n', id) else 'staff' end").alias("name"))
    found = spark.createDataFrame([("staff", 1), ("n10", 2), ("n999999", 3)], "name string, person_id long")
    held = {k: spark.conf.get(k) for k in (BROADCAST, "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set(BROADCAST, "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = resolve.with_found(facts, resolve.counted(facts, "name"), found, "name")
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
        want = facts.join(found, "name", "left").select("id", "name", "person_id")
        assert sorted(map(str, out.select("id", "name", "person_id").collect())) == sorted(map(str, want.collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_people_of_one_file_are_spread_before_their_names_multiply(spark):
    people = spark.range(2000).coalesce(1).select("id", *[F.concat(F.lit("Ann B"), "id").alias(c) for c in ("full_name", "display_name", "slug")])
    per_task = resolve.alias_table(people).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("p"))
    assert per_task.agg(F.max("p")).first()[0] < 2000


def test_snapshots_that_repeat_a_key(spark, tmp_path):
    schema = "id long, v string"
    a = BucketedTable(spark, str(tmp_path / "a"), ("id",), 4).create(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], schema))
    b = BucketedTable(spark, str(tmp_path / "b"), ("id",), 4).create(spark.createDataFrame([(1, "p"), (1, "x"), (1, "q"), (2, "y"), (4, "w"), (None, "m")], schema))
    got = sorted(map(str, (tuple(r) for r in snapshot_changes(a, b).collect())))
    assert got == sorted(map(str, [(1, "changed"), (1, "changed"), (3, "removed"), (4, "added"), (None, "changed")]))


def test_shifted_ids_that_meet_stored_ones(spark, tmp_path):
    rows = spark.range(0, 1000120, 1, 4).where("id < 200 or id >= 999990").select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"),
        F.element_at(F.array(*map(F.lit, ("STANDARD", "SMALL", "MEDIUM"))), (F.col("id") % 3 + 1).cast("int")).alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") / 7).alias("p_retailprice"))
    rows.write.parquet(str(tmp_path / "part.parquet"))
    for name in ("X04_snapshot_changes", "U01_bucketed_upsert"):
        same_as_sql(spark, tmp_path, name, ["part"])


def test_the_first_of_rows_with_one_id_is_the_first_in_the_file(spark, tmp_path):
    i = F.col("id")
    lines = spark.range(3000).coalesce(1).select(
        (i * 7 % 40).alias("l_orderkey"), (i * 13 % 9 * 11 + 9).alias("l_partkey"), (i * 31 % 17).alias("l_suppkey"), (i % 7 + 1).cast("int").alias("l_linenumber"), (i * 17 % 50 + 1).cast("double").alias("l_quantity"),
        F.element_at(F.array(*map(F.lit, "ANR")), (i * 5 % 3 + 1).cast("int")).alias("l_returnflag"), F.element_at(F.array(*map(F.lit, "FO")), (i % 2 + 1).cast("int")).alias("l_linestatus"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("l_shipdate"))
    # Later rows first, so that the order of the file is none that a sort by its columns gives.
    lines.orderBy(F.sha2(F.concat_ws(",", *lines.columns), 256)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).select(i.alias("o_orderkey"), (i * 3 % 25).alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("U11_attendance_upsert", "U13_vote_total_upsert"):
        same_as_sql(spark, tmp_path, name, ["lineitem", "orders"])


def test_pages_of_one_small_file_are_built_by_many_tasks(spark, tmp_path):
    spark.range(2000).coalesce(1).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    pages = Tables(spark, str(tmp_path)).profile_pages
    assert pages.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000


def test_runs_of_all_texts_stay_where_they_are_read(spark):
    texts = spark.range(3000).select("id", F.concat(F.lit("the chair of the house met "), F.when(F.col("id") % 3 == 0, "Ann Bo").otherwise("Staff")).alias("body"))
    keys = spark.createDataFrame([("ann bo",), ("staff",), ("of the moon",)], "_key string")
    held = {k: spark.conf.get(k) for k in (BROADCAST, "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set(BROADCAST, "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        toks = texts.select(F.col("id").alias("_tid"), F.posexplode(F.split(F.lower("body"), r"\b")).alias("_pos", "_run"))
        ways = spark.createDataFrame([("staff", [(0, 1)]), ("ann", [(0, 3)])], "_run string, _ways array<struct<o:int,n:int>>")
        met = mentions._anchored(toks, toks.groupBy("_run").agg(F.count("*").alias("_n")), ways)
        assert met.groupBy("_run").count().orderBy("_run").collect() == [("ann", 1000), ("staff", 2000)]
        assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
        hits = mentions.word_hits(texts, "id", "body", keys).groupBy("_key", "_at").count()
        assert sorted(map(tuple, hits.collect())) == [("ann bo", 27, 1000), ("staff", 27, 2000)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_best_evidence_reads_a_spelling_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(evidence, "merge_party_members", lambda rows, keys: given.append(rows) or rows.withColumn("key", F.lit("")))
    entry.queries()["D08_best_evidence"](spark, "/root/testdata/sf0.001")
    rows = given[0]
    assert rows.count() == rows.select("name", "evidence").distinct().count()


def test_hits_of_a_term_search_are_stored(spark):
    corpus = spark.createDataFrame([(1, "water budget"), (2, "health"), (3, "the water and budget vote")], "id long, body string")
    hits = evidence.term_hits(corpus, "id", ["body"], spark.createDataFrame([(7, "water"), (7, "budget vote"), (8, "heal")], "question_id long, term string"))
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == [("budget vote", 3, False), ("heal", 2, False), ("water", 1, True), ("water", 3, True)]


def test_a_result_row_is_cleaned_once(spark):
    rows = spark.createDataFrame([("m", " c ", "C", "1", "P", " 1,0 ", None), ("m", "c", "C", "1", " ", "5", "x"), ("m", "c", "C", "1", "p", "-5", " "), ("m", "c", "C", "1", "p", "99999999999999999999", "x")],
                                 "manifest_key string, contest_id string, contest_name string, province_id string, party_id string, votes string, candidate_id string")
    checked = votes.validate(rows)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and "regexp_replace" not in plan
    bad = "Votes must be a non-negative integer"
    assert [tuple(r) for r in checked.select("contest_id", "party_id", "candidate_id", "failure", "vote_total").collect()] == [
        ("c", "P", None, None, 10), ("c", None, "x", "Contest_ID and Party_ID are required", None), ("c", "p", None, bad, None), ("c", "p", "x", bad, None)]


def test_rows_and_identifiers_of_a_report_are_counted_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "a", "P", "Party", None, None, 5), (2, "a", "P", "Party", None, "Cand", 6), (3, "b", "P", None, "C", "Cand", 7), (4, None, "P", "Party", None, None, None)],
                                 "row_number int, contest_id string, party_id string, party_name string, candidate_id string, candidate_name string, vote_total long").withColumns(
        {"failure": F.when(F.col("contest_id").isNull(), "bad"), "manifest_key": F.lit("m"), "province_id": F.lit("1"), "province_name": F.lit("N"), "contest_name": F.lit("x"), "votes": F.lit("1")})
    stored = votes.keyed_totals(rows).where("row_number = 1").select("result_key")
    report = votes.ingest_report(rows, stored)
    assert [tuple(r) for r in report.collect()] == [(4, 3, 1, 1, 1, 18, 2, 2, 0)]
    # Rows, stored keys and counted parts: three readings of the input.
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    assert [tuple(r) for r in votes.ingest_report(rows.limit(0), stored.limit(0)).collect()] == [(0, 0, 0, 0, 0, 0, 0, 0, 1)]


def test_a_spelling_is_made_readable_once_not_for_each_row(spark):
    att = spark.range(300).select(F.element_at(F.array(*map(F.lit, ("Mr Ann Bo", "Bo, Ms Ann", "  ", " ", "Staff"))), (F.col("id") % 5 + 1).cast("int")).alias("name_raw"), F.concat(F.lit("u"), "id").alias("source_url"), F.lit(3).alias("party_id"))
    att = att.unionByName(spark.createDataFrame([(None, "x", 9)], "name_raw string, source_url string, party_id int"))
    asks = spark.createDataFrame([("Cy Dee", "v"), (" ", "w"), (None, "w")], "asked_by_name string, source_url string")
    hints = linking.people_hints(att, asks)
    plan = hints._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and plan.count("Aggregate") == 1  # only the stored spellings are read
    assert sorted(map(tuple, hints.collect())) == [("ann-bo", "Ann Bo", "Ann Bo", "u1", 3), ("cy-dee", "Cy Dee", "Cy Dee", "v", None)]


def test_actions_read_the_domains_once(spark):
    plan = entry.queries()["R06_actions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan  # only the stored rows of domains and risks


def test_members_of_a_page_are_extracted_once(spark, tmp_path, monkeypatch):
    spark.range(30).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(10).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(1).alias("c_nationkey"), F.lit(0.5).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    looked_up, resolved = [], resolve.resolve
    monkeypatch.setattr(resolve, "resolve", lambda facts, *more: looked_up.append(facts) or resolved(facts, *more))
    same_as_sql(spark, tmp_path, "E22_committee_page_ingest", ["orders", "customer"])
    assert "Generate" not in looked_up[0]._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_are_cut_only_where_they_are_shown(spark, tmp_path):
    spark.createDataFrame([(1, "Ann Bo.\nx"), (2, "Cy"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "then ANN BO met cy, Ann Bo"), (8, "Anne Bo; Cyx"), (9, None), (10, "cy")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same_as_sql(spark, tmp_path, "E10_mentions_in_documents", ["benchmark", "documents"])
    plan = entry.queries()["E10_mentions_in_documents"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "..." not in plan


def test_a_place_in_a_long_text_does_not_copy_its_runs(spark):
    texts = spark.createDataFrame([(1, "x y " * 500 + "Ann Bo")], "id long, body string")
    hits = mentions.word_hits(texts, "id", "body", spark.createDataFrame([("ann bo",), ("x y",)], "_key string"), shown=False)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "aggregate(" not in plan
    assert sorted(map(tuple, hits.groupBy("_tid", "_key").count().collect())) == [(1, "ann bo", 1), (1, "x y", 500)]


def test_few_words_looked_for_leave_the_runs_where_they_are_read(spark):
    corpus = spark.range(2000).select("id", F.concat(F.lit("water budget "), "id").alias("body"))
    held = spark.conf.get(BROADCAST)
    terms = spark.createDataFrame([(7, "water"), (8, "1999")], "question_id long, term string")
    found = []
    try:
        for most in ("1m", "-1"):
            spark.conf.set(BROADCAST, most)
            stored = session.cut_lineage(terms.select("term"))
            assert ("Broadcast" in spark.range(9).selectExpr("'x' as term").join(session.if_small(stored), "term")._jdf.queryExecution().executedPlan().toString()) == (most == "1m")
            found.append(sorted(map(tuple, evidence.term_hits(corpus, "id", ["body"], terms).groupBy("term").count().collect())))
    finally:
        spark.conf.set(BROADCAST, held)
    assert found == [[("1999", 1), ("water", 2000)]] * 2


def test_mentions_are_counted_without_their_places(spark, monkeypatch):
    given, search = [], mentions.word_hits
    monkeypatch.setattr(mentions, "word_hits", lambda texts, text_id, body, keys, shown=True: given.append(shown) or search(texts, text_id, body, keys, shown))
    entry.queries()["E23_document_ingest"](spark, "/root/testdata/sf0.001")
    assert given == [False]
