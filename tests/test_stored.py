"""Merge chains, bucketed tables, snapshot differences, the stored index, and HTML that lazy patterns miss."""

from __future__ import annotations

import glob
import os
import random

from pyspark.sql import functions as F

from polislake.functions import html
from polislake.functions.arrays import starts
from polislake.operators import chains, extract, mentions, merge
from polislake.operators.buckets import BucketedTable, snapshot_changes
from polislake.operators.textindex import TextIndex, newest


def pairs(spark, rows):
    return spark.createDataFrame(rows, "duplicate_id long, target_id long")


def test_chains_are_followed_to_their_end(spark):
    rng = random.Random(4)
    rows = [(i, i + 1) for i in range(100, 133)] + [(1, 2), (2, 3), (3, 1), (9, 2), (50, 9), (7, 7), (8, None), (None, 4), (60, 61), (60, 62)]
    rows += [(1000 + i, 1000 + rng.randrange(i)) for i in range(1, 200)]
    to = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))

    def end(x):
        seen = [x]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        return min(seen[seen.index(to[seen[-1]]):]) if seen[-1] in to else seen[-1]

    got = {r["duplicate_id"]: r["target_id"] for r in chains.followed(pairs(spark, rows)).collect()}
    assert got == {a: end(a) for a in to if end(a) != a}
    assert chains.followed(pairs(spark, [])).count() == 0


def test_children_of_a_chain_reach_its_end(spark):
    children = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c"), (4, "z", "d")], "person long, role string, url string")
    got = merge.repoint(children, pairs(spark, [(1, 2), (2, 3)]), "person", ["person", "role"], [F.col("url")]).collect()
    assert sorted(map(tuple, got)) == [(3, "x", "a"), (3, "y", "c"), (4, "z", "d")]


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(500)] + [(None, "no key")]
    table = BucketedTable(spark, str(tmp_path / "t"), ("id",)).create(spark.createDataFrame(rows, "id long, title string"))
    before = files(table.path)
    changed = table.merge(spark.createDataFrame([(7, "new"), (7, "newer")], "id long, title string"), {}, order=[F.desc("title")])
    after = files(table.path)
    (bucket,) = table.touched(spark.createDataFrame([(7, "")], "id long, title string"))
    assert {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())} == {f"{table.path}/_bucket={bucket}"}
    assert {(r["id"], r["change"]) for r in changed.where("change <> 'unchanged'").collect()} == {(7, "updated")}
    table.merge(spark.createDataFrame([(None, "still no key"), (900, "added")], "id long, title string"), {})
    want = {(i, t) for i, t in rows if i not in (7, None)} | {(7, "newer"), (900, "added"), (None, "still no key")}
    assert {tuple(r) for r in table.read().collect()} == want
    assert BucketedTable(spark, str(tmp_path / "none"), ("id",)).create(spark.createDataFrame([], "id long, title string")).read().count() == 0


def test_running_counts_with_withdrawals(spark, tmp_path):
    counts = lambda rows: spark.createDataFrame(rows, "name string, n long")
    state = BucketedTable(spark, str(tmp_path / "c"), ("name",), 4).create(counts([("a", 2), ("b", 1), (None, 3)]))
    state.add_counts(counts([("a", 1), ("a", -1), ("c", 5), (None, -3)]), "n")
    state.add_counts(counts([("b", -1), ("c", -2)]), "n")
    assert {tuple(r) for r in state.read().collect()} == {("a", 2), ("c", 3)}
    for name in ("a", "c"):
        state.add_counts(counts([(name, -2), (name, 0)]), "n")
    assert {tuple(r) for r in state.read().collect()} == {("c", 1)}


def test_snapshot_changes_read_unequal_buckets_only(spark, tmp_path):
    rows = [(i, i % 3, None if i % 5 == 0 else f"v{i}") for i in range(300)]
    schema = "id long, kind long, value string"
    a = BucketedTable(spark, str(tmp_path / "a"), ("id",)).create(spark.createDataFrame(rows, schema))
    new = [r for r in rows if r[0] != 17] + [(1000, 1, None)]
    new[3] = (3, 0, "changed")
    b = BucketedTable(spark, str(tmp_path / "b"), ("id",)).create(spark.createDataFrame(new, schema))
    assert snapshot_changes(a, a).count() == 0
    kept = tuple(spark.createDataFrame(x.digests().collect(), "_bucket int, rows long, digest decimal(30,0)") for x in (a, b))
    touched = set(a.touched(spark.createDataFrame([(17,), (1000,), (3,)], "id long")))
    # The other buckets can no longer be read, and need not be.
    for f in glob.glob(f"{tmp_path}/*/_bucket=*/*.parquet"):
        if int(f.split("_bucket=")[1].split("/")[0]) not in touched:
            with open(f, "wb") as out:
                out.write(b"gone")
    got = snapshot_changes(a, b, kept)
    assert {tuple(r) for r in got.collect()} == {(17, "removed"), (1000, "added"), (3, "changed")}


def test_stored_index_is_a_scan_of_all_texts(spark, tmp_path):
    rng = random.Random(8)
    words = ["water", "waters", "housing", "re-housing", "road", "e-toll", "budget", "b"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", ","]) for _ in range(6)) if i % 9 else None, None if i % 4 == 0 else f"2020-01-{1 + i % 28:02d}") for i in range(120)]
    corpus = spark.createDataFrame(docs, "id long, body string, day string").withColumn("day", F.col("day").cast("date"))
    terms = ["water", "HOUSING", "e-toll", "road budget", "water, road", "none", "?!", "b"]
    index = TextIndex(spark, str(tmp_path / "parts"), k=4, parts=4)
    for i in range(3):
        index.add(corpus.where(F.col("id") % 3 == i), "id", ["body"], newest("day", "id"), i)
    by = lambda d: (d[2] is None, "".join(chr(255 - ord(c)) for c in d[2] or ""), d[0])
    want = {(t, d[0], n + 1) for t in terms if any(c.isalnum() for c in t) for n, d in enumerate(sorted((d for d in docs if d[1] and t.lower() in d[1].lower()), key=by)[:4])}
    for x in (index, index.merged(str(tmp_path / "one"))):
        found = x.search(spark.createDataFrame([(t,) for t in terms], "term string"), corpus, "id", ["body"])
        assert {(r["term"], r["id"], r["position"]) for r in found.collect()} == want


def test_spellings_by_their_rarest_run(spark):
    texts = [(1, "Mr Smith met Mr van der Berg."), (2, "mr mr mr smith-jones, MR VAN DER BERG"), (3, None), (4, "der Berg van"), (5, "van der bergs"), (6, "…"), (7, "x " * 3000 + "Mr Smith")]
    keys = ["mr smith", "mr van der berg", "smith-jones", "…", "berg", "nowhere at all"]
    hits = mentions.word_hits(spark.createDataFrame(texts, "id long, body string"), "id", "body", spark.createDataFrame([(k,) for k in keys], "_key string"))
    got = {(r["_tid"], r["_key"], r["_at"]) for r in hits.collect()}
    assert got == {(1, "mr smith", 0), (1, "mr van der berg", 13), (1, "berg", 24), (2, "mr smith", 6), (2, "smith-jones", 9), (2, "mr van der berg", 22), (2, "berg", 33), (4, "berg", 4), (6, "…", 0), (7, "mr smith", 6000)}


def test_starts(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), (list(range(600)),)], "a array<bigint>")
    assert all(r["s"] == [sum(r["a"][:i]) for i in range(len(r["a"]))] for r in rows.select("a", starts(F.col("a")).alias("s")).collect())


def shown(spark, text, column):
    return spark.createDataFrame([(text,)], "html string").select(column.alias("x")).first()["x"]


def test_references_are_decoded_once(spark):
    got = shown(spark, "a &#38;lt; b &amp;lt; caf&eacute; &#233;&#xE9; &nosuch; & x &#39;y&apos;&nbsp;z &amp &#xD800; &#0;", html.visible_text(F.col("html")))
    assert got == "a &lt; b &lt; café éé &nosuch; & x 'y' z &amp &#xD800; &#0;"


def test_nested_tables_and_elements(spark):
    page = "<table><tr><td>A</td><td>x <table><tr><td>in1</td><td>in2</td></tr></table> y</td><td>C</td></tr><tr><td>B<td>2</td></tr></table>"
    assert shown(spark, page, F.transform(html.table_rows(F.col("html")), lambda r: html.cells(r))) == [["A", "x in1 in2 y", "C"], ["in1", "in2"], ["B", "2"]]
    divs = "<div id=a class='k row'>1<div>2</div>3</div><div class=k>4</div><div class='kk'>5</div>"
    assert shown(spark, divs, html.elements(F.col("html"), "div", html.with_class("k"))) == ["1<div>2</div>3", "4"]


def test_profile_page_in_any_order_of_attributes(spark):
    page = (
        '<div class="mp-block__title"><b>Political party</b></div><a href="/p">Big Front (BF)</a><h1>Ms Anna Berg</h1><img src="/m/a.jpg" alt="x" class="mp-image big">'
        '<div class="row text-link"><div class="text-link__text">Chair <a href="/c">Portfolio Committee on Water</a></div><div class="text-link__date">since 3 May 2012</div></div>'
    )
    found = extract.profiles(spark.createDataFrame([(1, "https://x.org/person/a/", page)], "page_id long, url string, html string"))
    (r,) = found.collect()
    assert (r["full_name"], r["party_name"], r["party_short_name"], r["photo_url"]) == ("Anna Berg", "Big Front", "BF", "https://x.org/m/a.jpg")
    (c,) = extract.profile_committees(found).collect()
    assert (c["committee"], c["role"], str(c["start_date"])) == ("Water", "Chairperson", "2012-05-03")


def test_attendance_under_headings_with_tags(spark):
    page = "<h3><span>Members</span> <b>present</b></h3><ul><li>Mr A<ul><li>Mr B</li></ul></li><li>Ms C</li></ul><h3>Apologies</h3> <table><tr><td>Dr D</td><td>apology</td></tr></table><h3>Other</h3><ul><li>no</li></ul>"
    got = extract.meeting_page_attendance(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert {(r["name_raw"], r["attendance_status"]) for r in got} == {("Mr A Mr B", "present"), ("Mr B", "present"), ("Ms C", "present"), ("Dr D", "apology")}
