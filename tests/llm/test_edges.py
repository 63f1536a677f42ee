"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import pytest
from llm.helpers import counts, drop_lines, near_components

from polislake.llm import chat_format, decontaminate, html_extract, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, url_filter
from polislake.llm.queries import URL_RULES, known_format

LINE = "This very line of over forty characters is found in many documents."
PROSE = " ".join(f"word{i} other{i} thing{i} and{i}" for i in range(60))
DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (5, PROSE), (6, PROSE + " end"), (7, f"{LINE}\nown line"), (8, f"  {LINE.upper()}\t\nother"),
    (9, LINE), (10, LINE), (11, f"a\n{LINE}\n{LINE}"), (12, "x y"), (13, "X\ty"), (14, ("long text " * 7 + "\n") * 2000), (15, "\n" + LINE + "\n"), (16, "é" * 39 + "\n" + "word " * 3),
]
SCHEMA = "doc_id bigint, text string, `_kept` string, lines string, `_c1` string"


@pytest.fixture(scope="module")
def docs(spark):
    """Other columns carry the names that the operators use inside."""
    return spark.createDataFrame([(*d, "k", "l", "c") for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, and repeated rows."""
    rows = [(None, PROSE), (None, LINE), *[(d, t) for d, t in DOCS], (4, PROSE), (7, "another text under id seven")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_near_dedup(docs, odd, empty):
    for n in (4, 5):
        got = {r["_id"]: r for r in near_dedup.near_duplicates(docs, n=n).collect()}
        assert {d: r["component_id"] for d, r in got.items()} == near_components(DOCS, n, 80)
        assert all(r["kept"] == (r["_id"] == r["component_id"]) for r in got.values())
    got = near_dedup.near_duplicates(odd).collect()
    assert sorted((r["_id"] is None, r["_id"]) for r in got if r["_id"] is not None) == sorted((False, d) for d, _ in DOCS)
    assert [(r["component_id"], r["kept"]) for r in got if r["_id"] is None] == [(None, True)]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_line_dedup(docs, odd, empty):
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "_lines", "_dropped", "_kept"]
    rows = sorted((r[0], r[-1] or "") for r in got.collect())
    assert rows == sorted(drop_lines(DOCS))
    assert [r[-1] for r in got.filter("doc_id = 1").collect()] == [None]
    kept = [(r["doc_id"], r["_kept"]) for r in line_dedup.drop_repeated_lines(odd).collect()]
    assert (None, LINE) in kept and kept.count((4, PROSE)) == 2 and len(kept) == odd.count()
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_runs_tell_new_keys_from_known(spark):
    keys = lambda *k: spark.createDataFrame([(x, x, 1, 100 - x) for x in k], "k1 bigint, k2 bigint, n_docs bigint, owner bigint")
    runs = line_dedup.Runs()
    for i in range(5):
        batch = keys(i, i + 1, 50)
        assert {r["k1"] for r in runs.fresh(batch).collect()} == ({i, i + 1, 50} if i == 0 else {i + 1})
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [2, 1]
    assert {(r["k1"], r["n_docs"], r["owner"]) for r in runs.totals().collect()} == {(0, 1, 100), (1, 2, 99), (2, 2, 98), (3, 2, 97), (4, 2, 96), (5, 1, 95), (50, 5, 50)}


def test_quality(docs, odd, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (14, 0, 0), (9, 0, 1), (None, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, model)
    assert got.columns[: len(docs.columns)] == docs.columns
    for r in got.collect():
        want = counts(r["text"])
        assert tuple(r[f"_{c}"] for c in quality_rules.COUNTS) == want, r["doc_id"]
        assert r["_base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r[-1] and r["_base_failed"])
    assert quality_rules.judge(odd, model).count() == odd.count()
    assert quality_rules.judge(empty, model).count() == 0
    assert quality_rules.train(empty, labels) is None
    assert quality_rules.judge(docs, None).filter("doc_id = 4").first()[-1]


def test_packing(docs, odd, empty):
    for table in (docs, odd):
        rows = packing.pack_documents(table, packing.tokenizer_path(), capacity=64).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for placed in bins.values():
            placed.sort()
            assert placed[0][0] == 0 and sum(n for _, n in placed) <= 64
            assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False))
        assert sum(r["piece"] == 0 for r in rows) == table.count()
    assert [(r["length"], r["piece"]) for r in rows if r["doc_id"] == 1] == [(1, 0)]
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0


def test_decontamination(docs, odd, empty, spark):
    bench = spark.createDataFrame([(1, PROSE[:200]), (2, None), (3, ""), (4, " \n "), (5, "xyz not there at all"), (1, PROSE[:200])], "item_id bigint, text string")
    got = decontaminate.find_items(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(4, 1, 0), (5, 1, 0), (6, 1, 0)}
    assert {r["doc_id"] for r in decontaminate.find_items(odd, bench).collect()} == {None, 4, 5, 6}
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in DOCS} - {4, 5, 6}
    assert decontaminate.find_items(empty, bench).count() == 0
    assert decontaminate.find_items(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_pii(odd, empty, spark):
    rows = [(1, None), (2, ""), (3, "write a.b@c.example.com. or +1 (262) 555-3752, 10.0.0.256 10.0.0.1"), (3, "4799134681044206 4799134681044207"), (None, "@ @@ 1.2.3 a@b")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"), None).collect()
    assert [r["_spans"] for r in got] == ["", "", "email:6:23,phone:28:45,ip:58:66", pii.written(pii.base_spans(rows[3][1])), ""]
    assert pii.find_personal_data(odd, None).count() == odd.count()
    assert pii.find_personal_data(empty, None).count() == 0 and pii.train(empty) is None


def test_secrets(spark, empty):
    key = "AKIA" + "Q7" * 8
    rows = [(1, None, None), (2, "", "a"), (3, f"use {key} now", "src"), (3, f"use {key} now", "src"), (None, f"{key}", "x")] + [(10 + i, f"internationalization{'abcdefgh'[i % 8]} of things and internationalisierung", "src") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = secret_scan.scan_secrets(docs, label=known_format()).collect()
    assert sorted((r["_id"] is None, r["start"], r["length"]) for r in found if r["secret"]) == [(False, 4, 20), (False, 4, 20), (True, 0, 20)]
    assert secret_scan.scan_secrets(docs.limit(0), label=known_format()).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.com", "http://x.example.com/en/1?q", "https://www.example.com/en/", "ftp://b.net/fr/2#f", "http://b.net/frx", "http://user@b.NET:80/es/", "http://x.org/en/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, *urls])], "page_id bigint, url string, host string")
    got = {r["_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert [got[i] for i in range(11)] == [got[i + 11] for i in range(11)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("x.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("b.net", "/fr/2", "net/fr/", "block"), ("b.net", "/frx", None, "allow"), ("user@b.net:80", "/es/", None, "allow"), ("x.org", "/en/1", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_chats(spark):
    turns = [("user", "a</s>"), ("user", None), ("assistant", "<|end|>\\<\\|x [INST] <<SYS>>"), ("assistant", ""), (None, "no role"), ("assistant", "tail\né\U0001f600")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "user", "x")]
    chats = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.read_back(chat_format.format_chats(chats))
    got = {r["_conv"]: r for r in out.withColumn("learned", chat_format.learned_text(out["formatted"], out["loss"])).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r or "", t or "") for r, t in turns]
    assert got[1]["learned"] == "".join(t or "" for r, t in turns if r == "assistant") and got[2]["learned"] == "aab"
    assert got[1]["formatted"].count("<|start|>") == 4 and [tuple(t) for t in got[None]["turns"]] == [("user", "x")]
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_pages(spark):
    html = {
        1: None, 2: "", 3: "<p>", 4: "plain &amp; simple &#8217;x&#x41;", 5: "<script>var a='<p>no</p>'", 6: "<!-- <p>no</p>", 7: "<div><p>one<p>two<ul><li>a<ul><li>b</ul><li>c</ul></div>",
        8: "<body><nav><a href=/x>menu</a></nav><main><h1>T</h1><p>first <b>bold</b>\n text</p><p>second</p><div class='comments'><p>said a reader, at great length and more</p></div></main><footer>f</footer>",
    }
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(list(html.items()), "page_id bigint, html string")).collect()}
    want = {1: "", 2: "", 3: "", 4: "plain & simple ’xA", 5: "", 6: "", 7: "one\ntwo\na\nb\nc", 8: "T\nfirst bold text\nsecond"}
    assert {k: r["_main_text"] for k, r in got.items()} == want and all(r["_n_chars"] == len(r["_main_text"]) for r in got.values())
