"""Marked wrappers, batches by size, long training texts, many candidates, equal rows, several blocks."""

from __future__ import annotations

import random

import pytest
from llm.helpers import drop_lines, edit_distance_inside

from polislake.functions.arrays import starts
from polislake.llm import chat_format, decontaminate, html_extract, line_dedup, packing, pii, quality_rules, secret_scan

PARAS = [f"Sentence number {i} of a longer paragraph that says something about the town, its people and what they did in that year." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)


@pytest.mark.parametrize("page", [
    f'<div class="content with-sidebar">{BODY}</div>', f'<main class="page no-comments">{BODY}</main>', f'<article id="search-engines-explained">{BODY}</article>',
    f'<article class="post tag-advertising category-social">{BODY}</article>', f'<form id="aspnetForm"><div>{BODY}</div></form>', f'<div class="sidebar"><main>{BODY}</main></div>',
    f'<article>{BODY}</article><div id="comments">{BODY * 3}</div>', f'<article>{BODY}</article><div class="comment-list"><article class="comment">{BODY * 3}</article></div>',
    f'<header><p>{PARAS[0]}</p></header><article>{BODY}</article><footer>{BODY}</footer>', f'<article>{BODY}</article><aside>{BODY}</aside><form><p>{PARAS[1]}</p></form>', f'<div id="comments">{BODY}</div>',
])
def test_marked_blocks_around_and_beside_the_article(page):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == "\n".join(PARAS)


def test_heading_in_the_header_of_an_article():
    page = f"<body><article><header><p>By someone</p><h1>A title</h1></header>{BODY}</article></body>"
    assert html_extract.main_text(page) == "\n".join(["A title", *PARAS])


def test_text_around_a_cut_block_is_one_run():
    page = f'<body><article>{BODY}before <div class="ad">buy</div>after it</article></body>'
    assert html_extract.main_text(page) == "\n".join([*PARAS, "before after it"])


def test_html_of_odd_pages(spark):
    rows = [(1, None), (1, ""), (2, "<article>" + "<p>A long page says a lot of things, and then more.</p>" * 20_000), (3, f"<body>{BODY}")]
    pages = spark.createDataFrame([(i, "u", h, 7, "t") for i, h in rows], "page_id bigint, url string, html string, `_n_chars` int, `_text` string")
    got = html_extract.extract(pages.select("page_id", "url", "html")).collect()
    assert sorted(r["_n_chars"] for r in got)[:2] == [0, 0] and max(r["_n_chars"] for r in got) == 20_000 * 49 - 1
    assert html_extract.extract(pages).count() == 4
    assert html_extract.extract(pages.limit(0).select("page_id", "url", "html")).count() == 0


def test_dozens_of_batches_and_two_levels_of_runs(spark):
    rng = random.Random(2)
    lines = [f"line number {i} that is long enough to count as a repeated line" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own line {i} {rng.random()} of this document, also a long one" for _ in range(8))) for i in range(150)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = line_dedup.drop_repeated_lines(table, per_batch=30)
    assert sorted((r["doc_id"], r["_kept"]) for r in got.collect()) == drop_lines(docs)
    runs = line_dedup.Runs()
    keys = lambda ids: spark.createDataFrame([(i, i, 1, i) for i in ids], "k1 bigint, k2 bigint, n_docs bigint, owner bigint")
    for i in range(10):
        assert {r["k1"] for r in runs.fresh(keys(range(i, i + 3))).collect()} == (set(range(3)) if i == 0 else {i + 2})
        runs.add(keys(range(i, i + 3)))
    assert len(runs.levels) == 3 and [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r["k1"]: (r["n_docs"], r["owner"]) for r in runs.totals().collect()} == {i: (min(i, 2, 11 - i) + 1, i) for i in range(12)}


def test_long_labelled_texts_train_with_all_their_lines(spark):
    good = "\n".join(f"This is sentence number {i}, and it tells what happened on that day in the town." for i in range(300))
    late = "\n".join(["This is a sentence that tells what happened on that day in the town."] * 80 + ["Buy | now | $$$ ## CLICK !!!"] * 200)
    docs = spark.createDataFrame([(i, good if i % 2 else late) for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int")
    model = quality_rules.train(docs, labels)
    judged = {r["text"][:30]: r["_content_share"] for r in quality_rules.judge(spark.createDataFrame([(1, good), (2, "Buy | now | $$$ ## CLICK !!!\n" * 100)], "doc_id bigint, text string"), model).collect()}
    assert judged[good[:30]] > 0.9 and judged["Buy | now | $$$ ## CLICK !!!\nB"] < 0.1
    assert quality_rules.train(docs, labels, max_sequences=4) is not None


def test_starts_of_long_arrays(spark):
    rows = spark.range(3).selectExpr("transform(sequence(0, cast(id as int) * 700), x -> cast(x % 7 as bigint)) as a").collect()
    frame = spark.createDataFrame([(r["a"],) for r in rows] + [([],)], "a array<bigint>")
    for r in frame.select("a", starts(frame["a"]).alias("s")).collect():
        assert r["s"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


def test_candidates_of_a_text_with_very_many(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) + rng.choice(["", "=x", ".", '"']) for _ in range(50_000)]
    text = "key é " + " ".join(words)
    docs = spark.createDataFrame([("r", "p", text), ("s", "p", "one/two-three-four-five.six_seven_eight_nine,ten")], "_row string, _path string, _text string")
    got = [r for r in secret_scan.candidates(docs, 16).collect()]
    assert all((text if r["_row"] == "r" else "one/two-three-four-five.six_seven_eight_nine,ten")[r["start"] : r["start"] + len(r["value"])] == r["value"] for r in got)
    assert sum(r["_row"] == "r" for r in got) == 50_000 and {r["value"] for r in got if r["_row"] == "s"} == {"one/two-three-four-five", "six_seven_eight_nine"}


def test_equal_rows_are_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(None, None)] * 400 + [(1, "same words here")] * 400, "doc_id bigint, text string").repartition(3)
    rows = packing.pack_documents(docs, packing.tokenizer_path(), group=50).collect()
    assert len(rows) == 800
    groups = {}
    for r in rows:
        groups.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(groups) == 16 and max(map(len, groups.values())) <= 60


def test_benchmark_of_several_blocks(spark):
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))) for i in range(30)]
    docs = [(i, "before " + t[:20] + "X" + t[21:] + " after") for i, t in items[::2]] + [(100, "nothing of the kind"), (101, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, `_item` int")
    want = {(d, i) for d, t in docs if t for i, x in items if edit_distance_inside(x, t.lower()) <= len(x) * 0.05}
    for block in (100, 700, 10**6):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(table, bench, block=block).collect()} == want
        assert {r["doc_id"] for r in decontaminate.drop_leaks(table, bench, block=block).collect()} == {100, 101}


def test_addresses_have_the_form_of_one():
    for text in ("look at the house.", "arrived at noon. Then", " at 5 p.m.", "at home"):
        assert not pii.plausible(0, text) and not pii.anchors(text)
    for text in ("ana@b.org", "ana @ b.org", "ana (at) b.org", "a.b [at] c [dot] d", "lore at mail dot example dot com", "é@ü.de"):
        assert pii.plausible(0, text) and pii.anchors(text)
    assert not pii.anchors("in 1998, or 2004 and 12") and pii.anchors("1 2 3 4") and pii.anchors("call 123-456-789")


def test_long_conversations_and_clashing_columns(spark):
    rows = [(1, i, "user" if i % 700 < 650 else "assistant", f"text {i} </s>") for i in range(3000)] + [(2, None, None, None)]
    chats = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, `_role` int, blocks string")
    back = {r["_conv"]: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3]) for r in rows[:-1]]
    text = back[1]["formatted"]
    assert [text[s["start"] : s["start"] + s["length"]] for s in back[1]["loss"]] == [chat_text.replace("</s>", "<\\/s>") for _, _, role, chat_text in rows[:-1] if role == "assistant"]
    assert text.count(chat_format.START) == 9 and [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")]
