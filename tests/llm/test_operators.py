"""The queries against brute force on the small tables, models on held-out rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import duckdb
import numpy as np
import pytest
from check import compare, duck
from llm.helpers import counts, edit_distance_inside, near_components

import __spark_entry__ as entry
from polislake.llm import decontaminate, packing, pii, quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"


def rows_of(sql: str) -> list[tuple]:
    return duckdb.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    status, _, n, note = compare(spark, duck(SF), SF, name)
    assert status == "ok" and n, note


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_near_dedup_is_exact(spark):
    docs = rows_of(f"select doc_id, text from '{SF}/documents.parquet'")
    rng = random.Random(4)
    words = docs[0][1].split()[:150]
    for i in range(60):  # a cloud of copies at, above and below the threshold
        copy = list(words)
        for k in rng.sample(range(len(copy)), rng.randint(1, 9)):
            copy[k] = f"new{i}x{k}"
        docs.append((5000 + i, " ".join(copy)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    from polislake.llm.near_dedup import near_duplicates

    got = {r["_id"]: r["component_id"] for r in near_duplicates(table, n=4).collect()}
    assert got == near_components(docs, 4, 80)


def test_main_text_is_the_article(spark):
    got = {r["page_id"]: r["text"] for r in queries.op3_html_extraction(spark, SF).collect()}
    for page, html in rows_of(f"select page_id, html from '{SF}/pages.parquet'"):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert got[page] == "\n".join(b for b in blocks if b)


def test_quality_counts_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels.filter("doc_id % 2 = 0"))
    right = Counter()
    held = labels.filter("doc_id % 2 = 1").select("doc_id", "quality")
    for r in quality_rules.judge(docs.select("doc_id", "text"), model).join(held, "doc_id", "left").collect():
        want = counts(r["text"])
        assert tuple(r[f"_{c}"] for c in quality_rules.COUNTS) == want
        if r["quality"] is not None and not r["_base_failed"]:
            right[r["quality"], r["_kept"]] += 1
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.7 * (right[0, True] + right[0, False])


def test_crf_decodes_the_best_path():
    rng = np.random.default_rng(0)
    crf = quality_rules.Crf(3)
    crf.node, crf.move, crf.start = rng.standard_normal((3, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2)
    x = rng.standard_normal((7, 3))
    score = lambda y: crf.start[y[0]] + sum((x @ crf.node)[i, v] for i, v in enumerate(y)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False))
    paths = [[n >> i & 1 for i in range(7)] for n in range(128)]
    assert crf.decode(x, np.array([0, 7])).tolist() == max(paths, key=score)


def test_mined_rules_match_apriori(spark):
    rng = random.Random(1)
    urls = [(rng.sample("abcdef", 3), rng.choice(["allow", "block"])) for _ in range(60)] + [(["a", "b", "x"], "block")] * 20
    table = spark.createDataFrame([(sorted(t), v) for t, v in urls], "_tokens array<string>, _label string")
    got = {(tuple(r["tokens"]), r["verdict"], round(r["confidence"], 9)) for r in url_filter.mine(table, 0.05, 0.8, 1000).collect()}
    seen, both = Counter(), Counter()
    for tokens, label in urls:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                seen[c] += 1
                both[c, label] += 1
    rules = {(c, v): n / seen[c] for (c, v), n in both.items() if n >= 0.05 * len(urls) and n / seen[c] >= 0.8}
    want = {(c, v, round(p, 9)) for (c, v), p in rules.items() if not any(rules.get((s, v), -1) >= p for s in combinations(c, len(c) - 1))}
    assert got == want and want
    hits = {tuple(r["_tokens"]): r["mined"] for r in url_filter.match(table, url_filter.mine(table, 0.05, 0.8, 1000)).collect()}
    assert all((tuple(sorted(t)) in hits) == any(set(c) <= set(t) for c, _, _ in want) for t, _ in urls)


def test_secrets_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    text = dict(rows_of(f"select doc_id, text from '{sf}/documents.parquet'"))
    planted = re.compile(r'(?:token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|\b(AKIA[0-9A-Z]{16})\b)')
    for r in queries.op2_secret_scan(spark, sf).collect():
        got = [tuple(map(int, p.split(":"))) for p in r["places"].split(",") if p]
        assert got == [m.span(m.lastindex) for m in planted.finditer(text[r["doc_id"]])]


def test_tagger_gradients():
    model = pii.Tagger(size=4, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 127, (2, pii.WIDTH)), rng.integers(0, pii.TAGS, (2, pii.WIDTH))

    def likelihood() -> float:
        total, move = 0.0, model.p["move"]
        for em, y in zip(model.emissions(ids).astype(float), tags, strict=True):
            a, s = em[0] + model.p["start"], em[0, y[0]] + model.p["start"][y[0]]
            for t in range(1, pii.WIDTH):
                a = np.log(np.exp(a[:, None] + move).sum(0)) + em[t]
                s += em[t, y[t]] + move[y[t - 1], y[t]]
            total += s - np.log(np.exp(a).sum())
        return total

    grad = model.gradients(ids, tags)
    for name, value in model.p.items():
        at = (ids[0, 5], 1) if name == "emb" else tuple(s // 2 for s in value.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = likelihood()
        value[at] = old - step
        down = likelihood()
        value[at] = old
        assert abs((up - down) / 2 / step - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at])), name


def test_base_spans_match_the_patterns():
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def good(k: int, s: str) -> bool:
        digits = re.sub("[^0-9]", "", s)
        return [True, all(int(p) <= 255 for p in s.split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-+1234 (56)%é\n") for _ in range(rng.randint(0, 60)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if good(k, m[0]))
        assert pii.base_spans(text) == want, text


def test_tagger_finds_held_out_spans(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = pii.train(docs.filter("doc_id % 2 = 0"))
    found = wanted = added = clean = 0
    for (text,) in rows_of(f"select text from '{sf}/documents.parquet' where doc_id % 2 = 1"):
        base, every = pii.find([text], model)
        assert set(base[0]) <= set(every[0])
        added += len(every[0]) - len(base[0])
        clean += not base[0]
        if base[0]:
            codes = pii.encode(text)
            for s, k, e in base[0]:
                start = max(0, (s + e) // 2 - pii.WIDTH // 2)
                tags = model.decode(pii._cut(codes, start)[None])[0][0][s - start : e - start]
                wanted += 1
                found += (np.isin(tags, (1 + 2 * k, 2 + 2 * k))).mean() > 0.8
    assert wanted > 50 and found >= 0.9 * wanted, (found, wanted)
    assert added <= 0.002 * clean
    _, every = pii.find(["Please call (262) 555-3752 today"], model)
    assert all(k in range(4) for _, k, _ in every[0])


def test_packing_is_tight_and_exact(spark):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    text = dict(rows_of(f"select doc_id, text from '{SF}/documents.parquet'"))
    pieces = defaultdict(list)
    for r in queries.op9_best_fit_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    for doc, rows in pieces.items():
        ids = [*tokenizer.encode(text[doc], add_special_tokens=False).ids, 1]
        rows.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in rows] == [(i, 4096 * i) for i in range(len(rows))] and sum(r["length"] for r in rows) == len(ids)
        assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert set(pieces) == set(text)
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(rng.exponential(1000, 5000).astype(int) + 1, 4096))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 4096)
    assert np.bincount(bins, lengths).max() <= 4096 and bins.max() + 1 <= 1.01 * lengths.sum() / 4096 + 2


def test_ids_of_strange_texts():
    words = packing.word_ids(packing.tokenizer_path())
    rng = random.Random(2)
    pool = [chr(c) for c in range(1, 0x250)] + list("́Σσİ 　﻿​²Ⅰ١中") + list(" 'abcdest12.,<|>") * 20
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) + rng.choice(["", "I'll don't", "<|endoftext|>"])
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_edited_items_are_found(spark):
    rng = random.Random(9)
    items = dict(rows_of(f"select item_id, text from '{SF}/benchmark.parquet'"))
    docs, want = [], {}
    for d in range(120):
        item_id = rng.choice(list(items))
        item, budget = decontaminate.fold(items[item_id]), int(0.05 * len(decontaminate.fold(items[item_id])))
        copy = list(item)
        for _ in range(rng.randint(0, 2 * budget)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["q"], [copy[at], "z"]])
        text = "Before it. " + "".join(copy).upper().replace(" ", "\n", 3) + " And after."
        docs.append((d, text))
        distance = edit_distance_inside(item, decontaminate.fold(text))
        if distance <= budget:
            want[d, item_id] = distance
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found}
    assert {k: got[k] for k in want if k in got} == want and set(got) == set(want) and len(want) > 20
