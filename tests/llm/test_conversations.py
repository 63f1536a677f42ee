"""Prefix trie, structure repair and toxicity against plain Python versions, SQL and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from polislake.llm import prefix_trie, queries, structure_repair, toxicity

SF = "/root/testdata/sf0.01"
CHATS = "conv_id bigint, turn bigint, role string, text string, `_conv` string, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CHATS)


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_conversation_repair"])
def test_rows_of_the_sql(spark, name):
    duckdb.sql(f"create or replace view conversations as select * from '{SF}/conversations.parquet'")
    df, want = queries.QUERIES[name](spark, SF), duckdb.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    slots = prefix_trie.Slots(np.concatenate([keys, keys[:700]]))
    assert sorted(slots.find(keys)) == list(range(5000))
    assert (slots.find(rng.integers(-(2**63), 2**63 - 1, (5000, 2))) == -1).all()
    assert len(prefix_trie.Slots(np.zeros((0, 2), np.int64))) == 0


def trie_of(chats):
    """Nodes by brute force over conversations as they are."""
    held = defaultdict(list)
    for c, turn, role, text in chats:
        if c is not None:
            held[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    paths = {c: [t[3:] for t in sorted(ts)] for c, ts in held.items()}
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = set()
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(paths[c]) == len(node)))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(n) == len(node) + 1 for n in below), sum(not any(m[:-1] == n and m for m in below) for n in below),
                 sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1, 2, 7, 1 << 17])
def test_trie_is_brute_force_whatever_the_shards(spark, shard):
    rng = random.Random(shard)
    chats = []
    for c in [*range(1, 40), -3, 10**12]:
        turn = 0
        for d in range(rng.choice([1, 2, 3, 25])):
            turn += rng.choice([0, 1, 1, 2])
            chats.append((c, None if d == 0 and rng.random() < 0.2 else turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é\U0001f600"]) if c % 3 else "same"))
    chats += [(50, 0, "user", "same")] * 3 + [(None, 1, "user", "left out"), (51, 5, "user", "long " * 50_000)]
    got = prefix_trie.trie(prefix_trie.rooted(prefix_trie.turns(frame(spark, chats))), shard=shard)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == trie_of(chats)


def test_no_conversations(spark):
    none = frame(spark, [])
    assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.turns(none))).count() == 0
    assert structure_repair.repaired(structure_repair.damaged(structure_repair.rows_of(none))).count() == 0


def cheapest(kinds):
    """Least cost, then ASCII-least audit, by trying all."""
    best = None
    follow = {0: 2, 1: 2, 2: 3, 3: 2}

    def go(i, state, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(kinds) and state in (0, 3):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 2:
            go(i, follow[state], cost + 3, audit + "I", inserts + 1)
        if i < len(kinds):
            initial, mode = divmod(kinds[i], 3)
            go(i + 1, state, cost + 4, audit + "D", 0)
            if mode < 2:
                go(i + 1, follow[state], cost + 3 + 3 * mode, audit + "R", 0)
                if (initial, state) in {(0, 0), (1, 0), (1, 1), (1, 3), (2, 2)}:
                    go(i + 1, initial + 1, cost + 3 * mode, audit + "K", 0)

    go(0, 0, 0, "", 0)
    return best


def test_repair_is_the_cheapest_and_ascii_least():
    rng = random.Random(6)
    tried = [k for n in range(4) for k in itertools.product(range(12), repeat=n)] + [tuple(rng.randrange(12) for _ in range(rng.randint(4, 7))) for _ in range(150)]
    for kinds in tried:
        assert structure_repair.repair(bytes(kinds)) == cheapest(kinds)


def test_long_conversation_in_linear_space():
    rng = random.Random(7)
    kinds = bytes(rng.randrange(12) for _ in range(30_000))
    cost, audit = structure_repair.repair(kinds)
    # The audit costs what it says and leaves a valid conversation.
    state, paid, at = 0, 0, 0
    for letter in audit:
        if letter == "I":
            state, paid = structure_repair.NEXT[state], paid + 3
            continue
        initial, mode = divmod(kinds[at], 3)
        at += 1
        paid += {"K": 0, "R": 3, "D": 4}[letter] + (3 * (mode == 1) if letter in "KR" else 0)
        assert letter == "D" or mode < 2
        state = {"D": state, "R": structure_repair.NEXT[state], "K": initial + 1}[letter]
    assert at == len(kinds) and paid == cost and state in (0, 3)


def test_repair_of_odd_rows(spark):
    chats = [(1, None, None, None), (1, 3, "user", "Hi."), (1, 9, "assistant", "Yes."), (None, 1, "user", "Who?"), (None, 2, "tool", "cut off"), (7, 1, "user", "same."), (7, 1, "user", "same."), (8, 0, "", "\t")]
    got = {r["_conv"]: r for r in structure_repair.repaired(structure_repair.rows_of(frame(spark, chats))).collect()}
    one = got[1]
    assert (one["_gaps"], one["_blank"], one["_duplicate"], one["_truncated"], one["_illegal"], one["_cost"], one["_audit"]) == (5, 1, 0, 0, 1, 4, "DKK")
    assert one["_repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    none = got[None]
    assert (none["_truncated"], none["_illegal"], none["_cost"], none["_audit"]) == (1, 1, 6, "KR")
    assert none["_repaired_sha256"] == hashlib.sha256(b"user:Who?\nassistant:cut off").hexdigest()
    assert (got[7]["_duplicate"], got[7]["_audit"], got[7]["_gaps"]) == (1, "DKI", 0) or got[7]["_audit"] == "KDI"
    assert (got[8]["_blank"], got[8]["_cost"], got[8]["_audit"], got[8]["_repaired_sha256"]) == (1, 4, "D", hashlib.sha256(b"").hexdigest())


def test_dropped_conversation_keeps_its_row(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = structure_repair.repaired(structure_repair.damaged(structure_repair.rows_of(frame(spark, [(5, turn, "user", "Hi.")])))).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(0)
    model = toxicity.Crf(np.zeros(0, np.uint64), np.zeros(0), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    first = np.concatenate([[0], np.cumsum([0, 1, 3, 64, 65, 300, 0, 128, 2])])
    evidence = rng.normal(size=first[-1]) * 3
    got = model.marginals(evidence, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        left, right = np.zeros((b - a, 2)), np.zeros((b - a, 2))
        for i in range(b - a):
            come = model.start if i == 0 else np.logaddexp(left[i - 1, 0] + model.move[0], left[i - 1, 1] + model.move[1])
            left[i] = come + [0, evidence[a + i]]
        for i in range(b - a - 2, -1, -1):
            x = right[i + 1] + [0, evidence[a + i + 1]]
            right[i] = np.logaddexp(model.move[:, 0] + x[0], model.move[:, 1] + x[1])
        z = left + right
        assert np.allclose(got[a:b], 1 / (1 + np.exp(z[:, 0] - z[:, 1])), atol=1e-10)


def toxic_table(spark, n=900):
    """Texts in which one of some words, also in forms that the fit has not seen, marks the label."""
    rng = random.Random(3)
    letters = "abcdefghilmnoprstu"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(["Zargol", "quixab", "vombel" + "".join(rng.choice(letters) for _ in range(3)) + ","])
        docs.append((i, " ".join(text), 1, "z"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, `_score` int, `_text` string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_toxic_words(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    found = toxicity.find_toxic(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    assert sum((r["_score"] >= 0.5) == (r["toxic"] == 1) for r in found) >= 0.98 * len(found)
    for r in found:
        for span in filter(None, r["_toxic_spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert r["toxic"] == 0 or any(w in r["text"][a:b].lower() for w in ("zargol", "quixab", "vombel"))
            assert " " not in r["text"][a:b]
    assert sum(bool(r["_toxic_spans"]) for r in found if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in found)


def test_toxicity_of_odd_texts(spark):
    docs, labels = toxic_table(spark, 300)
    model = toxicity.train(docs, labels)
    odd = [(1, None), (1, ""), (None, " \t\n"), (2, "é" * 200_000), (3, "fine words only " * 20_000 + "zargol"), (3, "zargol zargol"), (4, "\U0001f600 zargol.")]
    got = [tuple(r) for r in toxicity.find_toxic(spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id bigint, text string, score double"), model).collect()]
    assert len(got) == 7 and all(0 <= r[3] <= 1 for r in got)
    by = dict(zip([(r[0], (r[1] or "")[:9]) for r in got], got, strict=True))
    assert by[(4, "\U0001f600 zargol.")][4] == "2:9" and by[(3, "zargol za")][4] == "0:6,7:13"
    assert by[(3, "fine word")][4] == "320000:320006"
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.find_toxic(none, model).count() == 0
    assert toxicity.train(docs, labels.filter("toxic = 0")) == 0.0 and toxicity.train(docs, labels.filter("toxic = 1")) == 1.0
    assert toxicity.train(none, labels) == pytest.approx(0.2)
    assert [r["_score"] for r in toxicity.find_toxic(docs.select("doc_id", "text").limit(2), 0.2).collect()] == [0.2, 0.2]
