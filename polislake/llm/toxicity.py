"""Toxicity by token labels: a linear-chain CRF tags toxic words, its marginals give scores and places.

A token is a run of characters outside [\\x20\\x09-\\x0D]. Its features are
hashes of the word between its outer punctuation and of the word's beginnings
(``BEGINNINGS`` bytes), A-Z in lower case. The CRF has a weight for each feature
and for each move between clean and toxic tokens. Forward-backward over the
whole text gives each token's marginal probability; a document's score is a
logistic function of the largest marginal and of the expected number of toxic
tokens, the offending places are the tokens with a marginal of at least ``sure``.

The tables label documents, not tokens, so tokens are labelled first: a feature
is marked if most of its documents are toxic and chance would hardly give such
counts to any of the features looked at (a log-likelihood ratio, ``margin`` over
the logarithm of the number of features in ``least_docs`` documents or more); tokens of toxic documents with a marked feature are toxic. All that
is fitted comes from a bounded sample: ``max_labelled`` documents of either
label, lowest hashes first, ``max_windows`` windows of ``WINDOW`` tokens of
either kind, both parameters. Scores read every text in full and in place.

Forward and backward messages are exact for texts of any length: tokens are cut
into blocks, a block's messages are a product of 2 x 2 matrices, and blocks are
chained text by text, so numpy works on all texts of a batch at once.

Defined cases: a null text counts as empty and gets the score of no evidence;
without labels of both kinds the score is the share of toxic ones among the
labels (0 without any); an id labelled both ways is left out of the fit; rows
that share an id are scored one by one; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm import words
from polislake.llm.common import annotate, lowest, pick, stored

BEGINNINGS = (4, 5, 6, 8)
KINDS = 1 + len(BEGINNINGS)
WINDOW, BLOCK = 32, 64
_KIND = words.constants(KINDS, 61)
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def features(t: words.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each token's word and beginnings; 0 where the word is not longer than the beginning or has no letter."""
    out = np.zeros((len(starts), KINDS), np.uint64)
    if not len(starts):
        return out
    place = np.arange(len(t.data))
    letter = _LETTER[t.data]
    after = np.minimum.accumulate(np.where(letter, place, len(t.data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, place, -1))
    first, last = np.minimum(after[starts], ends), before[ends - 1] + 1
    some = np.flatnonzero(first < last)
    first, last = first[some], last[some]
    out[some, 0] = words.hashes(t, first, last, fold=True) * _KIND[0]
    for k, size in enumerate(BEGINNINGS, 1):
        longer = last - first > size
        out[some[longer], k] = words.hashes(t, first[longer], first[longer] + size, fold=True) * _KIND[k]
    return out


@dataclass
class Crf:
    """Weights of known features (sorted hashes; toxic over clean), of moves between the labels, and of the document score."""

    known: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray
    start: np.ndarray
    score: np.ndarray

    def evidence(self, feats: np.ndarray) -> np.ndarray:
        """The log-odds that each token's features give."""
        if not len(self.known):
            return np.full(len(feats), self.bias)
        at = np.minimum(np.searchsorted(self.known, feats), len(self.known) - 1)
        return self.bias + np.where(self.known[at] == feats, self.weight[at], 0).sum(1)

    def marginals(self, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for each token; ``first`` has each text's first token, and one more."""
        counts = np.diff(first)
        blocks = -(-counts // BLOCK)
        block_first = np.concatenate([[0], np.cumsum(blocks)])
        total = int(block_first[-1])
        if not total:
            return np.zeros(0)
        owner = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(len(evidence)) - first[owner]
        block, step = block_first[owner] + inner // BLOCK, inner % BLOCK
        odds = np.ones((BLOCK, total))
        real = np.zeros((BLOCK, total), bool)
        odds[step, block], real[step, block] = np.exp(np.clip(evidence, -30, 30)), True
        move = np.exp(self.move)
        lead = np.exp(self.start)

        def scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = np.maximum(a, b)
            return a / top, b / top

        # Products over each block, for a message that starts as (1, 0) and as (0, 1).
        rows = []
        for one in (0, 1):
            a, b = np.full(total, 1.0 - one), np.full(total, float(one))
            scale = np.zeros(total)
            for i in range(BLOCK):
                na, nb = a * move[0, 0] + b * move[1, 0], (a * move[0, 1] + b * move[1, 1]) * odds[i]
                na, nb = np.where(real[i], na, a), np.where(real[i], nb, b)
                top = np.maximum(na, nb)
                a, b, scale = na / top, nb / top, scale + np.log(top)
            rows.append((a, b, scale))
        (a0, b0, s0), (a1, b1, s1) = rows
        top = np.maximum(s0, s1)
        through = np.stack([a0 * np.exp(s0 - top), b0 * np.exp(s0 - top), a1 * np.exp(s1 - top), b1 * np.exp(s1 - top)])
        # Messages into each block from the left (forward) and from the right (backward), block by block of all texts.
        left, right = np.ones((2, total)), np.ones((2, total))
        for i in range(int(blocks.max())):
            at = block_first[:-1][blocks > i] + i
            if i:
                p = at - 1
                x, y = scaled(left[0, p] * through[0, p] + left[1, p] * through[2, p], left[0, p] * through[1, p] + left[1, p] * through[3, p])
                left[:, at] = x, y
            else:
                # Before the first token a message that the moves turn into the start weights.
                x, y = np.linalg.solve(move.T, lead)
                left[:, at] = np.array([x, y])[:, None]
        for i in range(1, int(blocks.max())):
            at = block_first[1:][blocks > i] - 1 - i
            n = at + 1
            x, y = scaled(through[0, n] * right[0, n] + through[1, n] * right[1, n], through[2, n] * right[0, n] + through[3, n] * right[1, n])
            right[:, at] = x, y
        alpha = np.empty((BLOCK, 2, total))
        a, b = left
        for i in range(BLOCK):
            na, nb = a * move[0, 0] + b * move[1, 0], (a * move[0, 1] + b * move[1, 1]) * odds[i]
            na, nb = scaled(np.where(real[i], na, 1), np.where(real[i], nb, 1))
            a, b = np.where(real[i], na, a), np.where(real[i], nb, b)
            alpha[i] = a, b
        toxic = np.empty((BLOCK, total))
        a, b = right
        for i in range(BLOCK - 1, -1, -1):
            toxic[i] = alpha[i, 1] * b / (alpha[i, 0] * a + alpha[i, 1] * b)
            c = b * odds[i]
            na, nb = scaled(move[0, 0] * a + move[0, 1] * c, move[1, 0] * a + move[1, 1] * c)
            a, b = np.where(real[i], na, a), np.where(real[i], nb, b)
        return toxic[step, block]


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, the log-odds of the largest marginal, the logarithm of the expected number of toxic tokens."""
    run = np.concatenate([[0], np.cumsum(p)])
    most = np.zeros(len(first) - 1)
    some = np.diff(first) > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, first[:-1][some])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log(np.maximum(run[first[1:]] - run[first[:-1]], 0) + 1e-3)], axis=1)


def fit_tokens(x: np.ndarray, y: np.ndarray, real: np.ndarray, size: int, steps: int = 80, rate: float = 0.15, ridge: float = 2e-4) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights from windows: feature numbers (window, token, kind; 0 for none), labels, and which tokens exist. Adam on the mean log-likelihood."""
    n, length, kinds = x.shape
    w, b, move, start = np.zeros(size), np.zeros(1), np.zeros((2, 2)), np.zeros(2)
    params = [w, b, move, start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = max(1, real.sum())
    want = np.stack([(1 - y) * real, y * real], -1).astype(float)
    pairs = np.einsum("nti,ntj->ij", want[:, :-1], want[:, 1:])
    for step in range(1, steps + 1):
        s = (b + w[x].sum(-1)) * real
        unary = np.stack([np.zeros_like(s), s], -1)
        a, z = np.empty((n, length, 2)), np.zeros((n, length, 2))
        a[:, 0] = unary[:, 0] + start
        for i in range(1, length):
            nxt = np.logaddexp(a[:, i - 1, :1] + move[0], a[:, i - 1, 1:] + move[1]) + unary[:, i]
            a[:, i] = np.where(real[:, i, None], nxt, a[:, i - 1])
        for i in range(length - 2, -1, -1):
            after = unary[:, i + 1] + z[:, i + 1]
            back = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            z[:, i] = np.where(real[:, i + 1, None], back, 0)
        norm = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        nodes = np.exp(a + z - norm[:, None, None]) * real[:, :, None]
        both = np.exp(a[:, :-1, :, None] + move + (unary + z)[:, 1:, None, :] - norm[:, None, None, None]) * real[:, 1:, None, None]
        gap = want - nodes
        dw = np.bincount(x.ravel(), np.repeat(gap[:, :, 1].ravel(), kinds), size)
        dw[0] = 0
        grads = [dw / total - ridge * w, np.array([gap[:, :, 1].sum() / total]), (pairs - both.sum((0, 1))) / total - ridge * move, gap[:, 0].sum(0) / total - ridge * start]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return w, float(b[0]), move, start


def fit_score(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * weight.sum() * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * weight.sum() * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 4000, max_windows: int = 4000, max_marked: int = 20000, least_docs: int = 5, margin: float = 1.0) -> Crf | float:
    """A CRF from labelled documents; the share of toxic labels where one kind is missing."""
    known = pick(labels, _id=(id_col, "bigint"), _label=(label_col, "int")).filter("_label in (0, 1) and _id is not null")
    known = stored(known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").select("_id", "_label"), "known")
    texts = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for kind in (0, 1):
        part = lowest(known.filter(F.col("_label") == kind), max_labelled, "_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = stored(texts.join(chosen, "_id"), "labelled")
    # Where ids repeat, as many rows as ids were to be.
    rows = None
    for kind in (0, 1):
        part = lowest(sample.filter(F.col("_label") == kind), max_labelled, "_id", "_text")
        rows = part if rows is None else rows.unionByName(part)
    sample = stored(rows.repartition(8), "sample")
    found = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return sizes.get(1, 0) / max(1, sum(sizes.values()))

    def seen(batches):
        """Each text's distinct features, counted by label over the batch."""
        for batch in batches:
            label = batch.column("_label").to_numpy()
            hashes, toxic = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for t in words.chunks(batch.column("_text")):
                starts, ends, first = words.spans(t)
                feats = features(t, starts, ends)
                for i in range(len(first) - 1):
                    own = np.unique(feats[first[i] : first[i + 1]])
                    hashes.append(own)
                    toxic.append(np.full(len(own), label[t.rows.start + i], np.int64))
            each, at = np.unique(np.concatenate(hashes), return_inverse=True)
            every = np.bincount(at, minlength=len(each))
            bad = np.bincount(at, np.concatenate(toxic), len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(bad), pa.array(every - bad)], ["feature", "bad", "good"])

    counts = stored(sample.mapInArrow(seen, "feature bigint, bad bigint, good bigint").filter("feature <> 0").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts").filter(F.col("bad") + F.col("good") >= least_docs)
    share = found[1] / (found[0] + found[1])
    part = F.col("bad") / (F.col("bad") + F.col("good"))
    ratio = F.col("bad") * F.log(part / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - part) / (1 - share))).otherwise(0)
    lifted = part / share / (part / share + (1 - part) / (1 - share))
    marks = counts.filter((F.col("bad") > 0) & (lifted > 0.9)).withColumn("ratio", ratio).filter(F.col("ratio") >= margin + float(np.log(max(1, counts.count()))))
    marked = np.sort(np.array([r["feature"] for r in marks.orderBy(F.desc("ratio"), "feature").limit(max_marked).collect()], np.int64).view(np.uint64))

    def cut(batches):
        """Windows with one label per token: those of toxic texts that hold a toxic token, and all of clean texts."""
        for batch in batches:
            label = batch.column("_label").to_numpy()
            ids, at, windows, tags = [], [], [], []
            for t in words.chunks(batch.column("_text")):
                starts, ends, first = words.spans(t)
                toxic = np.isin(features(t, starts, ends), marked).any(1) if len(marked) else np.zeros(len(starts), bool)
                data = t.data.tobytes()
                for i in range(len(first) - 1):
                    bad = label[t.rows.start + i] == 1
                    for a in range(first[i], first[i + 1], WINDOW):
                        b = min(a + WINDOW, first[i + 1])
                        if not bad or toxic[a:b].any():
                            ids.append(batch.column("_id")[t.rows.start + i].as_py())
                            at.append(int(a - first[i]))
                            windows.append(data[starts[a] : ends[b - 1]].decode("utf-8", "replace"))
                            tags.append("".join("1" if x else "0" for x in toxic[a:b]) if bad else "0" * int(b - a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(windows, pa.string()), pa.array(tags, pa.string())], ["id", "start", "window", "tags"])

    made = stored(sample.mapInArrow(cut, "id bigint, start bigint, window string, tags string"), "windows")
    rows = []
    for kind in (F.contains("tags", F.lit("1")), ~F.contains("tags", F.lit("1"))):
        rows += lowest(made.filter(kind), max_windows, "id", "start", "window").collect()
    x = np.zeros((len(rows), WINDOW, KINDS), np.uint64)
    y, real = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), bool)
    at = 0
    for t in words.chunks(pa.array([r["window"] for r in rows], pa.string())):
        starts, ends, first = words.spans(t)
        feats = features(t, starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = min(int(b - a), len(rows[at]["tags"]))
            x[at, :n], real[at, :n] = feats[a : a + n], True
            y[at, :n] = [c == "1" for c in rows[at]["tags"][:n]]
            at += 1
    each, often = np.unique(x, return_counts=True)
    vocabulary = each[(often > 1) & (each != 0)]
    number = np.minimum(np.searchsorted(vocabulary, x), max(len(vocabulary) - 1, 0))
    number = np.where(vocabulary[number] == x, number + 1, 0) if len(vocabulary) else np.zeros(x.shape, np.int64)
    w, bias, move, start = fit_tokens(number, y, real, len(vocabulary) + 1)
    told = np.abs(w[1:]) >= 0.01
    model = Crf(vocabulary[told], w[1:][told], bias, move, start, np.zeros(3))

    def summed(batches):
        for batch in batches:
            z = [np.zeros((0, 3))]
            for t in words.chunks(batch.column("_text")):
                starts, ends, first = words.spans(t)
                z.append(summary(model.marginals(model.evidence(features(t, starts, ends)), first), first))
            yield pa.RecordBatch.from_arrays([batch.column("_label"), *[pa.array(c) for c in np.concatenate(z).T.copy()]], ["label", "one", "most", "number"])

    rows = sample.select("_id", "_text", "_label").mapInArrow(summed, "label int, one double, most double, number double").orderBy("label", "most", "number").collect()
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, sizes[1] / found[1], sizes[0] / found[0])
    model.score = fit_score(np.array([tuple(r)[1:] for r in rows]), y, weight)
    return model


def find_toxic(docs: DataFrame, model: Crf | float, text_col: str = "text", sure: float = 0.5) -> DataFrame:
    """``docs`` plus ``_score`` (0 to 1) and ``_toxic_spans``, the places ``start:end`` of toxic tokens in code points, comma-joined."""

    def make(column: pa.Array) -> list[pa.Array]:
        if isinstance(model, float):
            return [pa.array(np.full(len(column), model)), pa.array([""] * len(column), pa.string())]
        scores, spans = [np.zeros(0)], [""] * len(column)
        for t in words.chunks(column):
            starts, ends, first = words.spans(t)
            p = model.marginals(model.evidence(features(t, starts, ends)), first)
            scores.append(1 / (1 + np.exp(-np.clip(summary(p, first) @ model.score, -30, 30))))
            hits = np.flatnonzero(p >= sure)
            if len(hits):
                points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
                owner = np.searchsorted(first, hits, "right") - 1
                begin = points[t.begin[owner]]
                for d, a, b in zip(owner.tolist(), (points[starts[hits]] - begin).tolist(), (points[ends[hits]] - begin).tolist(), strict=True):
                    row = t.rows.start + d
                    spans[row] += f"{',' if spans[row] else ''}{a}:{b}"
        return [pa.array(np.concatenate(scores)), pa.array(spans, pa.string())]

    return annotate(docs, text_col, [("_score", "double"), ("_toxic_spans", "string")], make)
