"""Quality by line labels: a linear-chain CRF marks each line as content or boilerplate.

Base rules first (too few words, too many repeated three-word windows), then
Viterbi decoding over the lines of the whole text; a document stays if the
words in content lines reach ``least_share`` of its words. Texts are read in
one pass and never shuffled; counts come from running sums over whole batches.

The CRF is trained in numpy on a bounded sample of labelled documents
(``max_labelled`` ids, lowest hashes first). Their texts are cut into sequences
of ``SEQUENCE`` lines, of which ``max_sequences`` with the lowest hashes are
used. Lines of documents labelled good are content, those of bad ones boilerplate; after a
first fit, lines of bad documents that decode as content count as content, and
the weights are fitted again.

Defined cases: a null text counts as empty; a text without words has all counts
0, fails the base rules and is not kept; without labels of both kinds the base
rules decide alone; rows that share an id are judged one by one; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm import words
from polislake.llm.common import annotate, lowest, pick, stored

SEQUENCE = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["bias", "words_3", "words_9", "words_29", "words_more", "symbols", "many_symbols", "capitals", "digits", "shouts", "repeated", "doubled", "seen", "closed", "long_words"]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(chars)] = 1
    return t


_SYMBOLS, _UPPER, _DIGIT, _SHOUT, _CLOSE = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!"), _table(b".!?:;\"'")
_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int32)
_SOLID = _POINT * ~words.SPACE


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    often, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    before[order[1:][same]] = True
    return often, before


def measure(t: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text, and features, word counts and first line (one more than texts) of the lines."""
    rows = len(t.begin) - 1
    starts, ends, first = words.spans(t)
    h = words.hashes(t, starts, ends, fold=False)
    doc = np.repeat(np.arange(rows), np.diff(first))
    salt = words.mix(np.arange(1, rows + 1, dtype=np.uint64))

    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    whole = np.flatnonzero(left >= 3)
    c = words.constants(3, 77)
    window = words.mix(h[whole] * c[0] + h[whole + 1] * c[1] + h[whole + 2] * c[2]) ^ salt[doc[whole]]
    often = whole[_repeats(window)[0]]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[often + k] = True
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[at[1:]] - run[at[:-1]]

    breaks = np.flatnonzero(t.data == 10)
    line_begin = np.concatenate([t.begin[:-1], breaks + 1])
    owner = np.concatenate([np.arange(rows), np.searchsorted(t.begin, breaks, "right") - 1])
    order = np.lexsort((line_begin, owner))
    line_begin, owner = line_begin[order], owner[order]
    line_first = np.searchsorted(owner, np.arange(rows + 1))
    # Empty texts share a place with their neighbours, so lines are parted by words and bytes of their own text.
    edge = np.append(line_begin, t.begin[-1])
    of_bytes = lambda table: sums(table[t.data], edge)
    word_edge = np.searchsorted(starts, edge)
    n_words = np.diff(word_edge)

    run_end = np.append(line_begin[1:], t.begin[-1])
    run_end = np.where(np.append(owner[1:] == owner[:-1], False), run_end - 1, run_end)
    filled = np.flatnonzero(n_words > 0)
    lh = words.hashes(t, line_begin[filled], run_end[filled], fold=False) ^ salt[owner[filled]]
    seen = np.zeros(len(owner), bool)
    seen[filled[_repeats(lh)[1]]] = True

    solid, symbols = of_bytes(_SOLID), of_bytes(_SYMBOLS)
    per_word, per_char = np.maximum(n_words, 1), np.maximum(solid, 1)
    last = np.zeros(len(owner), np.int64)
    last[filled] = ends[word_edge[filled + 1] - 1] - 1
    feats = np.stack([
        np.ones(len(owner)), (n_words > 0) & (n_words <= 3), (n_words > 3) & (n_words <= 9), (n_words > 9) & (n_words <= 29), n_words > 29,
        np.minimum(symbols / per_word, 1), symbols > 0.2 * per_word, of_bytes(_UPPER) / per_char, of_bytes(_DIGIT) / per_char, np.minimum(of_bytes(_SHOUT) / per_word, 1),
        sums(repeated, word_edge) / per_word, sums(doubled, word_edge) / per_word, seen, np.where(n_words > 0, _CLOSE[t.data[last]] if len(t.data) else 0, 0), np.minimum(solid / per_word / 20, 1),
    ], axis=1).astype(np.float32)
    by_doc = lambda x: sums(x, line_first)
    counts = np.stack([np.diff(first), by_doc(solid), by_doc(symbols), by_doc(seen), sums(repeated, first)], axis=1)
    return counts, feats, n_words, line_first


class Crf:
    """Two labels, boilerplate 0 and content 1: node weights, transitions and start."""

    def __init__(self, size: int = len(FEATURES)) -> None:
        self.node, self.move, self.start = np.zeros((size, 2)), np.zeros((2, 2)), np.zeros(2)

    def _marginals(self, x: np.ndarray, real: np.ndarray, head: np.ndarray):
        n, length, _ = x.shape
        unary = x @ self.node
        a, b = np.empty((n, length, 2)), np.zeros((n, length, 2))
        a[:, 0] = unary[:, 0] + self.start * head[:, None]
        for i in range(1, length):
            step = np.logaddexp(a[:, i - 1, :1] + self.move[0], a[:, i - 1, 1:] + self.move[1]) + unary[:, i]
            a[:, i] = np.where(real[:, i, None], step, a[:, i - 1])
        for i in range(length - 2, -1, -1):
            after = unary[:, i + 1] + b[:, i + 1]
            step = np.logaddexp(self.move[:, 0] + after[:, :1], self.move[:, 1] + after[:, 1:])
            b[:, i] = np.where(real[:, i + 1, None], step, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        nodes = np.exp(a + b - z[:, None, None]) * real[:, :, None]
        pairs = np.exp(a[:, :-1, :, None] + self.move + (unary + b)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        return nodes, pairs

    def fit(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, head: np.ndarray | None = None, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
        """Adam on the penalised mean log-likelihood; ``y`` one label per line, ``real`` marks lines that exist, ``head`` sequences that begin a text."""
        head = np.ones(len(x), bool) if head is None else head
        want = np.eye(2)[y] * real[:, :, None]
        want_pairs = want[:, :-1, :, None] * want[:, 1:, None, :]
        params = [self.node, self.move, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = max(1, real.sum())
        for step in range(1, steps + 1):
            nodes, pairs = self._marginals(x, real, head)
            gap = want - nodes
            grads = [np.einsum("nlf,nlk->fk", x, gap), (want_pairs - pairs).sum((0, 1)), gap[head, 0].sum(0)]
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / total - ridge * p
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of every line, text by text (Viterbi)."""
        unary = feats @ self.node
        content, boiler = unary[:, 1].tolist(), unary[:, 0].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        b0, b1 = self.start.tolist()
        out = np.zeros(len(feats), np.int8)
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if begin == end:
                continue
            s0, s1 = boiler[begin] + b0, content[begin] + b1
            back = []
            for i in range(begin + 1, end):
                f0, f1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
                back.append((f0, f1))
                s0, s1 = (s1 + m10 if f0 else s0 + m00) + boiler[i], (s1 + m11 if f1 else s0 + m01) + content[i]
            label = s1 > s0
            out[end - 1] = label
            for i in range(end - 2, begin - 1, -1):
                label = back[i - begin][label]
                out[i] = label
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 3000, max_sequences: int = 6000) -> Crf | None:
    """A CRF from documents labelled 1 (good) or 0 (bad); null without both kinds."""
    known = pick(labels, _id=(id_col, "bigint"), _label=(label_col, "int")).filter("_label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    texts = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))

    def lines(batches):
        for batch in batches:
            for t in words.chunks(batch.column(1)):
                _, feats, _, first = measure(t)
                ids = batch.column(0).slice(t.rows.start, len(first) - 1).to_pylist()
                rows = [(i, a - begin, feats[a : min(end, a + SEQUENCE)].ravel().tolist()) for i, begin, end in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True) for a in range(begin, end, SEQUENCE)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float32())))], ["_id", "at", "lines"])

    # As many of either kind, so that the commoner one does not drown the other.
    half = max_labelled // 2
    chosen = None
    for kind in (0, 1):
        part = lowest(known.filter(F.col("_label") == kind), half, "_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    cut = stored(texts.join(chosen.select("_id"), "_id", "left_semi").mapInArrow(lines, "_id bigint, at bigint, lines array<float>"), "sequences")
    rows = lowest(cut, max_sequences, "_id", "at", "lines").join(chosen, "_id").orderBy("_id", "at", "lines").collect()
    if {r["_label"] for r in rows} != {0, 1}:
        return None
    x = np.zeros((len(rows), SEQUENCE, len(FEATURES)), np.float32)
    real = np.zeros((len(rows), SEQUENCE), bool)
    y = np.zeros((len(rows), SEQUENCE), np.int64)
    for i, r in enumerate(rows):
        f = np.array(r["lines"], np.float32).reshape(-1, len(FEATURES))
        x[i, : len(f)], real[i, : len(f)], y[i] = f, True, r["_label"]
    head = np.array([r["at"] == 0 for r in rows])
    first = Crf().fit(x, y, real, head)
    bad = np.flatnonzero(y[:, 0] == 0)
    at = np.concatenate([[0], np.cumsum(real[bad].sum(1))])
    good = first.decode(x[bad][real[bad]], at).astype(bool)
    again = y[bad]
    again[real[bad]] = good
    y[bad] = again
    return Crf().fit(x, y, real, head)


def judge(docs: DataFrame, model: Crf | None, text_col: str = "text", least_words: int = 50, most_repeats: int = 50, least_share: float = 0.5) -> DataFrame:
    """``docs`` plus ``_n_words`` and the other COUNTS, ``_base_failed``, ``_content_share`` and ``_kept``."""

    def make(column: pa.Array) -> list[pa.Array]:
        parts = []
        for t in words.chunks(column):
            counts, feats, n_words, first = measure(t)
            label = model.decode(feats, first) if model else np.ones(len(feats), np.int8)
            run = np.concatenate([[0], np.cumsum(n_words * label)])
            share = (run[first[1:]] - run[first[:-1]]) / np.maximum(counts[:, 0], 1)
            failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeats * counts[:, 0])
            parts.append((counts, failed, share))
        if not parts:
            parts = [(np.zeros((0, 5), np.int64), np.zeros(0, bool), np.zeros(0))]
        counts, failed, share = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return [*[pa.array(np.ascontiguousarray(c)) for c in counts.T], pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_share))]

    made = [(f"_{c}", "bigint") for c in COUNTS] + [("_base_failed", "boolean"), ("_content_share", "double"), ("_kept", "boolean")]
    return annotate(docs, text_col, made, make)
