"""Personal data: base patterns, and spans that a character BiLSTM with a CRF adds.

The base patterns are e-mail addresses, IP addresses, card numbers (Luhn) and
international phone numbers. The network, trained in numpy from labelled spans,
reads windows of ``WIDTH`` characters that overlap by half; each window is
decoded with Viterbi over its BIO tags, and the windows' spans are reconciled
over the whole text: spans of one kind that overlap are joined, of different
kinds the surer one stays, and base spans always stay.

What ``plausible`` accepts holds a place that ``anchors`` finds: the core of an
address with ``@``, ``(at)``, ``[at]`` or ``at`` and a dotted domain, or the
digits of a stretch without letters that are enough for a number. So the windows
that touch one of these are decoded, then every window that touches a span found
so far, until there are no more: a window left out could only add spans that are
dropped, and the result is that of decoding all windows of the text. Texts are
read where they lie and never shuffled; windows go through the network in
batches of bounded size.

Without given labels the base spans of a bounded sample of documents are the
labelled spans: documents in the order of a hash of id and text, as many as give
``max_windows`` windows with a span and as many without (or all documents),
repeated rows once. Other ways of writing the spans join them (spaced or
spelled-out ``@``, addresses without their digits, phone numbers without a
country code, cards in dotted groups), and one right after the other, where the
base patterns run into each other.

Defined cases: a null text counts as empty and has no spans; a sample without
labelled spans trains nothing and the base decides alone; rows that share an id
are read one by one; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import annotate, lowest, pick, stored

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)
WIDTH, STEP, BATCH = 64, 32, 512
_BASE_ANCHOR = re.compile(r"[0-9@]")
# A label of a domain is joined to the next by one of these.
_JOIN = r"(?:\.|\s*[\[(][dD][oO][tT][\])]\s*|\s+[dD][oO][tT]\s+)"
_ADDRESS = re.compile(rf"[\w.%+-]+\s*(?:@|[(\[][aA][tT][)\]]|\s[aA][tT]\s)\s*[\w-]+(?:{_JOIN}[\w-]+)+")
# The core of every address: behind its local part.
_CORES = [re.compile(rf"{sign}\s*[\w-]+{_JOIN}[\w-]") for sign in ("@", r"[aA][tT][\s)\]]")]
# All from the first to the last digit of a stretch without letters, and the other digits that reconcile() may start from to reach one.
_STRETCH = re.compile(r"[0-9](?:[^A-Za-z]*[0-9])?")
_OTHER_DIGITS = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit())
# Where training looks for windows, a wider choice.
_SOME = re.compile(r"[0-9@]|(?i:(?<=\W)at(?=\W))")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always begins at the first digit of a run, so the runs' other digits need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local part, ``@``, dotted domain; every character is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns by start, then kind."""
    if not _BASE_ANCHOR.search(text):
        return []
    out = _emails(text)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def plausible(kind: int, piece: str) -> bool:
    """What an added span of a kind must look like at least."""
    digits = len(_DIGITS.findall(piece))
    if kind == 0:
        return bool(_ADDRESS.fullmatch(piece))
    if kind == 1:
        groups = re.findall("[0-9]+", piece)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not re.search(r"[A-Za-z]", piece)
    if re.search(r"[A-Za-z]", piece):
        return False
    return 13 <= digits <= 19 and luhn("".join(_DIGITS.findall(piece))) if kind == 2 else 9 <= digits <= 15


def encode(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, 127 for the rest; 0 pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 127, codes, 127).astype(np.int64)


class Tagger:
    """Embedding, one LSTM in either direction, a linear layer and CRF transitions."""

    def __init__(self, size: int = 12, hidden: int = 20, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = 1 / np.sqrt(hidden)
        draw = lambda *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"emb": draw(128, size), "wx": draw(2, size, 4 * hidden), "wh": draw(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32),
                  "out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        self.p["b"][:, :, hidden : 2 * hidden] = 1

    def _run(self, ids: np.ndarray, keep: bool):
        """Emissions (windows, characters, tags); the reverse direction reads the window backwards."""
        p, h = self.p, self.hidden
        n, width = ids.shape
        x = p["emb"][np.stack([ids, ids[:, ::-1]])]  # direction, window, character, size
        pre = np.matmul(x.reshape(2, n * width, -1), p["wx"]).reshape(2, n, width, 4 * h).transpose(2, 0, 1, 3) + p["b"]
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, cells, gates = np.empty((width, 2, n, h), np.float32), [], []
        for t in range(width):
            g = pre[t] + np.matmul(state, p["wh"])
            g[..., : 3 * h] *= 0.5
            np.tanh(g, out=g)
            g[..., : 3 * h] = 0.5 * (g[..., : 3 * h] + 1)
            i, f, o, c = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            before, cell = cell, f * cell + i * c
            squashed = np.tanh(cell)
            state = o * squashed
            states[t] = state
            if keep:
                cells.append((before, squashed))
                gates.append(g)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)
        return both @ p["out"] + p["bias"], (x, states, cells, gates, both) if keep else None

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self._run(ids, False)[0]

    def _crf(self, em: np.ndarray, tags: np.ndarray):
        """Gradients of the log-likelihood by emissions, moves and start."""
        move, start = self.p["move"].astype(np.float64), self.p["start"]
        n, width, _ = em.shape
        em = em.astype(np.float64)

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        a, b = np.empty_like(em), np.zeros_like(em)
        a[:, 0] = em[:, 0] + start
        for t in range(1, width):
            a[:, t] = total(a[:, t - 1, :, None] + move, 1) + em[:, t]
        for t in range(width - 2, -1, -1):
            b[:, t] = total(move + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = total(a[:, -1], 1)
        want = np.eye(TAGS)[tags]
        gap = want - np.exp(a + b - z[:, None, None])
        pairs = np.zeros((TAGS, TAGS))
        for t in range(1, width):
            pairs += want[:, t - 1].T @ want[:, t] - np.exp(a[:, t - 1, :, None] + move + (em[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return gap.astype(np.float32), pairs.astype(np.float32), gap[:, 0].sum(0).astype(np.float32)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        em, (x, states, cells, gates, both) = self._run(ids, True)
        gap, pairs, start = self._crf(em, tags)
        n, width = ids.shape
        grad = {"move": pairs, "start": start, "bias": gap.sum((0, 1)), "out": np.einsum("nwh,nwk->hk", both, gap)}
        d_both = (gap @ p["out"].T).transpose(1, 0, 2)
        d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]], axis=1)
        d_pre = np.empty((width, 2, n, 4 * h), np.float32)
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(width - 1, -1, -1):
            g, (before, squashed) = gates[t], cells[t]
            i, f, o, c = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            ds = d_states[t] + d_state
            d_cell = d_cell + ds * o * (1 - squashed**2)
            d = d_pre[t]
            d[..., :h] = d_cell * c * i * (1 - i)
            d[..., h : 2 * h] = d_cell * before * f * (1 - f)
            d[..., 2 * h : 3 * h] = ds * squashed * o * (1 - o)
            d[..., 3 * h :] = d_cell * i * (1 - c**2)
            d_cell = d_cell * f
            d_state = np.matmul(d, p["wh"].transpose(0, 2, 1))
        earlier = np.concatenate([np.zeros_like(states[:1]), states[:-1]])
        flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, width * n, -1)
        grad["wh"] = np.matmul(flat(earlier).transpose(0, 2, 1), flat(d_pre))
        grad["b"] = d_pre.sum((0, 2))[:, None, :]
        xs = flat(x.transpose(2, 0, 1, 3))
        grad["wx"] = np.matmul(xs.transpose(0, 2, 1), flat(d_pre))
        d_x = np.matmul(flat(d_pre), p["wx"].transpose(0, 2, 1))
        grad["emb"] = np.zeros_like(p["emb"])
        order = np.stack([ids, ids[:, ::-1]]).transpose(0, 2, 1).reshape(2, -1)
        np.add.at(grad["emb"], order.ravel(), d_x.reshape(-1, d_x.shape[-1]))
        return grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.03, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(ids), batch):
                part = order[i : i + batch]
                grad = self.gradients(ids[part], tags[part])
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grad.values())) / len(part)
                for k, g in grad.items():
                    g = g / len(part) / max(1.0, size / 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] += rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tags of all windows (Viterbi), and how sure the emissions are of each."""
        em = self.emissions(ids)
        n, width, _ = em.shape
        score, back = em[:, 0] + self.p["start"], np.empty((width, n, TAGS), np.int8)
        for t in range(1, width):
            step = score[:, :, None] + self.p["move"]
            back[t] = step.argmax(1)
            score = step.max(1) + em[:, t]
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        soft = np.exp(em - em.max(-1, keepdims=True))
        soft /= soft.sum(-1, keepdims=True)
        return tags, np.take_along_axis(soft, tags[:, :, None], 2)[:, :, 0]


def anchors(text: str) -> list[tuple[int, int]]:
    """Places one of which every plausible span shares a character with."""
    at = [m.span() for core in _CORES for m in core.finditer(text)] if "." in text or "dot" in text.lower() else []
    if _DIGITS.search(text):
        for m in _STRETCH.finditer(text):
            if m.end() - m.start() >= 7 and (len(_DIGITS.findall(m[0])) >= 9 or len(re.findall("[0-9]+", m[0])) >= 4):
                at.append(m.span())
    if not text.isascii() and (found := _OTHER_DIGITS.intersection(set(text))):
        at += [(i, i + 1) for i, c in enumerate(text) if c in found]
    return at


def _windows(places: list[tuple[int, int]]) -> list[int]:
    """Starts of the windows that touch one of the places."""
    at: set[int] = set()
    for start, end in places:
        at.update(_touching(start, end))
    return sorted(at)


def _touching(start: int, end: int) -> range:
    """Starts of the windows that share a character with a place."""
    return range(max(0, start // STEP - WIDTH // STEP + 1) * STEP, (end - 1) // STEP * STEP + 1, STEP)


def _cut(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    part = codes[start : start + WIDTH]
    out[: len(part)] = part
    return out


def _tags(width: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(width, np.int64)
    for s, k, e in spans:
        tags[s:e] = 2 + 2 * k
        tags[s] = 1 + 2 * k
    return tags


def reconcile(found: list[tuple[int, int, int, float]], base: list[Span], text: str, sure: float) -> list[Span]:
    """All spans of a text from its windows' (start, kind, end, sureness) and its base spans."""
    joined: list[list] = []
    for s, k, e, p in sorted(found, key=lambda x: (x[1], x[0])):
        if joined and joined[-1][1] == k and s < joined[-1][2]:
            joined[-1][2], joined[-1][3] = max(joined[-1][2], e), max(joined[-1][3], p)
        else:
            joined.append([s, k, e, p])
    out = list(base)
    for s, k, e, p in sorted(joined, key=lambda x: (-x[3], x[0])):
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1] in " .,;:\n\t":
            e -= 1
        # A span holds whole numbers.
        while 0 < s < e and text[s].isdigit() and text[s - 1].isdigit():
            s -= 1
        while s < e < len(text) and text[e - 1].isdigit() and text[e].isdigit():
            e += 1
        if p >= sure and s < e and plausible(k, text[s:e]) and all(e <= a or s >= b for a, _, b in out):
            out.append((s, k, e))
    return sorted(out)


def find(texts: list[str], model: Tagger | None, sure: float = 0.8) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return base, base
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []
    codes: dict[int, np.ndarray] = {}
    seen: dict[int, set[int]] = {}
    touched: list[tuple[int, int]] = []

    def flush() -> None:
        if not waiting:
            return
        tags, soft = model.decode(np.stack([w for _, _, w in waiting]))
        for (at, start, _), row, p in zip(waiting, tags, soft, strict=True):
            some = np.flatnonzero(row[: len(texts[at]) - start])
            i = 0
            while i < len(some):
                kind, j = (row[some[i]] - 1) // 2, i + 1
                while j < len(some) and some[j] == some[j - 1] + 1 and row[some[j]] == 2 + 2 * kind:
                    j += 1
                a, b = int(some[i]), int(some[j - 1]) + 1
                found[at].append((start + a, int(kind), start + b, float(p[a:b].mean())))
                touched.extend((at, k) for k in _touching(start + a, start + b))
                i = j
        waiting.clear()

    def add(at: int, start: int) -> None:
        if start not in seen[at]:
            seen[at].add(start)
            waiting.append((at, start, _cut(codes[at], start)))
            if len(waiting) == BATCH:
                flush()

    for at, text in enumerate(texts):
        if starts := _windows(anchors(text)):
            codes[at], seen[at] = encode(text), set()
            for start in starts:
                add(at, start)
    flush()
    while touched:
        more, touched[:] = list(touched), []
        for at, start in more:
            add(at, start)
        flush()
    return base, [reconcile(f, b, t, sure) if f else b for f, b, t in zip(found, base, texts, strict=True)]


def _bare(address: str, rng: np.random.Generator) -> str:
    """An address without digits: dropped or letters for them; in half of the cases without its first domain labels."""
    letters = "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(2, 8)))
    a, _, b = (re.sub("[0-9]+", letters, address) if rng.integers(2) else re.sub(r"[._%+-]*[0-9]+", "", address)).partition("@")
    labels = [x for x in b.split(".") if x]
    return f"{a.strip('.') or 'name'}@{'.'.join(labels[-2:] if rng.integers(2) else labels)}"


def _rewritten(text: str, spans: list[Span], rng: np.random.Generator, bare: bool = False) -> tuple[str, list[Span]]:
    """A window with its spans written in another way, addresses also without digits."""
    out, marks, last = [], [], 0
    for s, k, e in spans:
        piece = text[s:e]
        if k == 0:
            a, _, b = (_bare(piece, rng) if bare else piece).partition("@")
            piece = [f"{a} @ {b}", f"{a}(at){b}", f"{a} [at] {b.replace('.', ' [dot] ')}", f"{a} at {b.replace('.', ' dot ')}"][rng.integers(4)]
        else:
            digits = "".join(_DIGITS.findall(piece))
            if k == 3:
                d = digits[-10:]
                piece = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:2]} {d[:3]} {d[3:]}"][rng.integers(4)]
            elif k == 2:
                piece = [".", "  ", "/", " - "][rng.integers(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
            else:
                piece = [" . ", " .", "[.]", "-"][rng.integers(4)].join(piece.split("."))
        out += [text[last:s], piece]
        begin = sum(map(len, out[:-1]))
        marks.append((begin, k, begin + len(piece)))
        last = e
    new = "".join([*out, text[last:]])[:WIDTH]
    return new, [(s, k, min(e, WIDTH)) for s, k, e in marks if s < WIDTH]


def _joined(text: str, spans: list[Span], pieces: list[tuple[int, str]], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A window in which another labelled piece follows one of its spans: their border is for the tagger to find."""
    i = int(rng.integers(len(spans)))
    kind, piece = pieces[int(rng.integers(len(pieces)))]
    s, _, e = spans[i]
    # The window is moved so that both fit.
    cut = max(0, e + 1 + len(piece) - WIDTH + 4)
    cut = min(cut, s)
    new = f"{text[:e]} {piece}{text[e:]}"[cut : cut + WIDTH]
    marks = [(a, k, b) for a, k, b in spans if b <= e] + [(e + 1, kind, e + 1 + len(piece))] + [(a + 1 + len(piece), k, b + 1 + len(piece)) for a, k, b in spans if a >= e]
    marks = [(a - cut, k, b - cut) for a, k, b in marks]
    return new, [(a, k, b) for a, k, b in marks if a >= 0 and b <= len(new)]


def train(docs: DataFrame, spans: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_windows: int = 400, epochs: int = 20) -> Tagger | None:
    """A tagger from labelled spans ``(id, kind, start, end)``, or from the base spans of a sample."""
    texts = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    if spans is not None:
        given = pick(spans, _sid=(id_col, "bigint"), _kind=("kind", "string"), _start=("start", "bigint"), _end=("end", "bigint"))
        given = given.groupBy("_sid").agg(F.collect_set(F.struct("_start", "_kind", "_end")).alias("_spans"))
        texts = texts.join(given, texts["_id"] == given["_sid"]).select("_id", "_text", F.transform("_spans", lambda s: F.concat_ws(":", s["_kind"], s["_start"], s["_end"])).alias("_spans"))
    else:
        texts = texts.withColumn("_spans", F.lit(None).cast("array<string>"))

    def cut(batches):
        for batch in batches:
            ids, starts, windows, labels = [], [], [], []
            for key, text, marks in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                text = text or ""
                known = base_spans(text) if marks is None else sorted((int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in marks))
                i = 0
                for start in _windows([m.span() for m in _SOME.finditer(text)]):
                    while i < len(known) and known[i][2] <= start:
                        i += 1
                    near, j = [], i
                    while j < len(known) and known[j][0] < start + WIDTH:
                        near.append(known[j])
                        j += 1
                    # A window that cuts a span in two is left to its neighbour.
                    if all(s >= start and e <= start + WIDTH for s, _, e in near) and all(a[2] <= b[0] for a, b in zip(near, near[1:], strict=False)):
                        ids.append(key)
                        starts.append(start)
                        windows.append(text[start : start + WIDTH])
                        labels.append(written([(s - start, k, e - start) for s, k, e in near]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(windows, pa.string()), pa.array(labels, pa.string())], ["id", "start", "window", "spans"])

    texts, total, n = texts.select("_id", "_text", "_spans"), texts.count(), 16 * max_windows
    some = (F.col("spans") != "", F.col("spans") == "")
    while True:
        made = stored(lowest(texts, n, "_id", "_text").repartition(16).mapInArrow(cut, "id bigint, start bigint, window string, spans string"), "windows")
        if n >= total or made.agg(F.least(*[F.count_if(x) for x in some])).first()[0] >= max_windows:
            break
        n *= 8
    rows = []
    for kind in some:
        rows += lowest(made.filter(kind), max_windows, "id", "start", "window", distinct=True).collect()
    rng = np.random.default_rng(1)
    texts_, tags = [], []
    labelled = [(r["window"], [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in rows]
    pieces = [(k, w[s:e]) for w, known in labelled for s, k, e in known]
    for window, known in labelled:
        more = [_rewritten(window, known, rng), _joined(window, known, pieces, rng)] if known else []
        if any(k == 0 for _, k, _ in known):
            more += [_rewritten(window, known, rng, bare=True) for _ in range(3)]
        for text, marks in [(window, known), *more]:
            texts_.append(_cut(encode(text), 0))
            tags.append(_tags(WIDTH, marks))
    if not any(t.any() for t in tags):
        return None
    return Tagger().fit(np.stack(texts_), np.stack(tags), epochs)


def find_personal_data(docs: DataFrame, model: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_n_email`` and so on (base spans), ``_base_sha256`` and ``_spans``."""

    def make(column: pa.Array) -> list[pa.Array]:
        counts, digests, lists = [[] for _ in KINDS], [], []
        for i in range(0, len(column), 200):
            base, every = find([x.as_py() or "" for x in column.slice(i, 200)], model)
            for b, a in zip(base, every, strict=True):
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in b))
                digests.append(hashlib.sha256(written(b).encode()).hexdigest())
                lists.append(written(a))
        return [*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lists, pa.string())]

    made = [(f"_n_{k}", "bigint") for k in KINDS] + [("_base_sha256", "string"), ("_spans", "string")]
    return annotate(docs, text_col, made, make)
