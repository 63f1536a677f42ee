"""Word and shingle hashes of whole Arrow string batches in numpy.

Words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased on request.
A word's hash is a polynomial over its bytes modulo 2**64, taken from one
running sum over the batch, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is cut at white space for hashing only.
SEGMENT = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = constants(64, 23)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 1)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


@dataclass
class Texts:
    """Some texts of a batch: their bytes, and where each begins."""

    rows: slice
    data: np.ndarray
    begin: np.ndarray  # one more than texts


def chunks(column: pa.Array, most: int = SEGMENT) -> Iterator[Texts]:
    """Runs of texts of about ``most`` bytes, at least one text each; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    begin = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(begin)[np.asarray(column.is_null())] != 0).any():
        column = column.fill_null("")
        yield from chunks(column, most)
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + most, "right")) - 1)
        yield Texts(slice(i, j), data[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
        i = j


def _spans(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~solid[:-1]
    fresh[begin] = True
    starts = np.flatnonzero(solid & fresh[:-1])
    over = np.ones(len(data), bool)
    over[:-1] = ~solid[1:]
    inner = begin[(begin > 0)] - 1
    over[inner] = True
    return starts, np.flatnonzero(solid & over) + 1


def spans(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (one more than texts)."""
    if not len(t.data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(t.begin), np.int64)
    starts, ends = _spans(t.data, t.begin)
    return starts, ends, np.searchsorted(starts, t.begin)


def hashes(t: Texts, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash for every word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo)
        seen = t.data[lo:hi]
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[seen] if fold else seen] * up[: hi - lo], out=run[1:])
        out[i:j] = (run[ends[i:j] - lo] - run[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each text, and each text's first one.

    A text of fewer words has its whole sequence as one; without words, none.
    """
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        total += padded[k : k + len(words)] * _STEP[k]
    left = np.repeat(first[1:], counts) - np.arange(len(words))
    out = total[left >= n]
    if (short := np.flatnonzero((counts > 0) & (counts < n))).size:
        full = np.zeros(begin[-1], np.uint64)
        at = np.ones(begin[-1], bool)
        at[begin[short]] = False
        full[at] = out
        for d in short:
            w = words[first[d] : first[d + 1]]
            full[begin[d]] = np.append(w * _STEP[: len(w)], _STEP[n + len(w)]).sum(dtype=np.uint64)
        out = full
    return mix(out), begin
