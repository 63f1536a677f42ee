"""Sum-of-squares packing of tokenised documents into sequences.

Texts are tokenised where they lie; only piece lengths are shuffled. Pieces are
dealt by their row number in the stored table into groups of about ``GROUP``
pieces, equal rows included, and each group is packed in one task, longest first: a piece goes where the sum of the squared numbers of
open bins per residual gap becomes smallest, a new bin being one of the choices
(ties: the smallest gap). The number of groups grows with the input, so a task
never holds more; a group leaves a handful of bins partly filled, which is
``O(1 / GROUP)`` of the total.

Defined cases: a null or empty text is its end token alone; rows that share an
id, and rows without one, are packed one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import pick, stored

#: Pieces in a packing group, and words whose ids a Python worker remembers.
GROUP, REMEMBERED = 20_000, 300_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: visible Latin-1 for itself, the others from U+0100 on in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids of whole texts by way of their words, for vocabularies of the ``word_bpe_49k`` kind.

    The tokenizer's own steps are done once for each distinct word: NFC and
    lower case, its splitting pattern, letters for bytes; its BPE model then
    merges. White space always parts tokens, so a text's ids are those of its
    words in order. Texts that hold a special token's string, a separator that
    only Python counts as white space, or a capital sigma, whose lower case
    depends on its place, go through the tokenizer whole.
    """

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + list("\x1c\x1d\x1e\x1fΣ")
        self.merge = self.tokenizer.model.tokenize
        # Fixed value: the splitting pattern of the vocabulary.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.merged.get(part)
        if ids is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            seen = part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()])
            ids = self.merged[part] = np.array([t.id for t in self.merge(seen)], "<u4").tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._part(word)
        if word[-1] in ".,!" and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, self.parts(word)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(w in text for w in self.whole):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (text if text.isascii() else normalize("NFC", text)).lower().split()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self._word(w)
        return b"".join(map(self.known.__getitem__, words))


_made: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    """One per Python worker, so that later tasks know the words of earlier ones."""
    if file not in _made:
        _made[file] = WordIds(file)
    return _made[file]


def _tokenise(file: str, capacity: int, end: int):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def pieces(batches):
        words = word_ids(file)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = words.encode(text.as_py() or "") + last
                for p in range(0, len(whole), 4 * capacity):
                    cut = whole[p : p + 4 * capacity]
                    rows.append((doc_id, p // 4 // capacity, p // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones don't count
    open_: dict[int, list[int]] = {}
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(n[size:]) + size
        left = gaps - size
        change = 2 * (np.where(left > 0, n[left], 0) - n[gaps]) + np.where(left > 0, 2, 1)
        fresh = 2 * n[capacity - size] + 1 if size < capacity else 0
        best = int(np.argmin(change)) if len(gaps) else -1
        if best >= 0 and change[best] <= fresh:
            gap = int(gaps[best])
            b = heapq.heappop(open_[gap])
            n[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            n[gap - size] += 1
            heapq.heappush(open_.setdefault(gap - size, []), b)
    return bins, offsets


def _packer(capacity: int):
    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets).drop(columns="_group")

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1, group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    texts = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    pieces = stored(texts.mapInArrow(_tokenise(tokenizer, capacity, end), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(_packer(capacity), _PIECES + ", sequence_id bigint, offset bigint")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary's file, by the installed package that has it or from /opt/tokenizers."""
    import importlib.util

    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"
