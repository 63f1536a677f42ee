"""Benchmark passages in documents, with edits: pigeonhole pieces, then Myers' distance.

Texts and items are compared with A-Z in lower case and white-space runs as one
space. An item may be edited ``errors = floor(rate * length)`` times; cut into
``errors + 1`` pieces, at least one piece must occur unchanged, so the exact
hits of all pieces (one automaton over all items) are a complete candidate
list. Each candidate window is verified with Myers' bit-parallel distance, one
machine step per character whatever the number of errors.

The items go to the tasks in blocks of at most ``BLOCK`` characters, one pass
over the documents for each block: a block's automaton has a proven size, and
more items cost more passes, not more memory. Documents are never shuffled.

Defined cases: null, empty and blank texts and items match nothing; an item of
fewer than ``1 / rate`` characters must occur unchanged; rows that share an id
give a row per item and id (the best place); rows without id are reported under
a null id; repeated items are one; an empty table on either side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import LOWER, UPPER, annotate, pick, stored

BLOCK = 4_000_000
_FOLD = str.maketrans(UPPER, LOWER)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_FOUND = "doc_id bigint, item_id bigint, distance int, start bigint, length bigint"


def fold(text: str) -> str:
    return _SPACE.sub(" ", text.translate(_FOLD)).strip(" ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their places."""
    cuts = [round(i * len(item) / (errors + 1)) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """Least distance of the whole item to a part of ``text``, and where that part ends; null beyond ``errors``."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= errors and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """Folded items with their automaton of pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, filed = [], {}
        for item_id, text in sorted(set(items)):
            at = len(self.items)
            errors = int(rate * len(text))
            self.items.append((item_id, text, errors))
            for offset, piece in pieces(text, errors):
                filed.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in filed.items():
            self.automaton.add_word(piece, (len(piece), places))
        if filed:
            self.automaton.make_automaton()
        self.some = bool(filed)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, length) in the folded text: each item's best place."""
        if not self.some or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text):
            for at, offset in places:
                item_id, item, errors = self.items[at]
                begin = last + 1 - size - offset
                # An unchanged item hits with every piece at one start; nothing can beat distance 0.
                if tried.get(at) == begin or best.get(at, (1,))[0] == 0:
                    continue
                tried[at] = begin
                lo, hi = max(0, begin - errors), begin + len(item) + errors
                found = myers(item, text[lo:hi], errors)
                if found and (at not in best or found[0] < best[at][0]):
                    end = lo + found[1]
                    back = myers(item[::-1], text[max(0, end - len(item) - errors) : end][::-1], found[0])
                    length = back[1] if back else len(item)
                    best[at] = (found[0], end - length, length)
        return [(self.items[at][0], *b) for at, b in best.items()]


def _finder(items: list[tuple[int, str]], rate: float):
    def find(batches):
        block = Items(items, rate)
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) if text.is_valid for hit in block.find(fold(text.as_py()))
                    for doc_id in (doc_id.as_py(),)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "start", "length"])

    return find


def _folded(batches):
    for batch in batches:
        texts = [fold(x.as_py() or "") for x in batch.column(1)]
        keep = [i for i, t in enumerate(texts) if t]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([texts[i] for i in keep], pa.string()), pa.array([len(texts[i]) for i in keep], pa.int64())], ["_item", "_text", "_size"])


def blocks(bench: DataFrame, most: int):
    """The folded items, written in numbered blocks of about ``most`` characters and read one block after the other."""
    items = stored(bench.mapInArrow(_folded, "_item bigint, _text string, _size bigint"), "items")
    n = -(-(items.agg(F.sum("_size")).first()[0] or 0) // most)
    if n > 1:
        items = stored(items.withColumn("_block", F.pmod(F.xxhash64("_item", "_text"), F.lit(n))).repartition("_block"), "blocks")
    for i in range(n):
        # The driver holds the items of one block.
        yield [(r["_item"], r["_text"]) for r in (items.filter(F.col("_block") == i) if n > 1 else items).orderBy("_item", "_text").collect()], i == n - 1


def find_items(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, distance, start, length)``: each item a document holds, its best place in the folded text."""
    docs = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    bench = pick(bench, _item=(item_col, "bigint"), _text=(item_text_col, "string")).distinct()
    out = None
    for items, last in blocks(bench, block):
        found = docs.mapInArrow(_finder(items, rate), _FOUND)
        # A block's pass is run and its items let go before the next one is read.
        found = found if last else stored(found, "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    order = F.struct("distance", "start", "length")
    return out.groupBy("doc_id", "item_id").agg(F.min(order).alias("best")).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an item; row by row, nothing is shuffled."""
    bench = pick(bench, _item=(item_col, "bigint"), _text=(item_text_col, "string")).distinct()
    names = docs.columns
    for items, last in blocks(bench, block):

        def make(column: pa.Array, items=items) -> list[pa.Array]:
            known = Items(items, rate)
            return [pa.array([x.is_valid and bool(known.find(fold(x.as_py()))) for x in column], pa.bool_())]

        docs = annotate(docs, text_col, [("_leaked", "boolean")], make).filter("not _leaked").select(*[f"`{c}`" for c in names])
        docs = docs if last else stored(docs, "clean")
    return docs
