"""Near duplicates: MinHash bands propose, Odd sketches sift, full shingle sets decide.

1. One pass over the texts makes a document's distinct word shingles, a
   fingerprint of the set, ``BANDS * ROWS`` MinHash samples, a band key for
   every ``ROWS`` of them, and the Odd sketch: every sample toggles one bit, so
   the XOR of two sketches counts the samples in which two documents differ.
2. Documents of equal sets are one class from here on, so thousands of copies
   cost one row.
3. Within a bucket of equal band keys, one member is paired with all others
   (never all with all): the one whose buckets hold the most members, which in
   a group of copies is the text that the others were made from. Pairs whose
   sketches differ in more bits than ``sketch_bound`` allows cannot reach the
   similarity and fall away; the others are confirmed on the full sets.
4. Buckets that still hold several components get the exact rest: every member
   outside the bucket's largest component meets the members of other
   components. Two members of one bucket are both known by how they differ from
   its chosen member: a bitmap of the shingles that each lacks, and the number
   that each adds and shares with anybody. The two bitmaps together bound what
   the two can have in common from above; pairs that cannot reach the
   similarity fall away, and what is left is confirmed on the full sets.

A pair of similarity 0.8 shares no bucket with probability 1.5e-5, and the
sketch loses one with probability 1e-6.

Defined cases: null or empty texts and texts without words have an empty set
and are linked with nothing; rows that share an id are one document, judged by
its largest set; a row without id is never linked (one row, component null,
kept); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.llm import words
from polislake.llm.common import pick, stored
from polislake.llm.components import components

ROWS, BANDS, BITS = 5, 28, 1024
_SIGNED = "_id bigint, n int, f1 bigint, f2 bigint, sketch array<bigint>, bands array<bigint>"


def sketch_bound(percent: int, samples: int = ROWS * BANDS, loss: float = 1e-6) -> int:
    """Most differing sketch bits of two sets of that similarity, but for a chance of ``loss``.

    A differing sample toggles at most two bits, and the number of differing
    samples is binomial.
    """
    p, tail, d = 1 - percent / 100, 1.0, -1
    while tail > loss and d < samples:
        d += 1
        tail -= comb(samples, d) * p**d * (1 - p) ** (samples - d)
    return 2 * d


def _distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in order, and where each text's begin."""
    parts = [np.unique(h[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    counts = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum(counts)])


def _shingled(column: pa.Array, n: int):
    for t in words.chunks(column):
        starts, ends, first = words.spans(t)
        h, begin = words.shingles(words.hashes(t, starts, ends, fold=True), first, n)
        yield t, *_distinct(h, begin)


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _signer(n: int):
    samples = ROWS * BANDS
    times = (words.constants(samples, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    plus = (words.constants(samples, 202) >> np.uint64(32)).astype(np.uint32)
    salt = words.constants(samples, 303)

    def sign(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for t, h, begin in _shingled(batch.column(1), n):
                rows = len(t.begin) - 1
                counts = np.diff(begin)
                some = np.flatnonzero(counts)
                low = np.zeros((rows, samples), np.uint32)
                f = np.zeros((2, rows), np.uint64)
                if some.size:
                    x, at = (h >> np.uint64(32)).astype(np.uint32), begin[some]
                    for i in range(samples):
                        low[some, i] = np.minimum.reduceat((x ^ plus[i]) * times[i], at)
                    f[0, some] = np.add.reduceat(words.mix(h + salt[0]), at)
                    f[1, some] = np.add.reduceat(words.mix(h ^ salt[1]), at)
                marked = words.mix(low.astype(np.uint64) + salt)
                place = np.arange(rows)[:, None] * BITS + (marked % np.uint64(BITS)).astype(np.int64)
                odd = (np.bincount(place.ravel(), minlength=rows * BITS) & 1).astype(np.uint8)
                sketch = np.packbits(odd).view(np.int64)
                band = words.mix(marked.reshape(rows, BANDS, ROWS).sum(axis=2, dtype=np.uint64)).view(np.int64)
                out.append(pa.RecordBatch.from_arrays([
                    ids.slice(t.rows.start, rows), pa.array(counts.astype(np.int32)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
                    _lists(sketch, BITS // 64), _lists(np.ascontiguousarray(band).ravel(), BANDS),
                ], ["_id", "n", "f1", "f2", "sketch", "bands"]))
                if sum(b.num_rows for b in out) >= 2000:
                    yield from out
                    out = []
            yield from out

    return sign


def _sets(n: int):
    def make(batches):
        for batch in batches:
            for t, h, begin in _shingled(batch.column(1), n):
                values = pa.array(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.rows.start, len(t.begin) - 1), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), values)], ["_id", "grams"])

    return make


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """One row per id: set size, set fingerprint, Odd sketch and band keys."""
    signed = docs.select("_id", "_text").mapInArrow(_signer(n), _SIGNED)
    whole = F.max_by(F.struct("n", "f1", "f2", "sketch", "bands"), F.struct("n", "f1", "f2"))
    return signed.groupBy("_id").agg(whole.alias("s")).select("_id", "s.*")


def _differing() -> F.Column:
    return F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``(_id, grams)`` of the documents named; the one step that shuffles texts, by the same plan at every size."""
    some = docs.join(ids.hint("merge"), "_id", "left_semi").select("_id", "_text")
    sets = some.mapInArrow(_sets(n), "_id bigint, grams array<bigint>")
    return sets.groupBy("_id").agg(F.max_by("grams", F.size("grams")).alias("grams"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity, as edges ``(u, v)``."""
    left = sets.select(F.col("_id").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("_id").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b")).cast("bigint")
    found = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("both", both)
    return found.filter(100 * F.col("both") >= percent * (F.size("grams_a") + F.size("grams_b") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


#: Bits of the bitmap of lacking shingles, in words of 64.
WORDS = 16


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(p, _id, n_p, lacks, adds)``: how a set differs from a chosen one, lacking shingles as a bitmap."""
    chosen = sets.select(F.col("_id").alias("p"), F.col("grams").alias("grams_p"))
    both = pairs.join(chosen.hint("merge"), "p").join(sets.hint("merge"), "_id")
    both = both.select("p", "_id", F.size("grams_p").alias("n_p"), F.size("grams").alias("n"), F.array_except("grams_p", "grams").alias("gone"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate("gone", F.lit(0).cast("bigint"), lambda w, x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(WORDS - 1)) == i, w.bitwiseOR(bit(x))).otherwise(w))
    return both.select("p", "_id", "n_p", F.array(*[word(i) for i in range(WORDS)]).alias("lacks"), (F.col("n") - F.col("n_p") + F.size("gone")).alias("adds"))


def _reachable(percent: int) -> F.Column:
    """Whether two sets of a bucket can be that similar.

    What both have of the chosen set is at most what neither lacks; beyond it
    they can share no more than the one that adds less that somebody shares.
    """
    lacking = F.aggregate(F.zip_with("lacks_a", "lacks_b", lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda a, x: a + x)
    most = F.col("n_p_a") - lacking + F.least("adds_a", "adds_b")
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(_id, n_shingles, component_id, kept)``: the component of every document.

    ``n``: words in a shingle; ``percent``: the least Jaccard similarity of a link.
    """
    docs = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    signed = stored(signatures(docs, n), "signatures")
    known = signed.filter("_id is not null and n > 0")
    reps = known.groupBy("f1", "f2").agg(F.min(F.struct("_id", "n", "sketch", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = stored(reps.select("f1", "f2", "copies", "r.*"), "classes")
    several = reps.filter("copies > 1").select("f1", "f2", F.col("_id").alias("class"))
    copies = stored(known.select("_id", "f1", "f2").join(several, ["f1", "f2"]).filter("_id <> class").select("_id", "class"), "copies")

    keyed = reps.select("_id", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(keyed.join(sizes.hint("merge"), "key"), "members")
    scores = members.groupBy("_id").agg(F.sum("size").alias("score"))
    near = stored(reps.select("_id", "n", "sketch").join(scores.hint("merge"), "_id"), "near")
    sets = stored(shingle_sets(docs, near.select("_id"), n), "sets")
    bound = sketch_bound(percent)

    scored = members.select("key", "_id").join(near.select("_id", "score"), "_id")
    pivots = stored(scored.groupBy("key").agg(F.max_by("_id", F.struct("score", -F.col("_id"))).alias("p")), "pivots")
    stars = members.select("key", "_id").join(pivots, "key").filter("_id <> p")
    stars = stars.select(F.least("_id", "p").alias("a"), F.greatest("_id", "p").alias("b")).distinct()
    sketch_a, sketch_b = (near.select(F.col("_id").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    stars = stored(stars.join(sketch_a, "a").join(sketch_b, "b").filter(_differing() <= bound).select("a", "b"), "stars")
    edges = stored(confirm(stars, sets, percent), "links")
    roots = stored(components(edges), "roots")

    # Buckets of several components: whoever is outside the largest one meets the others.
    placed = members.join(roots, members["_id"] == roots["node"], "left").select("key", "_id", F.coalesce("root", "_id").alias("root"))
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = groups.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main")).filter("roots > 1")
    open_ = stored(placed.join(mixed.select("key", "main"), "key"), "open")
    held = open_.select("_id").distinct().join(sets, "_id").select("_id", F.explode("grams").alias("gram"))
    lone = held.groupBy("gram").agg(F.count("*").alias("c"), F.min("_id").alias("_id")).filter("c = 1").groupBy("_id").agg(F.count("*").cast("int").alias("lone"))
    facts = open_.select("_id").distinct().join(near, "_id").join(lone, "_id", "left").select("_id", "n", "sketch", F.coalesce("lone", F.lit(0)).alias("lone"))
    facts = stored(facts.filter(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n")), "facts")
    open_ = stored(open_.join(facts, "_id").join(pivots, "key"), "open")
    gaps = stored(differences(open_.select("p", "_id").distinct(), sets), "differences")
    open_ = open_.join(gaps, ["p", "_id"]).withColumn("adds", F.greatest(F.col("adds") - F.col("lone"), F.lit(0)))
    open_ = stored(open_.drop("lone"), "open")
    side = lambda x: [F.col("_id").alias(x), F.col("root").alias(f"root_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "n_p", "lacks", "adds")]]
    rest = open_.filter("root <> main").select("key", *side("a"))
    every = open_.select("key", *side("b"), (F.col("root") == F.col("main")).alias("in_main"))
    again = rest.join(every, "key").filter("root_a <> root_b and (in_main or a < b)").filter(_reachable(percent)).filter(_differing() <= bound)
    again = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    edges = edges.unionByName(confirm(stored(again, "pairs"), sets, percent))
    roots = stored(components(edges), "roots")

    judged = signed.select("_id", "n").join(copies, "_id", "left").withColumn("class", F.coalesce("class", "_id"))
    judged = judged.join(roots, judged["class"] == roots["node"], "left").select("_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("root", "class").alias("component_id"))
    return judged.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))
