"""Repeated lines, found with levelled sorted runs of line hashes.

A run holds one row per line key of a batch of documents: 128 bits of hash, the
number of documents with the key, and the largest id among them if no earlier
batch had the key. Batches come in descending id order; each is anti-joined
against the runs so far: the keys that are left are new and bring their owner,
the others add their counts only. Then the batch is written as a run of its own,
sorted by hash. ``FANOUT`` runs of a level are merged into one of the next, so a
key is rewritten a logarithmic number of times. A key's total is the sum over
the runs, its owner the only id that any run holds.

A batch holds ``per_batch`` lines at most, as far as ids tell lines apart (the
lines of one id stay together), and there are ``BATCHES`` of them at least. As
every batch reads the keys of all runs, ``per_batch`` should grow with the
cluster; Spark spills what a task can't hold.

Only DataFrame functions are used; a key found in a third of all lines is one
row per task before anything is shuffled, and the join that brings the verdict
back to the lines is one that adaptive execution can split.

Defined cases: a null or empty text is one empty line, and a null text stays
null where nothing is dropped; rows that share an id count as one document but
are rewritten one by one; rows without id count nowhere and lose nothing; an
empty table gives an empty result; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import SPACES, bind, lower_ascii, pick, stored

FANOUT, BATCHES, PER_BATCH = 3, 4, 200_000_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    core = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(core) == F.char_length(core), F.lower(core)).otherwise(lower_ascii(core))


class Runs:
    """Levelled sorted runs of ``(k1, k2, n_docs, owner)``."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = None
        for run in runs:
            out = run if out is None else out.unionByName(run)
        return out

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds."""
        runs = self.all()
        return keys if runs is None else keys.join(runs.select("k1", "k2"), ["k1", "k2"], "left_anti")

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of ``(k1, k2, n_docs, owner)``; a key that a run already holds leaves its owner there."""
        runs = self.all()
        if runs is not None:
            rest = keys.join(runs.select("k1", "k2"), ["k1", "k2"], "left_semi")
            keys = self.fresh(keys).unionByName(rest.withColumn("owner", F.lit(None).cast("bigint")))
        self._put(0, keys)

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(rows.sortWithinPartitions("k1", "k2"), f"run{level}"))
        if len(self.levels[level]) == FANOUT:
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            self.levels[level] = []
            self._put(level + 1, self._merged(merged))

    def totals(self) -> DataFrame:
        return self._merged(self.all())


def repeated_keys(lines: DataFrame, per_batch: int = PER_BATCH) -> DataFrame:
    """``(k1, k2, n_docs, owner)`` over all ``(_id, k1, k2)`` lines, batch by batch."""
    batches = max(BATCHES, -(-lines.count() // per_batch))
    cuts = lines.agg(F.percentile_approx("_id", [i / batches for i in range(batches - 1, 0, -1)], max(1000, 10 * batches))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    runs = Runs()
    for i in range(len(cuts) + 1):
        batch = lines
        if i < len(cuts):
            batch = batch.filter(F.col("_id") > cuts[i])
        if i:
            batch = batch.filter(F.col("_id") <= cuts[i - 1])
        held = batch.groupBy("k1", "k2", "_id").agg(F.lit(1).alias("one"))
        runs.add(held.groupBy("k1", "k2").agg(F.count("one").alias("n_docs"), F.max("_id").alias("owner")))
    return runs.totals()


def dropped_lines(docs: DataFrame, least_chars: int, least_docs: int, per_batch: int = PER_BATCH) -> DataFrame:
    """``(_id, _mark, drop)``: the places of the lines that each row loses."""
    lines = docs.filter("_id is not null").select("_id", "_mark", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("_id", "_mark", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    lines = stored(lines.select("_id", "_mark", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")), "lines")
    hot = repeated_keys(lines.select("_id", "k1", "k2"), per_batch).filter(F.col("n_docs") >= least_docs)
    gone = lines.join(hot.select("k1", "k2", "owner"), ["k1", "k2"]).filter("_id <> owner")
    return gone.groupBy("_id", "_mark").agg(F.collect_set("pos").alias("drop"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, per_batch: int = PER_BATCH) -> DataFrame:
    """``docs`` plus ``_lines``, ``_dropped`` and ``_kept``, the text of the lines that stay.

    Keys of at least ``least_chars`` code points found in at least
    ``least_docs`` documents lose all their lines except in the largest id.
    """
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    own = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"))
    at = [next(i for i, c in enumerate(docs.columns) if c == name or c.lower() == name.lower()) for name in (id_col, text_col)]
    mark = F.xxhash64("_text")
    gone = dropped_lines(own.withColumn("_mark", mark), least_chars, least_docs, per_batch)
    flat = flat.withColumn("_id", F.col(f"_c{at[0]}").cast("bigint")).withColumn("_text", F.col(f"_c{at[1]}")).withColumn("_mark", mark)
    flat = bind(flat.join(gone, ["_id", "_mark"], "left"), "_split", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(places, lambda p: F.get("_split", p)), "\n"))
    return flat.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.size("_split").cast("bigint").alias("_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("_dropped"), kept.alias("_kept"),
    )


ORACLE = """
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
hot as (select key, max(doc_id) as owner from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, coalesce(hot.owner <> k.doc_id, false) as gone from k left join hot using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by rid
"""
