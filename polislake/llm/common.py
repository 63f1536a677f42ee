"""What the operators of this package share: picking columns, storing intermediates, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polislake.functions.arrays import SLICE, slices, starts

#: The white space of the word and line rules: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """The wanted columns under safe names: ``pick(df, _id=("doc_id", "bigint"))``.

    Columns are found by position, an exact name before one that differs in
    case only, so extra columns with clashing names do no harm.
    """
    places = {}
    for i, c in enumerate(df.columns):
        places.setdefault(c, i)
    for i, c in enumerate(df.columns):
        places.setdefault(c.lower(), i)
    at = {}
    for new, (name, _) in wanted.items():
        if name not in places and name.lower() not in places:
            raise ValueError(f"no column {name!r} among {df.columns}")
        at[new] = places.get(name, places.get(name.lower()))
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{at[new]}").cast(kind).alias(new) for new, (_, kind) in wanted.items()])


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lowest(df: DataFrame, n: int, *key: Column | str, distinct: bool = False) -> DataFrame:
    """``n`` rows or all, those of the lowest key hashes; with ``distinct``, equal rows count once.

    The key must tell rows apart: rows of one key enter or leave together.

    Rows whose hash cannot be among them are dropped before anything is
    sorted, so what tasks hand on stays near ``n`` rows in all, whatever their
    number.
    """
    h = F.xxhash64(*key)
    total = df.count()
    share, every = 8 * n / max(total, 1), df.distinct() if distinct else df
    df = every
    while share < 1:
        df = every.filter(h < int((2 * share - 1) * 2**63))
        if df.limit(n).count() == n:
            break
        # Keys that many rows share, or distinct rows that are few: the bound was too low.
        df, share = every, 8 * share
    return df.orderBy(h, *df.columns).limit(n)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a real column: evaluated once per row, never again inside a lambda that names it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def slice_starts(sizes: Column) -> Column:
    """The sum of all elements before each slice."""
    zero = F.lit(0).cast("bigint")
    return starts(F.transform(slices(sizes), lambda part: F.aggregate(part, zero, lambda a, x: a + x)))


def start_at(sizes: Column, before: Column, i: Column) -> Column:
    """The sum of all elements before the ``i``-th, by way of ``slice_starts``."""
    first = F.floor(i / SLICE).cast("int")
    return F.get(before, first) + F.aggregate(F.slice(sizes, first * SLICE + 1, i - first * SLICE), F.lit(0).cast("bigint"), lambda a, x: a + x)


def annotate(docs: DataFrame, text_col: str, made: list[tuple[str, str]], make) -> DataFrame:
    """``docs`` plus the columns ``made`` (name, type), which ``make(text array)`` returns as Arrow arrays.

    The other columns pass through as they are, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = pick(docs, _text=(text_col, "string")).schema[0].dataType.simpleString()
    at = docs.columns.index(text_col) if text_col in docs.columns else [c.lower() for c in docs.columns].index(text_col.lower())
    flat = docs.toDF(*names).withColumn("_text", F.col(f"_c{at}").cast(text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in flat.drop("_text").schema] + [f"`{n}` {t}" for n, t in made]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = make(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*names, *[n for n, _ in made]])

    out = flat.mapInArrow(run, ", ".join(fields))
    return out.toDF(*docs.columns, *[n for n, _ in made])
