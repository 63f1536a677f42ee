"""Session settings shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a side that Catalyst/AQE broadcast; the driver holds every broadcast side and its hash table.
BROADCAST = 1 << 20

#: Settings the operators rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Catalyst sizes a side by its files, which are compressed, and counts neither texts computed nor rows exploded of them:
    # 0.8 MB of bills are 61 MB of words. Only what AQE has measured, or the smallest files, are to be broadcast.
    "spark.sql.sources.fileCompressionFactor": "64",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.ansi.enabled": "true",
    # Deriving "size > 0" filters from explode() evaluates its input twice.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def _bytes(size: str) -> int:
    """A size as Spark writes it: ``-1``, ``256k``, ``10485760b``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere; a smaller broadcast threshold of its own stays.

    Where the session names none, Spark's default of 10 MB holds and is lowered
    too; get() with a default of our own would not show it.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        held = spark.conf.get(key)
        if held and held != "<undefined>" and _bytes(held) > BROADCAST:
            spark.conf.set(key, str(BROADCAST))
    return spark


def local_session(cpus: str | int = "*", app: str = "polislake", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POLISLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Uses the folder the cluster names in ``spark.checkpoint.dir``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def if_small(stored: DataFrame) -> DataFrame:
    """A stored table of strings, broadcast where it measures no more than the session lets Catalyst broadcast.

    Catalyst has estimates only for what is stored, and would shuffle a large
    other side before it knows better.
    """
    most = min(BROADCAST, _bytes(stored.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")))
    row = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 64 for c in stored.columns), F.lit(0))
    return F.broadcast(stored) if (stored.agg(F.sum(row)).first()[0] or 0) <= most else stored
