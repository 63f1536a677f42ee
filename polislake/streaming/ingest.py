"""Structured Streaming ingestion: bounded batches, natural keys, quarantine (ST-06, ST-07, ST-08, ST-10)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polislake.functions.text import is_blank
from polislake.operators.tables import first_per_key


def write_changes(
    stream: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: Sequence[str], order: Sequence[Column], out: str, checkpoint: str, valid: Column | None = None
) -> StreamingQuery:
    """ST-06/ST-07: parse every micro-batch and store it under its batch id.

    A batch is folded to one row per key and written to its own partition
    folder with overwrite, so a batch that runs again after a lost executor or
    a restart replaces itself. Rows failing ``valid`` go to the quarantine
    folder. The run ends when the backlog present at its start is done; an
    empty backlog leaves an empty table.
    """
    spark = stream.sparkSession
    none = parse(spark.createDataFrame([], stream.schema))
    for kind in ("records",) if valid is None else ("records", "rejects"):
        none.write.mode("overwrite").parquet(f"{out}/{kind}/batch_id=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = parse(batch).persist()
        try:
            good = rows if valid is None else rows.where(F.coalesce(valid, F.lit(False)))
            first_per_key(good, keys, order).write.mode("overwrite").parquet(f"{out}/records/batch_id={batch_id}")
            if valid is not None:
                rows.where(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(changes: DataFrame, keys: Sequence[str], rules: Mapping[str, str], version: str = "batch_id") -> DataFrame:
    """The stored rows after all batches, one per key, by column rule.

    Every rule is an aggregate that combines before the shuffle: overwrite is
    the value of the latest batch, fill the first non-blank, keep the last
    non-blank, greatest the maximum.
    """
    out = []
    for c in changes.columns:
        if c in keys or c == version:
            continue
        rule = rules.get(c, "overwrite")
        full = F.when(~is_blank(F.col(c)), F.struct(F.col(version).alias("v"), F.col(c).alias("x")))
        if rule == "overwrite":
            out.append(F.max_by(F.struct(F.col(c).alias("x")), version)["x"].alias(c))
        elif rule == "keep_if_null_new":
            out.append(F.max(full)["x"].alias(c))
        elif rule == "fill_if_null_old":
            out.append(F.min(full)["x"].alias(c))
        elif rule == "greatest":
            out.append(F.max(c).alias(c))
        elif rule == "least":
            out.append(F.min(c).alias(c))
        else:
            raise ValueError(f"unknown rule {rule}")
    return changes.groupBy(*keys).agg(*out)


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Store every micro-batch of a (stateful) stream under its batch id; an empty backlog leaves an empty table."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(changes: DataFrame, keys: Sequence[str], rules: Mapping[str, str], upto: int, version: str = "batch_id") -> DataFrame:
    """The changes with all batches up to ``upto`` folded into one.

    Folding a prefix and then the rest gives what folding all gives, by every
    rule, so closed batches can be replaced by this table.
    """
    closed = current_rows(changes.where(F.col(version) <= upto), keys, rules, version).withColumn(version, F.lit(upto))
    return closed.select(changes.columns).unionByName(changes.where(F.col(version) > upto))


def deduplicated(changes: DataFrame, keys: Sequence[str], version: str = "batch_id") -> DataFrame:
    """ST-08: every key once, from its first batch, however far apart its arrivals are.

    Batches are stored folded to one row per key; the repeats between batches
    fall away when they are read, so no state has to be kept or dropped.
    """
    rest = [c for c in changes.columns if c not in (*keys, version)]
    return changes.groupBy(*keys).agg(F.min(version).alias(version), *[F.min_by(F.struct(F.col(c).alias("x")), version)["x"].alias(c) for c in rest])


def failure_rates(runs: DataFrame, width: str = "7 days", delay: str | None = None) -> DataFrame:
    """ST-10: runs, failures and last success per source and time window, for batch and stream alike."""
    src = runs.withColumn("_t", F.col("started_at").cast("timestamp"))
    if delay:
        src = src.withWatermark("_t", delay)
    g = src.groupBy(F.window("_t", width).alias("w"), "source_name").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.when(F.col("status") == "completed", F.col("_t"))).alias("last_completed")
    )
    return g.select(F.col("w.start").alias("window_start"), "source_name", "runs", "failed", "last_completed")
