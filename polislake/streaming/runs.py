"""Run life cycle from start and finish events (ST-09, ST-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.functions.text import contains_any

# Errors and wordings that mean a retry may help.
TRANSIENT_TYPES = ["ConnectionError", "ConnectTimeout", "HTTPError", "ReadTimeout", "RequestException", "Timeout"]
TRANSIENT_WORDS = [
    "429", "500", "502", "503", "504", "connection", "fetch failed", "rate limit", "temporarily unavailable", "timeout", "timed out",
]


def life_cycle(events: DataFrame) -> DataFrame:
    """ST-09: one row per run from its start and finish events; works on batch and stream input.

    A run without a finish event is running; it failed when something failed
    and nothing was processed.
    """
    fin = F.col("kind") == "finish"
    g = events.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"), F.max(F.when(fin, F.col("ts"))).alias("finished_at"),
        F.coalesce(F.sum(F.when(fin, F.col("processed"))), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.when(fin, F.col("failed"))), F.lit(0)).alias("failed"),
    )
    status = F.when(F.col("finished_at").isNull(), "running").when((F.col("failed") > 0) & (F.col("processed") == 0), "failed").otherwise("completed")
    return g.withColumn("status", status)


def stuck(events: DataFrame, hours: int, delay: str | None = None) -> DataFrame:
    """U-16/ST-09: starts without a finish within ``hours``, for batch and stream alike.

    ``events`` is ``(run_id, kind, ts)``. As a stream, starts are joined to
    finishes by run and time range; with the watermark ``delay`` a start is
    kept until its time is up, then it comes out as stuck once, and state of
    finished runs is dropped. In append mode only starts whose time was up at
    the watermark come out.
    """
    ts = F.col("ts").cast("timestamp")
    starts = events.where("kind = 'start'").select("run_id", ts.alias("started_at"))
    ends = events.where("kind = 'finish'").select(F.col("run_id").alias("_run"), ts.alias("finished_at"))
    if delay:
        starts, ends = starts.withWatermark("started_at", delay), ends.withWatermark("finished_at", delay)
    in_time = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {int(hours)} hours"))
    joined = starts.join(ends, (F.col("run_id") == F.col("_run")) & in_time, "left")
    return joined.where("finished_at is null").select("run_id", "started_at")


def transient(errors: DataFrame, keys: list[str]) -> DataFrame:
    """ST-14: an item is worth a retry when all its errors look transient."""
    soft = F.col("error_type").isin(TRANSIENT_TYPES) | contains_any(F.lower(F.coalesce("error", F.lit(""))), TRANSIENT_WORDS)
    return errors.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(soft).alias("transient"))
