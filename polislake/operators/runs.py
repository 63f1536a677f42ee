"""Ingestion runs: errors, outcomes, life cycle (A-15, A-19, U-16, ST-09, ST-14, R-13 …)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.operators.tables import top_k

# Error types that mean the source could not be reached.
ACCESS_ERRORS = [
    "ConnectionError", "ConnectTimeout", "HTTPError", "ReadTimeout", "RequestException", "Timeout", "EmptyResponse", "SourceAccessError",
]


def error_histogram(errors: DataFrame, samples: int = 3) -> DataFrame:
    """A-15: errors per type, failed fetches among them and the first few ids."""
    counts = errors.groupBy("error_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("error_type").isin(ACCESS_ERRORS)).alias("failed_fetches")
    )
    first = top_k(errors.select("error_type", "id"), ["error_type"], [F.col("id")], samples)
    shown = first.groupBy("error_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("first_ids"))
    return counts.join(shown, "error_type", "left")


def batch_outcome(batches: DataFrame) -> DataFrame:
    """A-19: ok, partial or failed; failed when systemic, total, or five and more attempts with 80 % lost."""
    lost = (
        F.col("systemic") | (F.col("failed") == F.col("attempted"))
        | ((F.col("attempted") >= 5) & (F.col("failed") * 100 >= F.col("attempted") * 80))
    )
    return batches.withColumn("outcome", F.when(lost, "failed").when(F.col("failed") > 0, "partial").otherwise("ok"))


def finalise_stuck(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """U-16: runs still running after ``hours`` become failed, with a note."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    stuck = (F.col("status") == "running") & (F.col("started_at") < limit)
    return runs.withColumns(
        {
            "finalised": stuck, "status": F.when(stuck, "failed").otherwise(F.col("status")),
            "error_summary": F.when(stuck, F.lit(f"Marked failed: still running after {hours} hours.")),
        }
    )
