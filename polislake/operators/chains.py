"""Merges followed to their end (E-19, U-02).

A mapping says which row a duplicate is merged into; its target may be a
duplicate itself. Pointer jumping follows all chains at once: each round a row
takes over where its target points, so a chain of length n is followed in
log2(n) rounds, each one equi-join whose right side has one row per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.session import cut_lineage


def followed(mapping: DataFrame, duplicate: str = "duplicate_id", target: str = "target_id") -> DataFrame:
    """``mapping`` with the last row of each chain as the target.

    A duplicate with several targets goes to the smallest. Rows that are merged
    in a circle all go to its smallest id, and so does what leads into it; that
    id itself is no duplicate. NULLs and rows mapped to themselves are left out.
    """
    links = mapping.where(F.col(duplicate).isNotNull() & F.col(target).isNotNull() & (F.col(duplicate) != F.col(target)))
    links = cut_lineage(links.groupBy(F.col(duplicate).alias("id")).agg(F.min(target).alias("to")).withColumn("low", F.col("id")))
    # After as many steps as there are links a row that still moves is on a circle.
    n, steps = links.count(), 1
    step = links
    while n and steps <= 2 * n:
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        jumped = step.join(ahead, "to", "left")
        moving = jumped.agg(F.count("next")).first()[0]
        if not moving:
            break
        step = cut_lineage(jumped.select("id", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("next_low", "low")).alias("low")))
        steps *= 2
    circle = step.select(F.col("id").alias("to"), F.col("low").alias("least"))
    out = step.join(circle, "to", "left").select(F.col("id").alias(duplicate), F.coalesce("least", "to").alias(target))
    return out.where(F.col(duplicate) != F.col(target))
