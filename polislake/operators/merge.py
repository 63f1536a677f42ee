"""Idempotent keyed merges (U-*).

``merge_upsert`` joins on the natural key with a rule per column. The batch is folded to one row per key first, so repeated keys, even
one that fills a third of the batch, cannot multiply.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.functions.text import is_blank
from polislake.operators.chains import followed
from polislake.operators.tables import first_per_key

Rule = str | Column


def _apply(rule: Rule, old: Column, new: Column) -> Column:
    """Column rule for a row present on both sides."""
    if isinstance(rule, Column):
        return rule
    if rule == "overwrite":
        return new
    if rule == "keep_if_null_new":
        return F.when(is_blank(new), old).otherwise(new)
    if rule == "fill_if_null_old":
        return F.when(is_blank(old), new).otherwise(old)
    if rule == "greatest":
        return F.greatest(F.coalesce(old, new), F.coalesce(new, old))
    if rule == "least":
        return F.least(F.coalesce(old, new), F.coalesce(new, old))
    if rule == "never":
        return old
    raise ValueError(f"unknown merge rule {rule}")


def merge_upsert(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], order: Sequence[Column] | None = None
) -> DataFrame:
    """U-01: merged table with ``change``: created, updated or unchanged.

    Keys compare null-safe. Columns without a rule are overwritten when the
    batch carries them and kept otherwise. A rule may be a Column over ``_o_x``
    (stored) and ``_n_x`` (incoming) names. With several rows per key in the
    batch the first under ``order`` counts.
    """
    batch = first_per_key(updates, keys, order) if order else updates
    old = target.select(*[F.col(c).alias(f"_o_{c}") for c in target.columns], F.lit(True).alias("_in_old"))
    new = batch.select(*[F.col(c).alias(f"_n_{c}") for c in batch.columns], F.lit(True).alias("_in_new"))
    on = reduce(and_, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    # A full outer join cannot be split when a key (a NULL, say) is hot; these two can.
    stored = old.select(*[f"_o_{k}" for k in keys]).distinct()
    df = old.join(new, on, "left").unionByName(new.join(stored, on, "left_anti"), allowMissingColumns=True)
    both = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    out = []
    for c in target.columns:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c not in batch.columns:
            value = o
        else:
            value = F.when(both, _apply("never" if c in keys else rules.get(c, "overwrite"), o, n)).when(F.col("_in_new").isNotNull(), n).otherwise(o)
        out.append(value.alias(c))
    change = F.when(both, "updated").when(F.col("_in_new").isNotNull(), "created").otherwise("unchanged")
    return df.select(*out, change.alias("change"))


def insert_only(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key; NULLs compare equal."""
    fresh = rows.dropDuplicates(list(keys))
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    return fresh.join(t, on, "left_anti")


def change_counts(merged: DataFrame) -> DataFrame:
    """U-15: how many rows were created, updated and left alone."""
    return merged.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "unchanged")])


def match_two_keys(updates: DataFrame, target: DataFrame, target_id: str, first: Sequence[str], second: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """U-02/U-07: id of the stored row by the first key, else by the second.

    ``optional`` columns take part in the second key only where the update
    has them.
    """
    a = target.where(reduce(and_, [F.col(c).isNotNull() for c in first])).groupBy(*first).agg(F.min(target_id).alias("_by_first"))
    df = updates.join(a, list(first), "left")
    b = target.where(reduce(and_, [F.col(c).isNotNull() for c in second]))
    plain = b.groupBy(*second).agg(F.min(target_id).alias("_by_second"))
    df = df.join(plain, list(second), "left")
    matched = F.col("_by_second")
    if optional:
        exact = b.groupBy(*second, *optional).agg(F.min(target_id).alias("_by_exact"))
        df = df.join(exact, [*second, *optional], "left")
        has = reduce(and_, [F.col(c).isNotNull() for c in optional])
        matched = F.when(has, F.col("_by_exact")).otherwise(matched)
    return df.withColumn("matched_id", F.coalesce("_by_first", matched)).select(*updates.columns, "matched_id")


def repoint(children: DataFrame, mapping: DataFrame, fk: str, natural_key: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """E-19: children moved from duplicate parents to their targets; collisions keep the target's own row.

    ``mapping`` is ``(duplicate_id, target_id)``; chains of merges are followed to their end.
    """
    m = followed(mapping).select(F.col("duplicate_id").alias(fk), F.col("target_id").alias("_t"))
    df = children.join(m, fk, "left").withColumn("_moved", F.col("_t").isNotNull()).withColumn(fk, F.coalesce("_t", fk)).drop("_t")
    return first_per_key(df, natural_key, [F.col("_moved"), *prefer]).drop("_moved")
