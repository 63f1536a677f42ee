"""Election vote totals: validation, keys, roll-ups (V-01 … V-05, A-11, S-02)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.functions.text import blank_to_null, is_blank


def identifier_rollup(totals: DataFrame, id_col: str, name_col: str, extra: Sequence[str] = (), require_present: bool = True) -> DataFrame:
    """A-11: rows and votes per identifier, with one manifest and one address as evidence."""
    src = totals.where(~is_blank(F.col(id_col))) if require_present else totals
    return src.groupBy(*extra, id_col, name_col).agg(
        F.count("*").alias("n"), F.sum("vote_total").alias("votes"), F.min("manifest_key").alias("manifest"), F.min("source_url").alias("url")
    )


def validate(rows: DataFrame) -> DataFrame:
    """V-01: verdict per raw result row; ``vote_total`` is set on valid rows only."""
    digits = F.replace(F.coalesce(blank_to_null(F.col("votes")), F.lit("")), F.lit(","), F.lit(""))
    clean = {c: blank_to_null(F.col(c)) for c in ("contest_id", "party_id", "candidate_id")}
    # Column by column in steps of their own: a step reads the values of the one before instead of computing them again.
    df = rows.withColumns({**clean, "_d": digits}).withColumn("_n", F.when(F.col("_d").rlike(r"^\d+$"), F.col("_d").try_cast("bigint")))
    failure = F.when(F.col("contest_id").isNull() | F.col("party_id").isNull(), "Contest_ID and Party_ID are required").when(F.col("_n").isNull(), "Votes must be a non-negative integer")
    df = df.withColumn("failure", failure)
    return df.withColumn("vote_total", F.when(F.col("failure").isNull(), F.col("_n"))).drop("_d", "_n")


def keyed_totals(valid: DataFrame) -> DataFrame:
    """V-01/P-27: valid rows with their identity key and row checksum."""
    from polislake.functions import keys

    raw = ["contest_id", "contest_name", "province_id", "province_name", "party_id", "party_name", "candidate_id", "candidate_name", "votes"]
    return valid.where("failure is null").withColumns(
        {
            "result_key": keys.result_key(F.col("manifest_key"), F.col("contest_id"), F.col("province_id"), F.col("party_id"), F.col("candidate_id")),
            "row_checksum": keys.row_checksum({c: F.col(c) for c in raw}),
        }
    )


def ingest_report(checked: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """V-02: counters of one ingestion in one row."""
    good = keyed_totals(checked)
    per_key = good.groupBy("result_key").agg(F.sum("vote_total").alias("votes")).join(stored_keys.select("result_key").distinct().withColumn("_old", F.lit(True)), "result_key", "left")
    changes = per_key.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("updated"), F.coalesce(F.sum("votes"), F.lit(0)).alias("vote_sum"))
    # Rows and identifiers are counted in one pass: a row counts itself, its party and its candidate; equal ones combine before the shuffle.
    ok = F.col("failure").isNull()

    def part(kind: str, holds: Column, id_col: str | None = None, name_col: str | None = None) -> Column:
        value = lambda c: F.col(c) if c else F.lit(None).cast("string")
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), value(id_col).alias("id"), value(name_col).alias("name")))

    pairs = {"party": ("party_id", "party_name"), "candidate": ("candidate_id", "candidate_name")}
    parts = F.array_compact(F.array(part("valid", ok), part("failed", ~ok), *[part(k, ok & (F.col(i).isNotNull() | F.col(n).isNotNull()), i, n) for k, (i, n) in pairs.items()]))
    seen = checked.select(F.explode(parts).alias("p")).groupBy("p.kind", "p.id", "p.name").agg(F.count("*").alias("n"))
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    base = seen.agg(
        total("valid", "failed").alias("input_rows"), total("valid").alias("valid_rows"), total("failed").alias("failed_rows"),
        *[F.count_if(F.col("kind") == k).alias(f"unresolved_{plural}") for k, plural in (("party", "parties"), ("candidate", "candidates"))],
    )
    out = one_row([base, changes]).withColumn("exit_code", F.when(F.col("valid_rows") == 0, 1).otherwise(0))
    return out.select("input_rows", "valid_rows", "failed_rows", "created", "updated", "vote_sum", "unresolved_parties", "unresolved_candidates", "exit_code")


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Several one-row results side by side: stacked, then each column's only value is taken."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def coverage_report(manifests: DataFrame, totals: DataFrame) -> DataFrame:
    """V-03: counters on manifests and vote totals, one row."""
    m = manifests.agg(
        F.count("*").alias("manifests"), F.count_if("reachable").alias("reachable"), F.count_if(F.col("source_type").isin("csv", "json", "xlsx")).alias("structured"),
        F.count_if(is_blank(F.col("source_url"))).alias("manifests_without_url"),
    )
    v = totals.agg(F.count("*").alias("totals"), F.coalesce(F.sum("vote_total"), F.lit(0)).alias("vote_sum"), F.count_if(is_blank(F.col("source_url"))).alias("totals_without_url"), F.count_if(is_blank(F.col("manifest_key"))).alias("totals_without_key"))
    used = totals.select("manifest_key").distinct()
    lonely = manifests.join(used, "manifest_key", "left_anti").agg(F.count("*").alias("manifests_without_totals"))
    orphan = totals.join(manifests.select("manifest_key"), "manifest_key", "left_anti").agg(F.count("*").alias("totals_without_manifest"))
    dup = totals.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    return one_row([m, v, lonely, orphan, dup])


def traffic_light(report: DataFrame) -> DataFrame:
    """V-04: red on integrity failures, yellow on gaps, else green."""
    broken = F.col("totals_without_manifest") + F.col("manifests_without_url") + F.col("totals_without_url") + F.col("totals_without_key") + F.col("duplicate_keys")
    gaps = (F.col("manifests") == 0) | (F.col("totals") == 0) | (F.col("manifests_without_totals") > 0)
    return report.withColumn("readiness", F.when(broken > 0, "red").when(gaps, "yellow").otherwise("green"))


def unresolved_identifiers(totals: DataFrame) -> DataFrame:
    """V-05: identifiers still without an internal match, per kind, in one pass over grouping sets."""
    kinds = {"party": "party_id", "candidate": "candidate_id", "geography": "geography_id", "contest": "contest_id"}
    ids = F.array(*[F.struct(F.lit(k).alias("kind"), blank_to_null(F.col(c)).alias("identifier")) for k, c in kinds.items()])
    long = totals.select("vote_total", "manifest_key", F.explode(ids).alias("i")).where("i.identifier is not null")
    return long.groupBy("i.kind", "i.identifier").agg(F.count("*").alias("n"), F.sum("vote_total").alias("votes"), F.min("manifest_key").alias("manifest"))
