"""Bounded sweeps over paged sources with a durable cursor per stream (ST-01 … ST-05, ST-12, ST-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.operators.tables import pct, snapshot_delta

KEY = ["source_name", "stream_name"]
TOTALS = ["total_seen", "total_created", "total_updated", "total_failed"]


def cut(c: Column, most: int | None) -> Column:
    """The first ``most`` characters, all where none is given."""
    return c if most is None else F.left(c, F.lit(most))


def plan_runs(states: DataFrame, pages_per_run: int) -> DataFrame:
    """ST-01: pages the next run of every stream covers, starting at its cursor."""
    if pages_per_run < 1:
        raise ValueError("pages_per_run must be at least 1, sweeps are always bounded")
    last = F.col("page_number") + pages_per_run - 1
    return states.select(*KEY, F.col("page_number").alias("start_page"), F.explode(F.sequence("page_number", last)).alias("page"))


def new_states(streams: DataFrame, states: DataFrame) -> DataFrame:
    """ST-04: get-or-create; streams without a state start at page 0."""
    fresh = streams.select(*KEY).distinct().join(states, KEY, "left_anti")
    zero = {c: F.lit(0).cast("long") for c in ("page_number", *TOTALS, "sweeps_completed")}
    blank = {"source_total": F.lit(None).cast("long"), "last_status": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string")}
    return states.unionByName(fresh.withColumns({**zero, **blank}).select(*states.columns))


def complete(states: DataFrame, runs: DataFrame, error_length: int | None = None) -> DataFrame:
    """ST-02: add the totals of a finished run and move, wrap or keep the cursor.

    ``runs`` has one row per stream: ``pages_attempted, seen, created, updated,
    failed, end_reached, advance, source_total, error``.
    """
    r = runs.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("pages_attempted", "seen", "created", "updated", "failed", "end_reached", "advance", "source_total", "error")])
    df = states.join(r, KEY, "left")
    ran, wrap, move = F.col("_advance").isNotNull(), F.col("_advance") & F.col("_end_reached"), F.col("_advance") & ~F.col("_end_reached")
    out = {t: F.col(t) + F.coalesce(F.col("_" + t.removeprefix("total_")), F.lit(0)) for t in TOTALS}
    out["page_number"] = F.when(wrap, 0).when(move, F.col("page_number") + F.col("_pages_attempted")).otherwise(F.col("page_number"))
    out["sweeps_completed"] = F.col("sweeps_completed") + F.when(wrap, 1).otherwise(0)
    out["source_total"] = F.coalesce("_source_total", "source_total")
    out["last_status"] = F.when(wrap, "completed_end_of_source").when(move, "completed").when(ran, "completed_no_advance").otherwise(F.col("last_status"))
    out["last_error"] = F.when(ran, cut(F.col("_error"), error_length)).otherwise(F.col("last_error"))
    return df.withColumns(out).select(*states.columns)


def fail(states: DataFrame, failures: DataFrame, pages_per_run: int = 1, error_length: int | None = None) -> DataFrame:
    """ST-03: a failed run keeps the cursor unless told to advance (``error, advance`` per stream)."""
    f = failures.select(*KEY, F.col("error").alias("_error"), F.col("advance").alias("_advance"))
    df, hit = states.join(f, KEY, "left"), F.col("_advance").isNotNull()
    return df.withColumns(
        {
            "total_failed": F.col("total_failed") + F.when(hit, 1).otherwise(0), "last_status": F.when(hit, "failed").otherwise(F.col("last_status")),
            "last_error": F.when(hit, cut(F.coalesce("_error", F.lit("")), error_length)).otherwise(F.col("last_error")),
            "page_number": F.col("page_number") + F.when(F.col("_advance"), pages_per_run).otherwise(0),
        }
    ).select(*states.columns)


def reset(states: DataFrame, streams: DataFrame) -> DataFrame:
    """ST-04: named streams start again from page 0 with cleared totals."""
    df = states.join(streams.select(*KEY).distinct().withColumn("_r", F.lit(True)), KEY, "left")
    hit = F.col("_r").isNotNull()
    out = {c: F.when(hit, 0).otherwise(F.col(c)) for c in ("page_number", *TOTALS, "sweeps_completed")}
    out |= {"last_status": F.when(hit, "reset").otherwise(F.col("last_status")), "last_error": F.when(~hit, F.col("last_error"))}
    return df.withColumns(out).select(*states.columns)


def replay(log: DataFrame, pages_per_run: int = 1, error_length: int | None = None) -> DataFrame:
    """ST-05: current state of every stream from its ordered log of runs.

    The fold has a closed form: totals add up since the last reset, the cursor
    adds up since the last reset or wrap, status and error come from the last
    entry. Two combining aggregations replace a walk through the log, so one
    stream may hold any share of it.
    """
    done, lost, cleared = F.col("action") == "complete", F.col("action") == "fail", F.col("action") == "reset"
    wrap = done & F.col("advance") & F.col("end_reached")
    status = (
        F.when(cleared, "reset").when(lost, "failed").when(~F.col("advance"), "completed_no_advance")
        .when(F.col("end_reached"), "completed_end_of_source").otherwise("completed")
    )
    error = F.when(lost, cut(F.coalesce("error", F.lit("")), error_length)).when(done, cut(F.col("error"), error_length))
    marks = log.groupBy(*KEY).agg(
        F.coalesce(F.max(F.when(cleared, F.col("seq"))), F.lit(-1)).alias("_reset"), F.coalesce(F.max(F.when(cleared | wrap, F.col("seq"))), F.lit(-1)).alias("_turn"),
        F.max(F.struct("seq", status.alias("s"), error.alias("e"))).alias("_last"), F.max(F.when(done & F.col("source_total").isNotNull(), F.struct("seq", "source_total"))).alias("_total"),
    )
    live, since = F.col("seq") > F.col("_reset"), F.col("seq") > F.col("_turn")

    def add(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    sums = log.join(marks.select(*KEY, "_reset", "_turn"), KEY).groupBy(*KEY).agg(
        add(since & done & F.col("advance"), F.col("pages_attempted")).alias("_p"), add(since & lost & F.col("advance"), F.lit(pages_per_run)).alias("_q"),
        *[add(live & done, F.col(c)).alias(f"total_{c}") for c in ("seen", "created", "updated")],
        (add(live & done, F.col("failed")) + F.count_if(live & lost)).alias("total_failed"), F.count_if(live & wrap).alias("sweeps_completed"),
    )
    return sums.join(marks, KEY).select(
        *KEY, (F.col("_p") + F.col("_q")).alias("page_number"), *TOTALS, "sweeps_completed", F.col("_total.source_total").alias("source_total"),
        F.col("_last.s").alias("last_status"), F.col("_last.e").alias("last_error"),
    )


def sweep_report(before: DataFrame, after: DataFrame, totals: DataFrame) -> DataFrame:
    """ST-12: growth per table and its share of the known source total (``name, n`` and ``name, source_total``)."""
    d = snapshot_delta(before, after, "name", "n").join(totals, "name", "left")
    return d.withColumn("coverage_pct", pct(F.coalesce("after", F.lit(0)), F.coalesce("source_total", F.lit(0))))


def discover(batches: DataFrame, year: int | None = None, stale_limit: int = 2) -> DataFrame:
    """ST-13: addresses an offset-paged listing yields before it goes stale.

    ``batches`` is ``(doc_type, batch_no, url, label)``. A batch is stale when
    all its addresses were seen earlier; reading a kind stops with the second
    stale batch in a row. Consecutive batches meet by an equi-join on their
    number, not by a window over the whole kind.
    """
    if stale_limit != 2:
        raise ValueError("the stop rule is two stale batches in a row")
    rows = batches.where("coalesce(url, '') <> ''")
    if year is not None:
        rows = rows.where(F.contains(F.concat_ws(" ", "label", "url"), F.lit(str(year))))
    first = rows.groupBy("doc_type", "url").agg(F.min("batch_no").alias("first_no"))
    fresh = first.groupBy("doc_type", F.col("first_no").alias("batch_no")).agg(F.count("*").alias("new"))
    seen = batches.select("doc_type", "batch_no").distinct().join(fresh, ["doc_type", "batch_no"], "left").withColumn("stale", F.col("new").isNull())
    nxt = seen.where("stale").select("doc_type", (F.col("batch_no") + 1).alias("batch_no"))
    stop = seen.where("stale").join(nxt, ["doc_type", "batch_no"], "left_semi").groupBy("doc_type").agg(F.min("batch_no").alias("stop_no"))
    return first.join(stop, "doc_type", "left").where("stop_no is null or first_no <= stop_no").select("doc_type", "url", "first_no")
