"""Attendance of committee meetings, all people at once (A-03, A-04, A-05, O-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.operators.tables import status_pivot, top_k


def totals(attendance: DataFrame) -> DataFrame:
    """A-03: per person, one counter per status."""
    linked = attendance.where("politician_id is not null")
    return status_pivot(linked, ["politician_id"], "attendance_status", vocab.ATTENDANCE_STATUSES).withColumnRenamed("total", "recorded_meetings")


def at_meetings(attendance: DataFrame, meetings: DataFrame, committees: DataFrame) -> DataFrame:
    """Linked attendance with its meeting and the best known committee name (J-03)."""
    m = meetings.select(F.col("id").alias("meeting_id"), "committee_id", F.col("committee_name").alias("_raw"), F.col("title").alias("meeting_title"), "date", F.col("source_url").alias("_meeting_url"))
    c = committees.select(F.col("id").alias("committee_id"), F.col("name").alias("_name"))
    named = m.join(c, "committee_id", "left").withColumn("committee_name", F.coalesce("_name", "_raw")).drop("_name", "_raw")
    return attendance.where("politician_id is not null").join(named, "meeting_id")


def by_committee(attendance: DataFrame, meetings: DataFrame, committees: DataFrame) -> DataFrame:
    """A-04: per person and committee, counters and their total."""
    joined = at_meetings(attendance, meetings, committees)
    return status_pivot(joined, ["politician_id", "committee_id", "committee_name"], "attendance_status", vocab.ATTENDANCE_STATUSES)


def recent(attendance: DataFrame, meetings: DataFrame, committees: DataFrame, k: int = 10) -> DataFrame:
    """O-02: the ``k`` latest meetings of every person."""
    joined = at_meetings(attendance, meetings, committees)
    order = [F.desc_nulls_last("date"), F.desc("meeting_id"), F.desc("id"), F.col("attendance_status"), F.col("name_raw")]
    out = top_k(joined, ["politician_id"], order, k, rank="position")
    return out.withColumn("source_url", F.coalesce("source_url", "_meeting_url")).drop("_meeting_url")


def summary(attendance: DataFrame, meetings: DataFrame, committees: DataFrame) -> DataFrame:
    """A-05: per person, totals, number of committees, busiest committee and latest meeting.

    One join and one aggregate by person and committee, then one roll-up.
    """
    m = meetings.select(F.col("id").alias("meeting_id"), "committee_id", F.col("committee_name").alias("_raw"), "title", "date", F.lit(True).alias("_met"))
    named = m.join(committees.select(F.col("id").alias("committee_id"), F.col("name").alias("_name")), "committee_id", "left").withColumn("_n", F.coalesce("_name", "_raw"))
    joined = attendance.where("politician_id is not null").join(named, "meeting_id", "left")
    # The latest meeting has the greatest of these; a NULL date sorts below all others.
    place = F.struct(F.col("date"), F.col("meeting_id"), F.col("id"))
    met = F.col("_met").isNotNull()
    latest = F.max(F.when(met, F.struct(place.alias("p"), F.col("title").alias("t")))).alias("_last")
    per = status_pivot(joined, ["politician_id", "_met", "committee_id", "_n"], "attendance_status", vocab.ATTENDANCE_STATUSES, latest)
    busiest = F.min(F.when(met, F.struct((-F.col("total")).alias("t"), F.coalesce("_n", F.lit("")).alias("n"))))
    people = per.groupBy("politician_id").agg(
        *[F.sum(s).alias(s) for s in vocab.ATTENDANCE_STATUSES], F.sum("total").alias("recorded_meetings"), F.nullif(F.count_if(met), F.lit(0)).alias("committees"), busiest.alias("_b"), F.max("_last").alias("_l")
    )
    return people.select(
        "politician_id", *vocab.ATTENDANCE_STATUSES, "recorded_meetings", "committees", F.col("_b.n").alias("busiest_committee"), (-F.col("_b.t")).alias("busiest_total"),
        F.col("_l.t").alias("latest_meeting"), F.col("_l.p.date").alias("latest_date"),
    )
