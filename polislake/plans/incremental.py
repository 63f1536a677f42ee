"""Counters, duplicates and snapshot differences kept up to date batch by batch (A, D, X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polislake.operators.buckets import BucketedTable, snapshot_changes
from polislake.plans.registry import query
from polislake.session import shared_folder


def _table(t, name: str, *keys: str) -> BucketedTable:
    return BucketedTable(t.spark, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}", keys)


@query("X04_snapshot_changes", """with a as (select id, concat(title, case when id % 7 = 3 then ' (revised)' else '' end) as title, status from bills where id % 5 <> 1 union all select id + 1000000, title, status from bills where id % 11 = 2)
   select coalesce(a.id, b.id) as id, case when b.id is null then 'added' when a.id is null then 'removed' else 'changed' end as change from bills b full join a on a.id = b.id
   where a.id is null or b.id is null or a.title is distinct from b.title or a.status is distinct from b.status""")
def x04b(t):
    """Added, removed and changed bills between two stored snapshots."""
    b = t.bills.select("id", "title", "status")
    kept = b.where("id % 5 <> 1").withColumn("title", F.when(F.col("id") % 7 == 3, F.concat("title", F.lit(" (revised)"))).otherwise(F.col("title")))
    after = kept.unionByName(b.where("id % 11 = 2").withColumn("id", F.col("id") + 1000000))
    return snapshot_changes(_table(t, "before", "id").create(b), _table(t, "after", "id").create(after))


@query("A06_running_counts", """select party_name, vote_total, count(*) as n from vote_totals where id % 3 <> 2 or id % 4 = 0 group by all""")
def a06b(t):
    """Rows per party and vote total after three batches of additions and one of withdrawals."""
    rows = t.vote_totals.select("id", "party_name", "vote_total")
    state = _table(t, "counts", "party_name", "vote_total")
    state.create(rows.where("id % 3 = 0").groupBy("party_name", "vote_total").agg(F.count("*").alias("n")))
    for part, sign in (("id % 3 = 1", 1), ("id % 3 = 2", 1), ("id % 3 = 2 and id % 4 <> 0", -1)):
        state.add_counts(rows.where(part).select("party_name", "vote_total", F.lit(sign).cast("bigint").alias("n")), "n")
    return state.read()


@query("A10_running_totals", """select party_name, count(*) as n, sum(vote_total) as total, min(vote_total) as least, max(vote_total) as most, count(distinct vote_total) as different from vote_totals where id % 3 <> 2 or id % 4 = 0 group by 1""")
def a10b(t):
    """Count, sum, smallest and largest per party from the running counts, withdrawals included."""
    n = F.col("n")
    return a06b(t).groupBy("party_name").agg(F.sum("n").alias("n"), F.sum(n * F.col("vote_total")).cast("bigint").alias("total"), F.min("vote_total").alias("least"), F.max("vote_total").alias("most"), F.count("vote_total").alias("different"))


@query("D03_running_duplicates", """select name_raw, count(*) as n from attendance where id % 2 = 0 or id % 3 = 0 group by 1 having count(*) > 1""")
def d03b(t):
    """Names held by more than one attendance row after two batches and one of withdrawals."""
    rows = t.attendance.select("id", "name_raw")
    state = _table(t, "names", "name_raw")
    state.create(rows.where("id % 2 = 0").groupBy("name_raw").agg(F.count("*").alias("n")))
    for part, sign in (("id % 2 = 1", 1), ("id % 2 = 1 and id % 3 <> 0", -1)):
        state.add_counts(rows.where(part).select("name_raw", F.lit(sign).cast("bigint").alias("n")), "n")
    return state.read().where("n > 1")
