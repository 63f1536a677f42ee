"""Sweeps, runs and streaming ingestion (ST)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from polislake.plans.bindings import VIEWS
from polislake.plans.registry import query
from polislake.session import shared_folder
from polislake.streaming import ingest, runs, sweep


def _stream(t, table: str):
    """A stream over one supplied table, a single file or a folder of part files: a glob path may be either."""
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.sf_dir}/{table}.parque[t]")


def _folder(t) -> str:
    """A new folder for a streaming run below the shared folder."""
    return f"{shared_folder(t.spark)}/stream-{os.urandom(8).hex()}"


# Current state of every stream after its log, written with windows so that it shares nothing with the aggregation.
_LOG = """l as (select *, action = 'complete' and advance and end_reached as wrap, max(case when action = 'reset' then seq else -1 end) over w as r,
     max(case when action = 'reset' or (action = 'complete' and advance and end_reached) then seq else -1 end) over w as w2, row_number() over (partition by source_name, stream_name order by seq desc) as rn from sweep_log window w as (partition by source_name, stream_name)),
   state as (select source_name, stream_name, coalesce(sum(case when seq > w2 and advance and action = 'complete' then pages_attempted when seq > w2 and advance and action = 'fail' then 1 else 0 end), 0)::bigint as page_number,
     coalesce(sum(seen) filter (where seq > r and action = 'complete'), 0)::bigint as total_seen, coalesce(sum(created) filter (where seq > r and action = 'complete'), 0)::bigint as total_created, coalesce(sum(updated) filter (where seq > r and action = 'complete'), 0)::bigint as total_updated,
     coalesce(sum(case when action = 'complete' then failed when action = 'fail' then 1 end) filter (where seq > r), 0)::bigint as total_failed, count(*) filter (where seq > r and wrap) as sweeps_completed, arg_max(source_total, seq) filter (where action = 'complete' and source_total is not null) as source_total,
     max(case when rn = 1 then case when action = 'reset' then 'reset' when action = 'fail' then 'failed' when not advance then 'completed_no_advance' when end_reached then 'completed_end_of_source' else 'completed' end end) as last_status,
     max(case when rn = 1 then case when action = 'fail' then coalesce(error, '') when action = 'complete' then error end end) as last_error from l group by 1, 2)"""


@query("ST05_replay_sweep_log", f"with {_LOG} select * from state")
def st05(t):
    return sweep.replay(t.sweep_log)


@query("ST01_plan_runs", f"with {_LOG} select source_name, stream_name, page_number as start_page, page_number + unnest(range(3)) as page from state")
def st01(t):
    return sweep.plan_runs(sweep.replay(t.sweep_log), 3)


_RUN = "select source_name, stream_name, arg_max(pages_attempted, seq) as pa, arg_max(seen, seq) as sn, arg_max(created, seq) as cr, arg_max(updated, seq) as up, arg_max(failed, seq) as fl, arg_max(end_reached, seq) as en, arg_max(advance, seq) as ad, max(seq) as seq from sweep_log group by 1, 2"


def _last_runs(t):
    cols = ["pages_attempted", "seen", "created", "updated", "failed", "end_reached", "advance"]
    last = t.sweep_log.groupBy(*sweep.KEY).agg(F.max(F.struct("seq", *cols)).alias("b"))
    return last.select(*sweep.KEY, "b.*").withColumns({"source_total": F.lit(None).cast("long"), "error": F.lit(None).cast("string")})


@query("ST02_complete_runs", f"""with {_LOG}, r as ({_RUN}) select source_name, stream_name, case when ad and en then 0 when ad then page_number + pa else page_number end as page_number, total_seen + coalesce(sn, 0) as total_seen, sweeps_completed + case when ad and en then 1 else 0 end as sweeps_completed,
   case when ad and en then 'completed_end_of_source' when ad then 'completed' when not ad then 'completed_no_advance' else last_status end as last_status from state left join r using (source_name, stream_name)""")
def st02(t):
    return sweep.complete(sweep.replay(t.sweep_log), _last_runs(t)).select(*sweep.KEY, "page_number", "total_seen", "sweeps_completed", "last_status")


@query("ST03_fail_runs", f"""with {_LOG}, f as (select distinct source_name, stream_name, stream_name like 'error%' as adv from sweep_log where stream_name like '%-1') select source_name, stream_name, page_number + case when adv then 4 else 0 end as page_number, total_failed + case when adv is not null then 1 else 0 end as total_failed,
   case when adv is not null then 'failed' else last_status end as last_status, case when adv is not null then 'boom' else last_error end as last_error from state left join f using (source_name, stream_name)""")
def st03(t):
    f = t.sweep_log.where("stream_name like '%-1'").select(*sweep.KEY, F.lit("boom").alias("error"), F.startswith("stream_name", F.lit("error")).alias("advance")).distinct()
    return sweep.fail(sweep.replay(t.sweep_log), f, 4).select(*sweep.KEY, "page_number", "total_failed", "last_status", "last_error")


@query("ST04_reset_and_create", f"""with {_LOG} select source_name, stream_name, case when stream_name like '%-0' then 0 else page_number end as page_number, case when stream_name like '%-0' then 0 else total_seen end as total_seen, case when stream_name like '%-0' then 'reset' else last_status end as last_status from state
   union all select distinct 'listing', concat('new-', stream_name), 0, 0, null from sweep_log""")
def st04(t):
    states = sweep.replay(t.sweep_log)
    fresh = t.sweep_log.select("source_name", F.concat(F.lit("new-"), "stream_name").alias("stream_name"))
    out = sweep.reset(sweep.new_states(fresh, states), t.sweep_log.where("stream_name like '%-0'"))
    return out.select(*sweep.KEY, "page_number", "total_seen", "last_status")


_RULES = {"title": "overwrite", "summary": "keep_if_null_new", "committee_id": "fill_if_null_old"}


@query("ST06_stream_ingest", """select o_orderkey as id, concat('Title ', o_orderkey) as title, case when o_orderkey % 3 <> 0 then concat('B', o_orderkey % 50, '-2020') end as bill_number,
   case o_orderkey % 3 when 0 then 'assented' when 1 then 'passed' else 'unknown' end as status from orders where o_orderkey % 3 <> 2""")
def st06(t):
    from polislake.sources import readers

    folder = _folder(t)
    payloads = t.spark.sql(VIEWS["listing_json"], orders=_stream(t, "orders"))
    q = ingest.write_changes(
        payloads, lambda df: readers.bills_of(readers.parse_listing(df, "payload"), "https://records.example.org"), ["id"], [F.col("title")], folder, f"{folder}/checkpoint",
        valid=F.col("status") != "unknown",
    )
    q.awaitTermination()
    return ingest.current_rows(t.spark.read.parquet(f"{folder}/records"), ["id"], {}).select("id", "title", "bill_number", "status")


@query("ST07_idempotent_reingest", """with m as (select id, title, case when id % 2 = 0 then null else concat('Minutes ', id) end as summary, committee_id from meetings)
   select id, title, summary, committee_id from m""")
def st07(t):
    """The same backlog stored twice, by two runs of the stream, is the same table."""
    folder = _folder(t)
    parse = lambda df: df.select("id", "title", F.when(F.col("id") % 2 != 0, F.concat(F.lit("Minutes "), F.col("id").cast("string"))).alias("summary"), "committee_id")
    for run in (1, 2):
        meetings = t.spark.sql(VIEWS["meetings"], orders=_stream(t, "orders"))
        ingest.write_changes(meetings, parse, ["id"], [F.col("title")], folder, f"{folder}/checkpoint-{run}").awaitTermination()
    return ingest.current_rows(t.spark.read.parquet(f"{folder}/records"), ["id"], _RULES)


@query("ST08_stream_dedup", "select count(*) as n from (select distinct user_id, event_type from events)")
def st08(t):
    folder = _folder(t)
    keys = ["user_id", "event_type"]
    ingest.write_changes(_stream(t, "events"), lambda df: df.select(*keys, "ts"), keys, [F.col("ts")], folder, f"{folder}/checkpoint").awaitTermination()
    return ingest.deduplicated(t.spark.read.parquet(f"{folder}/records"), keys).agg(F.count("*").alias("n"))


_EV = "select cast(floor(event_id / 2) as bigint) as run_id, case when event_id % 9 = 5 then 'progress' when event_id % 2 = 0 then 'start' else 'finish' end as kind, ts, case when event_type = 'error' then 0 else user_id end as processed, case when event_type in ('error', 'view') then user_id % 4 else 0 end as failed from {events}"


@query("ST09_run_life_cycle", f"""select run_id, min(ts) filter (where kind = 'start') as started_at, max(ts) filter (where kind = 'finish') as finished_at, coalesce(sum(processed) filter (where kind = 'finish'), 0)::bigint as processed, coalesce(sum(failed) filter (where kind = 'finish'), 0)::bigint as failed,
   case when max(ts) filter (where kind = 'finish') is null then 'running' when coalesce(sum(failed) filter (where kind = 'finish'), 0) > 0 and coalesce(sum(processed) filter (where kind = 'finish'), 0) = 0 then 'failed' else 'completed' end as status from ({_EV.format(events='events')}) group by 1""")
def st09(t):
    return runs.life_cycle(t.spark.sql(_EV, events=t.events))


@query("ST09_run_life_cycle_stream", f"""select status, count(*) as n from (select run_id, case when max(ts) filter (where kind = 'finish') is null then 'running' when coalesce(sum(failed) filter (where kind = 'finish'), 0) > 0 and coalesce(sum(processed) filter (where kind = 'finish'), 0) = 0 then 'failed' else 'completed' end as status from ({_EV.format(events='events')}) group by 1) group by 1""")
def st09b(t):
    folder = _folder(t)
    live = runs.life_cycle(t.spark.sql(_EV, events=_stream(t, "events")))
    ingest.write_batches(live, f"{folder}/out", f"{folder}/checkpoint", "update").awaitTermination()
    latest = ingest.current_rows(t.spark.read.parquet(f"{folder}/out"), ["run_id"], {})
    return latest.groupBy("status").agg(F.count("*").alias("n"))


_STUCK = f"""select run_id, ts as started_at from ({_EV.format(events='events')}) s where kind = 'start' and not exists (select 1 from ({_EV.format(events='events')}) f where f.kind = 'finish' and f.run_id = s.run_id and f.ts >= s.ts and f.ts <= s.ts + interval 24 hour)"""


@query("ST09_stuck_runs", _STUCK)
def st09c(t):
    return runs.stuck(t.spark.sql(_EV, events=t.events), 24).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("ST09_stuck_runs_stream", f"select * from ({_STUCK}) where started_at < timestamp '2024-01-20'")
def st09d(t):
    """Starts whose time was up well before the watermark."""
    folder = _folder(t)
    live = runs.stuck(t.spark.sql(_EV, events=_stream(t, "events")), 24, "1 day")
    ingest.write_batches(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = t.spark.read.parquet(f"{folder}/out").select("run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))
    return done.where("started_at < timestamp_ntz '2024-01-20 00:00:00'")


_RATE = "select time_bucket(interval 7 day, started_at, timestamp '1970-01-01') as window_start, source_name, count(*) as runs, count(*) filter (where status = 'failed') as failed, max(started_at) filter (where status = 'completed') as last_completed from runs group by 1, 2"


@query("ST10_failure_rates", f"select * from ({_RATE})")
def st10(t):
    w = ingest.failure_rates(t.runs)
    return w.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "last_completed": F.col("last_completed").cast("timestamp_ntz")})


@query("ST10_failure_rates_stream", f"select source_name, sum(runs)::bigint as runs, sum(failed)::bigint as failed from ({_RATE}) where window_start + interval 7 day <= (select max(started_at) from runs) - interval 1 day group by 1")
def st10b(t):
    """Windows the watermark has closed."""
    folder = _folder(t)
    live = ingest.failure_rates(t.spark.sql(VIEWS["runs"], events=_stream(t, "events")), delay="1 day")
    ingest.write_batches(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    done = t.spark.read.parquet(f"{folder}/out")
    return done.groupBy("source_name").agg(F.sum("runs").alias("runs"), F.sum("failed").alias("failed"))


@query("ST12_sweep_report", """with b as (select run_type as name, count(*) as n from runs where started_at < timestamp '2024-01-10' group by 1), a as (select run_type as name, count(*) as n from runs group by 1)
   select name, b.n as before, a.n as after, coalesce(a.n, 0) - coalesce(b.n, 0) as delta, case when name = 'bills' then 5000 end as source_total, case when name = 'bills' then round(cast(100 * coalesce(a.n, 0) as decimal(38,6)) / 5000, 1)::double end as coverage_pct from b full join a using (name)""")
def st12(t):
    count = lambda df: df.groupBy(F.col("run_type").alias("name")).agg(F.count("*").alias("n"))
    before = count(t.runs.where("started_at < timestamp_ntz '2024-01-10 00:00:00'"))
    totals = t.runs.where("run_type = 'bills'").select(F.col("run_type").alias("name"), F.lit(5000).alias("source_total")).distinct()
    return sweep.sweep_report(before, count(t.runs), totals)


_BATCH = "select event_type as doc_type, cast(floor(event_id / 50) as bigint) as batch_no, concat('https://docs.example.org/', event_type, '/', cast(case when event_id % 1000 >= 400 then event_id % 40 else event_id % 700 end as string)) as url, case when event_id % 4 = 0 then '2023' else '2024' end as label from {events}"


@query("ST13_paged_discovery", f"""with b as ({_BATCH.format(events='events')}), r as (select * from b where contains(label || ' ' || url, '2024')), f as (select doc_type, url, min(batch_no) as first_no from r group by 1, 2),
   s as (select b.doc_type, b.batch_no, count(f.url) = 0 as stale from (select distinct doc_type, batch_no from b) b left join f on f.doc_type = b.doc_type and f.first_no = b.batch_no group by 1, 2),
   st as (select doc_type, min(batch_no) as stop_no from (select *, lag(stale) over (partition by doc_type order by batch_no) as prev, lag(batch_no) over (partition by doc_type order by batch_no) as pb from s) where stale and prev and pb = batch_no - 1 group by 1)
   select doc_type, url, first_no from f left join st using (doc_type) where stop_no is null or first_no <= stop_no""")
def st13(t):
    return sweep.discover(t.spark.sql(_BATCH, events=t.events), 2024)


@query("ST14_transient_errors", """select source_url, count(*) as n, bool_and(error_type in ('ConnectionError', 'ConnectTimeout', 'HTTPError', 'ReadTimeout', 'RequestException', 'Timeout') or regexp_matches(lower(error), '429|500|502|503|504|connection|fetch failed|rate limit|temporarily unavailable|timeout|timed out')) as transient from run_errors group by 1""")
def st14(t):
    return runs.transient(t.run_errors, ["source_url"])
