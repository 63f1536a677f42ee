"""Browse, join, aggregate, duplicate and ranking queries (S, F, J, A, D, X, O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import names, text
from polislake.operators import attendance as att
from polislake.operators import tables as tb
from polislake.operators.resolve import alias_table
from polislake.plans.registry import query
from polislake.plans.scalars import ALIAS_SQL

# --------------------------------------------------------------------------- filters and pages


@query("F01_list_bills", "select id, title, year, status from bills where status = 'passed' order by year desc nulls last, title, id limit 50 offset 10")
def f01(t):
    return tb.browse(t.bills, {"status": "passed", "house": None}, [F.desc_nulls_last("year"), F.col("title"), F.col("id")], 50, 10).select("id", "title", "year", "status")


@query("F02_list_vote_events", "select id, title, date, chamber from vote_events where chamber = 'NCOP' order by date desc nulls last, id limit 50")
def f02(t):
    return tb.browse(t.vote_events, {"chamber": "NCOP"}, [F.desc_nulls_last("date"), F.col("id")]).select("id", "title", "date", "chamber")


@query("F03_list_meetings", "select id, title, date from meetings where committee_id = 3 order by date desc nulls last, id limit 50")
def f03(t):
    return tb.browse(t.meetings, {"committee_id": 3}, [F.desc_nulls_last("date"), F.col("id")]).select("id", "title", "date")


@query("F04_list_questions", "select id, title, department, status from questions where department = 'Water' and status = 'ANSWERED' order by asked_date desc nulls last, id limit 50")
def f04(t):
    return tb.browse(t.questions, {"department": "Water", "status": "ANSWERED"}, [F.desc_nulls_last("asked_date"), F.col("id")]).select("id", "title", "department", "status")


@query("F05_list_unresolved", "select id, raw_value from unresolved where status = 'OPEN' and entity_type = 'POLITICIAN' and contains(lower(raw_value), 'dlamini') order by created_at desc, id limit 100")
def f05(t):
    hits = t.unresolved.where(tb.ilike_any(["raw_value"], ["Dlamini"]))
    return tb.browse(hits, {"status": "open".upper(), "entity_type": "politician".upper()}, [F.desc("created_at"), F.col("id")], 100).select("id", "raw_value")


@query("F06_search_people", f"""with {ALIAS_SQL} select id, display_name from people p where contains(lower(full_name), 'hon c') or contains(lower(display_name), 'hon c')
   or contains(slug, 'hon c') or exists (select 1 from aliases a where a.person_id = p.id and contains(lower(alias), 'hon c'))""")
def f06(t):
    return tb.search_people(t.people, alias_table(t.people), "Hon C").select("id", "display_name")


@query("F07_ilike_any", "select id, title from meetings where contains(lower(title), 'energy') or contains(lower(title), 'budget') or contains(lower(coalesce(summary, '')), 'energy') or contains(lower(coalesce(summary, '')), 'budget')")
def f07(t):
    return t.meetings.where(tb.ilike_any(["title", "summary"], ["Energy", "budget"])).select("id", "title")


@query("F08_blank_values", "select id from docs where trim(coalesce(archive_path, '')) = '' or trim(coalesce(raw_text, '')) = ''")
def f08(t):
    return t.docs.where(text.is_blank(F.col("archive_path")) | text.is_blank(F.col("raw_text"))).select("id")


@query("F09_prefix", "select id, document_type from docs where document_type like 'PMG%'")
def f09(t):
    return t.docs.where(F.startswith("document_type", F.lit("PMG"))).select("id", "document_type")


@query("F10_date_range", "select id, date from meetings where date between date '1996-01-01' and date '1997-06-30'")
def f10(t):
    return t.meetings.where(F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-06-30").cast("date"))).select("id", "date")


@query("F11_document_with_children", """select d.id, d.title, s.name as source_name, m.politician_id, m.confidence_score from docs d
   left join (select distinct source as name from docs) s on s.name = d.source left join mentions m on m.document_id = d.id where d.id = 7""")
def f11(t):
    sources = t.docs.select(F.col("source").alias("source_name")).distinct()
    doc = t.docs.where("id = 7").select("id", "title", "source")
    kids = t.mentions.select(F.col("document_id").alias("id"), "politician_id", "confidence_score")
    return doc.join(sources, F.col("source") == F.col("source_name"), "left").join(kids, "id", "left").select("id", "title", "source_name", "politician_id", "confidence_score")


@query("F12_event_children", """select 'event' as kind, id, cast(event_date as varchar) as detail from bill_events where bill_id = 5
   union all select 'record', id, vote_value from vote_records where vote_event_id = 5 union all select 'attendance', id, name_raw from attendance where meeting_id = 5""")
def f12(t):
    return (
        t.bill_events.where("bill_id = 5").orderBy("event_date").select(F.lit("event").alias("kind"), "id", F.col("event_date").cast("string").alias("detail"))
        .unionByName(t.vote_records.where("vote_event_id = 5").select(F.lit("record").alias("kind"), "id", F.col("vote_value").alias("detail")))
        .unionByName(t.attendance.where("meeting_id = 5").select(F.lit("attendance").alias("kind"), "id", F.col("name_raw").alias("detail")))
    )


@query("F13_people_page", """select p.id, display_name, y.name as party_name from people p left join parties y on y.short_name = p.party order by display_name, p.id limit 40 offset 20""")
def f13(t):
    page = t.people.orderBy("display_name", "id").offset(20).limit(40)
    return page.join(t.parties.select(F.col("short_name").alias("party"), F.col("name").alias("party_name")), "party", "left").select("id", "display_name", "party_name")


@query("F14_children_of_person", """select 'membership' as kind, concat(role, ': ', c.name) as detail from memberships m join committees c on c.id = m.committee_id where m.politician_id = 7
   union all select 'mention', d.title from mentions n join docs d on d.id = n.document_id where n.politician_id = 7 union all select 'question', title from questions where politician_id = 7""")
def f14(t):
    m = t.memberships.where("politician_id = 7").join(t.committees.select(F.col("id").alias("committee_id"), "name"), "committee_id")
    n = t.mentions.where("politician_id = 7").join(t.docs.select(F.col("id").alias("document_id"), "title"), "document_id")
    q = t.questions.where("politician_id = 7")
    return (
        m.select(F.lit("membership").alias("kind"), F.concat("role", F.lit(": "), "name").alias("detail"))
        .unionByName(n.select(F.lit("mention").alias("kind"), F.col("title").alias("detail")))
        .unionByName(q.select(F.lit("question").alias("kind"), F.col("title").alias("detail")))
    )


@query("F15_runs_with_errors", """select r.id, r.status, e.error_type from (select * from runs order by started_at desc, id desc limit 20) r left join run_errors e on e.run_id = r.id""")
def f15(t):
    page = t.runs.orderBy(F.desc("started_at"), F.desc("id")).limit(20)
    return page.join(t.run_errors.select(F.col("run_id").alias("id"), "error_type"), "id", "left").select("id", "status", "error_type")


# --------------------------------------------------------------------------- joins


@query("J01_people_of_committee", """select distinct p.id, p.display_name, y.name as party_name from memberships m join people p on p.id = m.politician_id left join parties y on y.short_name = p.party where m.committee_id = 4""")
def j01(t):
    ids = t.memberships.where("committee_id = 4").select(F.col("politician_id").alias("id")).distinct()
    named = t.people.join(ids, "id").join(t.parties.select(F.col("short_name").alias("party"), F.col("name").alias("party_name")), "party", "left")
    return named.select("id", "display_name", "party_name")


@query("J02_display_dimension", "select p.id, p.full_name, y.short_name, y.name as party_name from people p left join parties y on y.short_name = p.party")
def j02(t):
    y = t.parties.select("short_name", F.col("name").alias("party_name"))
    return t.people.join(y, F.col("party") == F.col("short_name"), "left").select("id", "full_name", "short_name", "party_name")


@query("J03_committee_fallback", "select m.id, coalesce(c.name, m.committee_name) as committee_name from meetings m left join committees c on c.id = m.committee_id")
def j03(t):
    c = t.committees.select(F.col("id").alias("committee_id"), "name")
    return t.meetings.join(c, "committee_id", "left").select("id", F.coalesce("name", "committee_name").alias("committee_name"))


@query("J04_with_child", "select id from docs where id in (select document_id from mentions)")
def j04(t):
    return tb.with_child(t.docs.select("id"), t.mentions, "id", "document_id")


@query("J05_without_child", "select id from docs where id not in (select document_id from mentions)")
def j05(t):
    return tb.without_child(t.docs.select("id"), t.mentions, "id", "document_id")


@query("J06_reconcile", """with e as (select distinct lower(trim(full_name)) as key from people), p as (select distinct lower(trim(name_raw)) as key from attendance)
   select coalesce(e.key, p.key) as key, case when p.key is null then 'expected_only' else 'present_only' end as side from e full join p on e.key = p.key where e.key is null or p.key is null""")
def j06(t):
    return tb.reconcile_names(t.people.select("full_name"), t.attendance.select(F.col("name_raw").alias("full_name")), "full_name")


@query("J07_orphans_both_ways", """select 'total without manifest' as kind, manifest_key as key, count(*) as n from vote_totals where manifest_key not in (select manifest_key from manifests) group by 2
   union all select 'manifest without totals', manifest_key, 1 from manifests where manifest_key not in (select manifest_key from vote_totals)""")
def j07(t):
    a = t.vote_totals.join(t.manifests.select("manifest_key"), "manifest_key", "left_anti").groupBy("manifest_key").agg(F.count("*").alias("n"))
    b = t.manifests.join(t.vote_totals.select("manifest_key"), "manifest_key", "left_anti").select("manifest_key", F.lit(1).cast("long").alias("n"))
    return a.select(F.lit("total without manifest").alias("kind"), F.col("manifest_key").alias("key"), "n").unionByName(
        b.select(F.lit("manifest without totals").alias("kind"), F.col("manifest_key").alias("key"), "n")
    )


@query("J08_borrow_by_url", "select v.id, m.committee_id from vote_events v join meetings m on m.source_url = v.source_url where v.committee_id is null and m.committee_id is not null")
def j08(t):
    m = t.meetings.where("committee_id is not null").select("source_url", "committee_id")
    return t.vote_events.where("committee_id is null").drop("committee_id").join(m, "source_url").select("id", "committee_id")


_COMM = r"lower(regexp_replace(committee_name, '^Portfolio Committee on ', ''))"


@query("J09_name_alternatives", f"""with k as (select k, min(id) as cid from (select lower(name) as k, id from committees union all select slug, id from committees) group by k)
   select m.id, coalesce(a.cid, b.cid) as committee_ref from meetings m left join k a on a.k = lower(m.committee_name) left join k b on b.k = {_COMM}""")
def j09(t):
    return tb.first_by_alternatives(
        t.meetings.select("id", "committee_name"), [F.lower("committee_name"), F.lower(names.committee_name(F.col("committee_name")))],
        t.committees, [F.lower("name"), F.col("slug")], "id", "committee_ref",
    ).select("id", "committee_ref")


@query("J10_longest_name_in_title", """with n as (select lower(name) as nm, min(id) as committee from committees where length(name) >= 6 group by 1)
   select id, committee, nm as matched_name from (select m.id, n.committee, n.nm, row_number() over (partition by m.id order by length(nm) desc, nm) as rn from meetings m join n on contains(lower(m.title), n.nm)) where rn = 1""")
def j10(t):
    return tb.longest_contained(t.meetings.select("id", "title"), "id", "title", t.committees.select(F.col("id").alias("committee"), "name"), "committee", "name", 6)


@query("J11_new_first", "select url, known from (select distinct url, url in (select source_url from catalogue where id % 3 = 0) as known from links) order by known, url limit 60")
def j11(t):
    return tb.new_first(t.links, t.catalogue.where("id % 3 = 0").select(F.col("source_url").alias("url")), 60)


# --------------------------------------------------------------------------- aggregates


@query("A01_row_counts", " union all ".join(f"select '{v}' as table_name, count(*) as n from {v}" for v in ("people", "committees", "meetings", "attendance", "bills", "vote_events", "questions")))
def a01(t):
    parts = [getattr(t, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("table_name"), "n") for v in ("people", "committees", "meetings", "attendance", "bills", "vote_events", "questions")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A02_conditional_counts", """select count(*) filter (where politician_id is null) as unlinked, count(*) filter (where source_url is not null) as with_source,
   count(*) filter (where attendance_status = 'present') as present, count(*) filter (where confidence < 0.8) as weak, count(*) filter (where name_raw like 'Hon%') as titled from attendance""")
def a02(t):
    return tb.metrics(t.attendance, {
        "unlinked": F.col("politician_id").isNull(), "with_source": F.col("source_url").isNotNull(), "present": F.col("attendance_status") == "present",
        "weak": F.col("confidence") < 0.8, "titled": F.startswith("name_raw", F.lit("Hon")),
    })


_FOLD = "count(*) filter (where attendance_status = 'present') as present, count(*) filter (where attendance_status = 'absent') as absent, count(*) filter (where attendance_status = 'apology') as apology, count(*) filter (where attendance_status not in ('present', 'absent', 'apology')) as unknown"


@query("A03_attendance_totals", f"select politician_id, {_FOLD}, count(*) as recorded_meetings from attendance where politician_id is not null group by 1")
def a03(t):
    return att.totals(t.attendance)


_AT = "attendance a join meetings m on m.id = a.meeting_id left join committees c on c.id = m.committee_id where a.politician_id is not null"


@query("A04_attendance_by_committee", f"select politician_id, committee_id, coalesce(c.name, m.committee_name) as committee_name, {_FOLD}, count(*) as total from {_AT} group by 1, 2, 3")
def a04(t):
    return att.by_committee(t.attendance, t.meetings, t.committees)


@query("A05_attendance_summary", f"""with tot as (select politician_id, {_FOLD}, count(*) as recorded_meetings from attendance where politician_id is not null group by 1),
   per as (select politician_id, committee_id, coalesce(c.name, m.committee_name) as n, count(*) as total from {_AT} group by 1, 2, 3),
   best as (select politician_id, count(*) as committees, arg_min(coalesce(n, ''), (-total, coalesce(n, ''))) as busiest_committee, max(total) as busiest_total from per group by 1),
   last as (select politician_id, title as latest_meeting, date as latest_date from (select a.politician_id, m.title, m.date, row_number() over (partition by politician_id order by date desc nulls last, m.id desc, a.id desc) as rn
      from attendance a join meetings m on m.id = a.meeting_id where politician_id is not null) where rn = 1)
   select * from tot left join best using (politician_id) left join last using (politician_id)""")
def a05(t):
    return att.summary(t.attendance, t.meetings, t.committees)


@query("A06_group_counts", "select concat(coalesce(source_status, 'unknown'), '/', coalesce(party, 'unknown')) as key, count(*) as n from people group by 1")
def a06(t):
    return tb.counts_by(t.people, "source_status", "party")


@query("A07_top_groups", "select source_name, count(*) as n from unresolved group by 1 order by n desc, source_name limit 20")
def a07(t):
    return t.unresolved.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(20)


@query("A08_distinct_counts", "select count(distinct name_raw) as names, count(distinct source_url) filter (where attendance_status = 'present') as present_sources, count(distinct nullif(trim(name_raw), '')) as non_blank from attendance")
def a08(t):
    return t.attendance.agg(
        F.count_distinct("name_raw").alias("names"), F.count_distinct(F.when(F.col("attendance_status") == "present", F.col("source_url"))).alias("present_sources"),
        F.count_distinct(text.blank_to_null(F.col("name_raw"))).alias("non_blank"),
    )


@query("A09_distinct_pairs", "select count(*) as parties from (select distinct party_id, party_name from vote_csv where party_id is not null or party_name is not null)")
def a09(t):
    return t.vote_csv.where("party_id is not null or party_name is not null").select("party_id", "party_name").distinct().agg(F.count("*").alias("parties"))


@query("A10_sums_and_ranges", "select contest_id, coalesce(sum(vote_total), 0)::bigint as votes, min(vote_total) as lowest, max(vote_total) as highest from vote_totals group by 1")
def a10(t):
    return t.vote_totals.groupBy("contest_id").agg(F.coalesce(F.sum("vote_total"), F.lit(0)).alias("votes"), F.min("vote_total").alias("lowest"), F.max("vote_total").alias("highest"))


@query("A11_identifier_rollup", "select contest_id, party_id, party_name, count(*) as n, sum(vote_total)::bigint as votes, min(manifest_key) as manifest, min(source_url) as url from vote_totals where trim(coalesce(party_id, '')) <> '' group by 1, 2, 3")
def a11(t):
    from polislake.operators.votes import identifier_rollup

    return identifier_rollup(t.vote_totals, "party_id", "party_name", ["contest_id"])


@query("A12_latest_completed", "select source_name, max(started_at) filter (where status = 'completed') as last_completed, max(started_at) as last_any from runs group by 1")
def a12(t):
    return t.runs.groupBy("source_name").agg(F.max(F.when(F.col("status") == "completed", F.col("started_at"))).alias("last_completed"), F.max("started_at").alias("last_any"))


_SUMS = ("processed_count", "created_count", "updated_count", "skipped_count", "failed_count")


@query("A13_run_rollup", "select source_name, run_type, status, count(*) as runs, " + ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in _SUMS) + " from runs group by 1, 2, 3")
def a13(t):
    return t.runs.groupBy("source_name", "run_type", "status").agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])


@query("A14_guarded_ratio", """select politician_id, case when count(*) > 0 then round(cast(100 * count(*) filter (where attendance_status = 'present') as decimal(38,6)) / count(*), 1)::double end as present_pct,
   case when count(*) filter (where attendance_status = 'absent') > 0 then round(cast(100 * count(*) filter (where attendance_status = 'apology') as decimal(38,6)) / count(*) filter (where attendance_status = 'absent'), 2)::double else 0.0 end as apology_ratio
   from attendance group by 1""")
def a14(t):
    n = lambda s: F.count_if(F.col("attendance_status") == s)
    g = t.attendance.groupBy("politician_id").agg(n("present").alias("p"), n("absent").alias("a"), n("apology").alias("y"), F.count("*").alias("n"))
    return g.select("politician_id", tb.pct(F.col("p"), F.col("n")).alias("present_pct"), tb.pct(F.col("y"), F.col("a"), 2, 0.0).alias("apology_ratio"))


@query("A15_error_histogram", """select error_type, count(*) as n, count(*) filter (where error_type in ('HTTPError', 'Timeout', 'ConnectionError', 'RequestException', 'EmptyResponse')) as failed_fetches,
   string_agg(cast(id as varchar), ',' order by id) filter (where rn <= 3) as first_ids from (select *, row_number() over (partition by error_type order by id) as rn from run_errors) group by 1""")
def a15(t):
    from polislake.operators.runs import error_histogram

    return error_histogram(t.run_errors)


@query("A16_batch_sums", "select run_type, " + ", ".join(f"sum({c})::bigint as {c}" for c in _SUMS) + ", count(*) filter (where failed_count > 0) as with_errors from runs group by 1")
def a16(t):
    return t.runs.groupBy("run_type").agg(*[F.sum(c).alias(c) for c in _SUMS], F.count_if(F.col("failed_count") > 0).alias("with_errors"))


@query("A17_activity_counts", """select p.id, (select count(*) from questions q where q.politician_id = p.id) as questions, (select count(*) from attendance a where a.politician_id = p.id) as attendance,
   (select count(*) from memberships m where m.politician_id = p.id) as memberships from people p""")
def a17(t):
    from polislake.operators.evidence import activity_counts

    return activity_counts(t.people, t.questions, t.attendance, t.memberships)


@query("A18_data_snapshot", "select (select count(*) from people) as politicians, (select count(*) from committees) as committees, (select count(*) from meetings) as committee_meetings, (select count(*) from bills) as bills, (select count(*) from vote_events) as vote_events")
def a18(t):
    from polislake.operators.evidence import data_snapshot

    return data_snapshot({"politicians": t.people, "committees": t.committees, "committee_meetings": t.meetings, "bills": t.bills, "vote_events": t.vote_events})


@query("A19_batch_outcome", """with b as (select source_name, run_type, cast(floor(id / 7) as bigint) as batch, count(*) as attempted, count(*) filter (where status = 'failed') as failed, bool_or(failed_count >= 5) as systemic from runs group by 1, 2, 3)
   select *, case when systemic or failed = attempted or (attempted >= 5 and failed * 100 >= 80 * attempted) then 'failed' when failed > 0 then 'partial' else 'ok' end as outcome from b""")
def a19(t):
    from polislake.operators.runs import batch_outcome

    g = t.runs.groupBy("source_name", "run_type", F.floor(F.col("id") / 7).alias("batch")).agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("failed_count") >= 5).alias("systemic")
    )
    return batch_outcome(g)


# --------------------------------------------------------------------------- duplicates and sets


@query("D01_duplicate_groups_with_null", "select count(*) as groups from (select source_url from unresolved group by 1 having count(*) > 1)")
def d01(t):
    return tb.duplicate_groups(t.unresolved, "source_url").agg(F.count("*").alias("groups"))


@query("D02_duplicate_groups_without_null", "select count(*) as groups from (select bill_number, year from bills where year is not null group by 1, 2 having count(*) > 1)")
def d02(t):
    return tb.duplicate_groups(t.bills, "bill_number", "year", count_null=False).agg(F.count("*").alias("groups"))


@query("D03_duplicate_values", "select text as value, count(*) as n from documents group by 1 having count(*) > 1 order by n desc, value limit 100")
def d03(t):
    return tb.duplicate_texts(t.documents, "doc_id", "text").orderBy(F.desc("n"), "text").limit(100).select(F.col("text").alias("value"), "n")


@query("D04_duplicate_tuples", "select meeting_id, politician_id, attendance_status, count(*) as n from attendance group by 1, 2, 3 having count(*) > 1")
def d04(t):
    return tb.duplicate_groups(t.attendance, "meeting_id", "politician_id", "attendance_status")


@query("D05_duplicate_names", "select lower(trim(raw_value)) as name, count(*) as n from unresolved group by 1 having count(*) > 1")
def d05(t):
    return tb.duplicate_groups(t.unresolved.select(F.lower(F.trim("raw_value")).alias("name")), "name")


@query("D06_unique_values", r"""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as v, unnest(range(len(string_split(text, ' ')))) as pos from conversations),
   c as (select conv_id, turn, trim(regexp_replace(v, '\s+', ' ', 'g')) as v, pos from w), f as (select conv_id, turn, arg_min(v, pos) as v, min(pos) as pos from c where v <> '' group by conv_id, turn, lower(v))
   select conv_id, turn, count(*) as n, string_agg(v, '|' order by pos) as vals from f group by 1, 2""")
def d06(t):
    v = t.conversations.select("conv_id", "turn", text.unique_values(F.split("text", " ")).alias("v"))
    return v.where(F.size("v") > 0).select("conv_id", "turn", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("vals"))


@query("D07_first_wins", "select name_raw, id, source_url from (select *, row_number() over (partition by name_raw order by source_url nulls first, id) as rn from attendance) where rn = 1")
def d07(t):
    return tb.first_per_key(t.attendance, ["name_raw"], [F.asc_nulls_first("source_url"), F.col("id")]).select("name_raw", "id", "source_url")


@query("D08_best_evidence", """with r as (select display_name as name, 'politician_party_link' as evidence, 0 as rank, id from people union all select name_raw, 'committee_attendance_party_link', 1, id from attendance
      union all select asked_by_name, 'parliamentary_question_party_label', 2, id from questions),
   k as (select *, array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(name, '\\([^)]+\\)', ' ', 'g'), '\\b(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\\b', ' ', 'gi'), '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 1), lambda w: lower(w)), ' ') as key from r)
   select key, evidence, trim(regexp_replace(name, '\\s+', ' ', 'g')) as name from (select *, row_number() over (partition by key order by rank, id) as rn from k where key <> '') where rn = 1""".replace("\\\\", "\\"))
def d08(t):
    from polislake.operators.evidence import merge_party_members

    rows = (
        t.people.select(F.col("display_name").alias("name"), F.lit("politician_party_link").alias("evidence"), "id")
        .unionByName(t.attendance.select(F.col("name_raw").alias("name"), F.lit("committee_attendance_party_link").alias("evidence"), "id"))
        .unionByName(t.questions.select(F.col("asked_by_name").alias("name"), F.lit("parliamentary_question_party_label").alias("evidence"), "id"))
    )
    # A spelling is made readable once, not for each row that has it.
    spelled = rows.groupBy("name", "evidence").agg(F.min("id").alias("id"))
    return merge_party_members(spelled, []).select("key", "evidence", "name")


@query("X01_evidence_union", """select 'link' as evidence, display_name as name, profile_url as source_url, null as asked_date from people where party = 'BUILDING'
   union all select 'label', trim(regexp_replace(asked_by_name, '\\s*\\(DA\\)\\s*', ' ', 'g')), source_url, asked_date from questions where contains(asked_by_name, '(DA)')""".replace("\\\\", "\\"))
def x01(t):
    a = t.people.where("party = 'BUILDING'").select(F.lit("link").alias("evidence"), F.col("display_name").alias("name"), F.col("profile_url").alias("source_url"))
    b = t.questions.where(F.contains("asked_by_name", F.lit("(DA)"))).select(
        F.lit("label").alias("evidence"), names.without_party_label(F.col("asked_by_name"), F.lit("DA")).alias("name"), "source_url", "asked_date"
    )
    return a.unionByName(b, allowMissingColumns=True)


@query("X02_url_sets", """with a as (select distinct source_url as url from docs), b as (select distinct concat('https://records.example.org/document/', cast(document_id as varchar), '/') as url from mentions)
   select 'union' as op, count(*) as n from (select url from a union select url from b) union all select 'new', count(*) from (select url from a except select url from b)""")
def x02(t):
    a = t.docs.select(F.col("source_url").alias("url"))
    b = t.mentions.select(F.concat(F.lit("https://records.example.org/document/"), F.col("document_id").cast("string"), F.lit("/")).alias("url"))
    merged = a.union(b).distinct().agg(F.count("*").alias("n")).select(F.lit("union").alias("op"), "n")
    new = a.distinct().join(b, "url", "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("op"), "n")
    return merged.unionByName(new)


@query("X03_token_overlap", "select id, array_to_string(list_sort(list_intersect(list_distinct(string_split(lower(title), ' ')), list_distinct(string_split(lower(coalesce(committee_name, '')), ' ')))), ' ') as shared from meetings")
def x03(t):
    words = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), " ")
    return t.meetings.select("id", F.array_join(F.array_sort(F.array_intersect(words(F.col("title")), words(F.col("committee_name")))), " ").alias("shared"))


@query("X04_snapshot_delta", """with b as (select source_name, count(*) as n from runs where started_at < timestamp '2024-01-15' group by 1), a as (select source_name, count(*) as n from runs group by 1)
   select coalesce(b.source_name, a.source_name) as source_name, b.n as before, a.n as after, coalesce(a.n, 0) - coalesce(b.n, 0) as delta from b full join a using (source_name)""")
def x04(t):
    count = lambda df: df.groupBy("source_name").agg(F.count("*").alias("n"))
    return tb.snapshot_delta(count(t.runs.where("started_at < timestamp_ntz '2024-01-15 00:00:00'")), count(t.runs), "source_name", "n")


# --------------------------------------------------------------------------- sorts and ranks


@query("O01_sorted_page", "select id, title, committee_name from docs order by committee_name desc nulls last, title, id limit 25 offset 25")
def o01(t):
    return t.docs.orderBy(F.desc_nulls_last("committee_name"), "title", "id").offset(25).limit(25).select("id", "title", "committee_name")


@query("O02_recent_attendance", f"""select politician_id, position, meeting_id, attendance_status, committee_name, source_url from (select a.politician_id, row_number() over (partition by politician_id order by date desc nulls last, m.id desc, a.id desc, a.attendance_status, a.name_raw) as position,
   m.id as meeting_id, a.attendance_status, coalesce(c.name, m.committee_name) as committee_name, coalesce(a.source_url, m.source_url) as source_url from {_AT}) where position <= 10""")
def o02(t):
    return att.recent(t.attendance, t.meetings, t.committees).select("politician_id", "position", "meeting_id", "attendance_status", "committee_name", "source_url")


@query("O03_latest_errors", "select id, error_type, error from run_errors order by created_at desc, id desc limit 20")
def o03(t):
    return t.run_errors.orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "error_type", "error")


@query("O04_best_score", "select document_id, arg_max(politician_id, (confidence_score, -politician_id)) as politician_id, max(confidence_score) as score from mentions where confidence_score >= 0.9 group by 1")
def o04(t):
    best = t.mentions.where("confidence_score >= 0.9").groupBy("document_id").agg(F.max(F.struct("confidence_score", (-F.col("politician_id")).alias("p"))).alias("b"))
    return best.select("document_id", (-F.col("b.p")).alias("politician_id"), F.col("b.confidence_score").alias("score"))


@query("O05_longest_first", f"with {ALIAS_SQL} select person_id, alias from (select *, row_number() over (partition by person_id order by length(alias) desc, alias) as rn from aliases) where rn = 1")
def o05(t):
    a = alias_table(t.people).groupBy("person_id").agg(F.min(F.struct((-F.length("alias")).alias("l"), "alias")).alias("b"))
    return a.select("person_id", F.col("b.alias").alias("alias"))


@query("O06_categorical_rank", """select politician_id, meeting_id, attendance_status, position from (select a.politician_id, a.meeting_id, a.attendance_status, row_number() over (partition by politician_id order by
   case attendance_status when 'present' then 1 when 'apology' then 3 when 'absent' then 4 else 6 end, coalesce(cast(m.date as varchar), ''), a.id) as position from attendance a join meetings m on m.id = a.meeting_id where politician_id is not null) where position <= 8""")
def o06(t):
    rank = F.create_map(*[F.lit(x) for kv in {"present": 1, "apology": 3, "absent": 4}.items() for x in kv])
    j = att.at_meetings(t.attendance, t.meetings, t.committees)
    order = [F.coalesce(F.try_element_at(rank, F.col("attendance_status")), F.lit(6)), F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("id")]
    return tb.top_k(j, ["politician_id"], order, vocab.MAX_SOURCES, rank="position").select("politician_id", "meeting_id", "attendance_status", "position")


@query("O07_near_top", "select document_id, count(distinct politician_id) as near_top from (select m.*, max(confidence_score) over (partition by document_id) as top from mentions m) where top - confidence_score <= 0.1 group by 1")
def o07(t):
    top = t.mentions.groupBy("document_id").agg(F.max("confidence_score").alias("top"))
    near = t.mentions.join(top, "document_id").where("top - confidence_score <= 0.1")
    return near.groupBy("document_id").agg(F.count_distinct("politician_id").alias("near_top"))


@query("O08_neighbour_turns", "select c.conv_id, c.turn, p.role as previous_role, n.role as next_role from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 left join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1")
def o08(t):
    c = t.conversations
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous_role"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return c.select("conv_id", "turn").join(p, ["conv_id", "turn"], "left").join(n, ["conv_id", "turn"], "left")


@query("O09_first_and_last_seen", "select source_name, status, min(started_at) as first_seen, max(started_at) as last_seen from runs group by 1, 2")
def o09(t):
    return t.runs.groupBy("source_name", "status").agg(F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))


@query("O10_first_safe_candidate", "select id, source_url from catalogue where ok and content_type in ('text/csv', 'application/json') order by case content_type when 'text/csv' then 1 else 2 end nulls last, source_url, id limit 1")
def o10(t):
    rank = F.when(F.col("content_type") == "text/csv", 1).when(F.col("content_type") == "application/json", 2)
    return t.catalogue.where(F.col("ok") & rank.isNotNull()).orderBy(F.asc_nulls_last(rank), "source_url", "id").limit(1).select("id", "source_url")
