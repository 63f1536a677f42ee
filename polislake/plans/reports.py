"""Quality, coverage and readiness reports (Q, R)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from polislake import vocab
from polislake.operators import quality as ql
from polislake.operators import tables as tb
from polislake.operators.resolve import alias_table
from polislake.plans.registry import query
from polislake.plans.scalars import ALIAS_SQL
from polislake.session import cut_lineage

NOW = "2024-01-31 00:00:00"


def _all(t):
    return {n: getattr(t, n) for n in ("people", "parties", "committees", "memberships", "docs", "mentions", "questions", "unresolved", "runs", "run_errors")} | {"aliases": alias_table(t.people), "question_mentions": t.questions.where("politician_id is not null").select("id", "politician_id")}


_SUMMARY_SPECS = {
    "total_politicians": "from people", "active_politicians": "from people where is_active", "inactive_politicians": "from people where not is_active",
    "unknown_status_politicians": "from people where source_status is null or source_status = 'UNKNOWN'", "politicians_without_party": "from people where party is null",
    "total_documents": "from docs", "total_pmg_documents": "from docs where document_type like 'PMG%'", "pmg_documents_without_archive_path": "from docs where document_type like 'PMG%' and archive_path is null",
    "documents_without_archive_path": "from docs where archive_path is null", "total_parliamentary_questions": "from questions", "parliamentary_questions_without_politician": "from questions where politician_id is null",
    "parliamentary_questions_without_answer": "from questions where answer_text is null", "parliamentary_questions_without_archive_path": "from questions where archive_path is null",
    "parliamentary_question_pdf_sources": "from questions where source_file_type = 'PDF'", "parliamentary_question_parse_failed": "from questions where parse_status = 'FAILED'",
    "parliamentary_question_parse_partial": "from questions where parse_status = 'PARTIAL'", "total_unresolved_entities": "from unresolved", "unresolved_entities_count": "from unresolved", "unresolved_entities_open": "from unresolved where status = 'OPEN'",
    "unresolved_entities_resolved": "from unresolved where status = 'RESOLVED'", "unresolved_entities_ignored": "from unresolved where status = 'IGNORED'", "total_parties": "from parties", "total_committees": "from committees",
    "total_committee_memberships": "from memberships", "total_document_mentions": "from mentions", "total_ingestion_runs": "from runs", "total_ingestion_errors": "from run_errors",
    "politicians_without_committees": "from people where id not in (select politician_id from memberships)", "active_politicians_without_committees": "from people where is_active and id not in (select politician_id from memberships)",
    "committees_without_memberships": "from committees where id not in (select committee_id from memberships)", "documents_without_mentions": "from docs where id not in (select document_id from mentions)",
    "pmg_documents_without_mentions": "from docs where document_type like 'PMG%' and id not in (select document_id from mentions)", "duplicate_slug_count": "from (select slug from people group by 1 having count(*) > 1)", "total_question_mentions": "from questions where politician_id is not null", "duplicate_politician_slug_count": "from (select slug from people group by 1 having count(*) > 1)",
    "duplicate_committee_slug_count": "from (select slug from committees group by 1 having count(*) > 1)", "duplicate_party_short_name_count": "from (select short_name from parties group by 1 having count(*) > 1)",
    "duplicate_source_url_count": "from (select source_url from docs group by 1 having count(*) > 1)", "duplicate_membership_candidates": "from (select politician_id, committee_id, role from memberships group by 1, 2, 3 having count(*) > 1)",
}
_Q01 = " union all ".join(f"select '{m}' as metric, count(*)::double as value {src}" for m, src in _SUMMARY_SPECS.items()) + f" union all select 'total_aliases', n from (with {ALIAS_SQL} select count(*)::double as n from aliases)"


@query("Q01_quality_summary", _Q01)
def q01(t):
    return ql.quality_summary(_all(t))


def _issue(name, body, label, order):
    facts = {"docs": "source_url, null, null", "unresolved": "source_url, entity_type, source_name"}.get(body.split()[0], "null, null, null")
    u, k, n = facts.split(", ")
    return f"(select '{name}' as issue, cast(id as varchar) as item, {label} as label, {u} as source_url, {k} as entity_type, {n} as source_name from {body})"


_Q02 = " union all ".join([
    _issue("politicians_without_party", "people where party is null", "display_name", "display_name"),
    _issue("active_politicians_without_committees", "people where is_active and id not in (select politician_id from memberships)", "display_name", "display_name"),
    _issue("committees_without_memberships", "committees where id not in (select committee_id from memberships)", "name", "name"),
    _issue("documents_without_mentions", "docs where id not in (select document_id from mentions)", "title", "title"),
    _issue("unresolved_entities_open", "unresolved where status = 'OPEN'", "raw_value", "created_at desc"),
    *[f"(select '{n}' as issue, {c} as item, cast(count(*) as varchar) as label, null, null, null from {tab} group by {c} having count(*) > 1)" for n, tab, c in (("duplicate_politician_slugs", "people", "slug"), ("duplicate_committee_slugs", "committees", "slug"), ("duplicate_party_short_names", "parties", "short_name"))],
])


@query("Q02_quality_issues", _Q02)
def q02(t):
    return ql.quality_issues(_all(t))


_LISTS = {"politician_slugs": ("people", "slug"), "committee_slugs": ("committees", "slug"), "party_short_names": ("parties", "short_name"), "document_source_urls": ("docs", "source_url"), "bill_numbers": ("bills", "bill_number")}


@query("Q03_duplicate_lists", " union all ".join(f"select '{n}' as list, {c} as value, count(*) as n from {tab} group by {c} having count(*) > 1" for n, (tab, c) in _LISTS.items()))
def q03(t):
    """Every list whole; a page of one is a sort and a limit away."""
    return ql.union_all([tb.duplicate_groups(getattr(t, tab), c).select(F.lit(name).alias("list"), F.col(c).alias("value"), "n") for name, (tab, c) in _LISTS.items()])


@query("Q04_archive_gaps", """(select 'document' as kind, id, source_url from docs where archive_path is null) union all (select 'question', id, source_url from questions where archive_path is null)""")
def q04(t):
    d = t.docs.where("archive_path is null")
    q = t.questions.where("archive_path is null")
    return d.select(F.lit("document").alias("kind"), "id", "source_url").unionByName(q.select(F.lit("question").alias("kind"), "id", "source_url"))


def _chk(cat, name, value, warn=None, fail=None):
    st = "case " + (f"when {fail} then 'fail' " if fail else "") + (f"when {warn} then 'warn' " if warn else "") + "else 'pass' end"
    return f"select '{cat}' as category, '{name}' as name, v::double as value, {st} as status from (select {value} as v)"


_TS = f"timestamp '{NOW}'"
_Q10 = _chk("unresolved_entities", "open unresolved entities", "(select count(*) from unresolved where status = 'OPEN')", "v > 0", "v > 50")
_Q07 = " union all ".join([
    _chk("ingestion_runs", "failed ingestion runs", f"(select count(*) from runs where status = 'failed' and started_at >= {_TS} - interval 7 day)", "v > 0"),
    _chk("ingestion_runs", "stuck ingestion runs", f"(select count(*) from runs where status = 'running' and started_at < {_TS} - interval 24 hour)", None, "v > 0"),
    _chk("stale_data", "stale ingestion sources", f"(select count(*) from (select source_name, max(started_at) filter (where status = 'completed') as l from runs group by 1) where l is null or l < {_TS} - interval 7 day)", "v > 0"),
])
_FKS = {"committee meetings without a committee link": ("meetings", "committee_id"), "attendance rows without a politician link": ("attendance", "politician_id"),
        "vote records without a politician link": ("vote_records", "politician_id"), "questions without a politician link": ("questions", "politician_id")}
_Q06 = " union all ".join(_chk("orphans", n, f"(select round(cast(100 * count(*) filter (where {fk} is null) as decimal(38,6)) / count(*), 2) from {tab})", "v > 10", "v > 50") for n, (tab, fk) in _FKS.items())
_BLANKS = {"politicians with a blank full name": ("people", "full_name"), "politicians with a blank display name": ("people", "display_name"), "parties with a blank name": ("parties", "name"),
           "committee meetings missing a source URL": ("meetings", "source_url"), "questions missing a source URL": ("questions", "source_url"), "vote events missing a source URL": ("vote_events", "source_url"), "committees with a blank name": ("committees", "name"), "politicians without a party": ("people", "party"),
           "documents missing a source URL": ("docs", "source_url"), "attendance missing a source URL": ("attendance", "source_url"), "committees without a description": ("committees", "description")}
_SOFT = ("politicians without a party", "committees without a description")
_Q08 = " union all ".join(_chk("mandatory_fields", n, f"(select count(*) from {tab} where trim(coalesce(cast({c} as varchar), '')) = '')", "v > 0" if n in _SOFT else None, None if n in _SOFT else "v > 0") for n, (tab, c) in _BLANKS.items())
_DOMS = {"attendance status": ("attendance", "attendance_status", vocab.ATTENDANCE_STATUSES), "bill status": ("bills", "status", vocab.BILL_STATUSES), "run status": ("runs", "status", ["running", "completed", "failed"])}
_Q08B = " union all ".join(_chk("domains", n, f"(select count(*) from {tab} where {c} not in ({', '.join(repr(x) for x in d)}))", "v > 0") for n, (tab, c, d) in _DOMS.items())
_DUPS = {"duplicate document source URLs": ("docs", ["source_url"]), "duplicate question source URLs": ("questions", ["source_url"]), "duplicate vote event source URLs": ("vote_events", ["source_url"]),
         "duplicate committee meeting source URLs": ("meetings", ["source_url"]), "duplicate politician slugs": ("people", ["slug"]), "duplicate committee slugs": ("committees", ["slug"]), "duplicate party short names": ("parties", ["short_name"]), "duplicate bill numbers": ("bills", ["bill_number", "year"]),
         "duplicate document titles": ("docs", ["title"]), "duplicate attendance": ("attendance", ["meeting_id", "name_raw"]), "duplicate memberships": ("memberships", ["politician_id", "committee_id", "role"])}
_Q09 = " union all ".join(_chk("duplicates", n, f"(select count(*) from (select {', '.join(cs)} from {tab} where {' and '.join(c + ' is not null' for c in cs)} group by all having count(*) > 1))".replace("group by all", "group by " + ", ".join(cs)), None, "v > 0") for n, (tab, cs) in _DUPS.items())


def _checks(t):
    held: dict = {}
    get = lambda tab: held.setdefault(tab, getattr(t, tab))  # noqa: E731  one frame a table, so that its checks share a scan
    return {
        "Q06": ql.orphan_checks({n: (get(tab), fk) for n, (tab, fk) in _FKS.items()}), "Q07": ql.run_checks(t.runs, NOW),
        "Q08": ql.blank_checks({n: (get(tab), c) for n, (tab, c) in _BLANKS.items()}, _SOFT), "Q08B": ql.domain_checks({n: (get(tab), c, d) for n, (tab, c, d) in _DOMS.items()}),
        "Q09": ql.duplicate_checks({n: (getattr(t, tab), cs) for n, (tab, cs) in _DUPS.items()}), "Q10": ql.unresolved_check(t.unresolved),
    }


@query("Q06_orphan_checks", _Q06)
def q06(t):
    return _checks(t)["Q06"]


@query("Q07_run_checks", _Q07)
def q07(t):
    return _checks(t)["Q07"]


@query("Q08_mandatory_fields", _Q08)
def q08(t):
    return _checks(t)["Q08"]


@query("Q08_closed_domains", _Q08B)
def q08b(t):
    return _checks(t)["Q08B"]


@query("Q09_duplicate_checks", _Q09)
def q09(t):
    return _checks(t)["Q09"]


@query("Q10_unresolved_check", _Q10)
def q10(t):
    return _checks(t)["Q10"]


@query("Q05_quality_gate", f"""with c as ({_Q06} union all {_Q07} union all {_Q08} union all {_Q08B} union all {_Q09} union all {_Q10} union all select 'availability', 'table archive_index', null, 'fail')
   select count(*) as checks, count(*) filter (where status = 'pass') as pass_count, count(*) filter (where status = 'warn') as warn_count, count(*) filter (where status = 'fail') as fail_count,
   case max(case status when 'fail' then 2 when 'warn' then 1 else 0 end) when 2 then 'fail' when 1 then 'warn' else 'pass' end as overall from c""")
def q05(t):
    return ql.gate(ql.union_all([*_checks(t).values(), ql.missing_table("table archive_index", t.unresolved)]))


# --------------------------------------------------------------------------- coverage

_PCT = "case when ({d}) > 0 then round(cast(100 * ({n}) as decimal(38,6)) / ({d}), 1)::double end"


def _c(m):
    return f"(select count(*) {_SUMMARY_SPECS[m]})"


_R01 = " union all ".join(f"select '{s}' as section, '{m}' as metric, {v} as value" for s, m, v in [
    ("politician_coverage", "with_party_pct", _PCT.format(n="(select count(*) from people where party is not null)", d=_c("total_politicians"))),
    ("politician_coverage", "with_committees_pct", _PCT.format(n="(select count(*) from people where id in (select politician_id from memberships))", d=_c("total_politicians"))),
    ("pmg_coverage", "with_archive_path_pct", _PCT.format(n="(select count(*) from docs where archive_path is not null)", d=_c("total_pmg_documents"))),
    ("pmg_coverage", "with_mentions_pct", _PCT.format(n="(select count(*) from docs where id in (select document_id from mentions))", d=_c("total_pmg_documents"))),
    ("pmg_coverage", "with_archive_path_pct_of_pmg", _PCT.format(n="(select count(*) from docs where document_type like 'PMG%' and archive_path is not null)", d=_c("total_pmg_documents"))),
    ("question_coverage", "with_archive_pct", _PCT.format(n="(select count(*) from questions where archive_path is not null)", d=_c("total_parliamentary_questions"))),
    ("question_coverage", "resolved_asker_pct", _PCT.format(n="(select count(*) from questions where politician_id is not null)", d=_c("total_parliamentary_questions"))),
    ("accountability_coverage", "bills_with_source_url_pct", _PCT.format(n="(select count(*) from bills where source_url is not null)", d="(select count(*) from bills)")),
    ("accountability_coverage", "attendance_resolved_pct", _PCT.format(n="(select count(*) from attendance where politician_id is not null)", d="(select count(*) from attendance)")),
]) + f" union all select 'database_counts', metric, value from ({_Q01})"


@query("R01_full_coverage", _R01)
def r01(t):
    def share(df, section, metric, part, whole=None):
        w = F.count("*") if whole is None else F.count_if(whole)
        return df.agg(F.count_if(part).alias("n"), w.alias("d")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), tb.pct(F.col("n"), F.col("d")).alias("value"))

    def flagged(parents, children, fk):
        return parents.join(children.select(F.col(fk).alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left").withColumn("has", F.coalesce("has", F.lit(False)))

    pmg = F.startswith("document_type", F.lit("PMG"))
    docs = flagged(t.docs.select("id", "document_type", "archive_path"), t.mentions, "document_id")
    people = flagged(t.people.select("id", "party"), t.memberships, "politician_id")
    some = lambda c: F.col(c).isNotNull()
    return ql.union_all([
        share(people, "politician_coverage", "with_party_pct", some("party")), share(people, "politician_coverage", "with_committees_pct", F.col("has")),
        share(docs, "pmg_coverage", "with_archive_path_pct", some("archive_path"), pmg), share(docs, "pmg_coverage", "with_mentions_pct", F.col("has"), pmg),
        share(docs, "pmg_coverage", "with_archive_path_pct_of_pmg", some("archive_path") & pmg, pmg),
        share(t.questions, "question_coverage", "with_archive_pct", some("archive_path")), share(t.questions, "question_coverage", "resolved_asker_pct", some("politician_id")),
        share(t.bills, "accountability_coverage", "bills_with_source_url_pct", some("source_url")), share(t.attendance, "accountability_coverage", "attendance_resolved_pct", some("politician_id")),
        ql.quality_summary(_all(t)).withColumn("section", F.lit("database_counts")),
    ])


_RECS = [("politicians_without_party", "{n} > 0", " politicians have no party"), ("parliamentary_questions_without_archive_path", "{n} > 0", " questions have no archive path"),
         ("politicians_without_aliases", "{n} > 0", " politicians have no aliases"), ("politicians_without_source_url", "{n} > 0", " politicians have no source URL"),
         ("unresolved_entities_open", "{n} > 50", " unresolved entities are OPEN"), ("parliamentary_question_parse_failed", "{n} > 0", " question files failed to parse"),
         ("duplicate_politician_slug_count", "{n} > 0", " duplicate politician slugs"), ("duplicate_source_url_count", "{n} > 0", " duplicate document source URLs")]


_LACKING = {"politicians_without_aliases": "from people where id not in (select person_id from aliases)", "politicians_without_source_url": "from people where profile_url is null"}


def _rc(m):
    return f"(select count(*) {_LACKING[m]})" if m in _LACKING else _c(m)


@query("R02_recommendations", f"with {ALIAS_SQL} " + " union all ".join(f"select concat({_rc(m)}, '{msg}') as recommendation where {cond.format(n=_rc(m))}" for m, cond, msg in _RECS)
       + f" union all select 'More than 50% of politicians have no committee' where {_c('politicians_without_committees')} * 2 > {_c('active_politicians')} union all select concat({_c('pmg_documents_without_mentions')}, ' documents have no mentions') where {_c('pmg_documents_without_mentions')} * 2 > {_c('total_pmg_documents')}")
def r02(t):
    need = [m for m, _, _ in _RECS] + ["politicians_without_committees", "active_politicians", "pmg_documents_without_mentions", "total_pmg_documents"]
    named = t.people.join(alias_table(t.people).select(F.col("person_id").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").cast("double").alias("value")).select(F.lit("politicians_without_aliases").alias("metric"), "value")
    sourced = t.people.agg(F.count_if(F.col("profile_url").isNull()).cast("double").alias("value")).select(F.lit("politicians_without_source_url").alias("metric"), "value")
    return ql.recommendations(ql.wide(ql.union_all([ql.quality_summary(_all(t)).select("metric", "value"), named, sourced]), need))


_DOMAINS = {"meetings": ("listing", "source_url", "date", "committee_id"), "attendance": ("listing", "source_url", None, "politician_id"), "bills": ("register", "source_url", None, "bill_number"),
            "questions": ("register", "source_url", "asked_date", "asked_by_name"), "vote_events": ("listing", "source_url", "date", None), "people": ("directory", "profile_url", None, "full_name"), "parties": ("directory", "source_url", None, "name"), "committees": ("directory", "source_url", None, "name"),
            "docs": ("listing", "source_url", None, "title"), "vote_totals": ("results", "source_url", None, "party_name")}


def _dom_sql(d):
    s, u, dt, i = _DOMAINS[d]
    return f"""select '{d}' as domain, '{s}' as source, count(*) as records, {f'min({dt})' if dt else 'null::date'} as earliest, {f'max({dt})' if dt else 'null::date'} as latest, count(*) filter (where trim(coalesce({u}, '')) = '') as missing_url,
      {f'count(*) filter (where {dt} is null)' if dt else 'null::bigint'} as missing_date, {'count(*)' if dt else 'null::bigint'} as date_applicable, {f"count(*) filter (where trim(coalesce(cast({i} as varchar), '')) = '')" if i else 'null::bigint'} as missing_identity from {d}"""


_R03 = " union all ".join(_dom_sql(d) for d in _DOMAINS)


def _domains(t):
    return ql.union_all([ql.domain_metric(getattr(t, d), d, *spec) for d, spec in _DOMAINS.items()])


@query("R03_domain_metrics", _R03)
def r03(t):
    return _domains(t)


_R04 = f"select source, sum(records)::bigint as records, min(earliest) as earliest, max(latest) as latest, sum(missing_url)::bigint as missing_url, sum(missing_date)::bigint as missing_date, sum(date_applicable)::bigint as date_applicable, sum(missing_identity)::bigint as missing_identity from ({_R03}) group by 1"


@query("R04_combined_sources", _R04)
def r04(t):
    return ql.combine_sources(_domains(t))


# Keys that must tell rows apart.
_UNIQUE = {"people": "slug", "committees": "slug", "parties": "short_name", "docs": "source_url", "questions": "source_url"}
_DUPN = "(" + " + ".join(f"(select count(*) from (select {k} from {v} group by 1 having count(*) > 1))" for v, k in _UNIQUE.items()) + ")"
_OPEN = "(select count(*) from unresolved where status = 'OPEN')"
_R05 = f"""with d as (select sum(missing_url)::bigint as u, coalesce(sum(missing_date), 0)::bigint as m, coalesce(sum(date_applicable), 0)::bigint as a from ({_R03}))
   select 'Missing source URLs' as risk, u as value, case when u > 0 then 'red' else 'green' end as level from d union all select 'Missing source dates', m, case when m * 4 > a then 'red' when m > 0 then 'yellow' else 'green' end from d
   union all select 'Open unresolved entities', {_OPEN}, case when {_OPEN} > 50 then 'red' when {_OPEN} > 0 then 'yellow' else 'green' end union all select 'Duplicate identifiers', {_DUPN}, case when {_DUPN} > 0 then 'red' else 'green' end"""


def _risks(t, domains):
    open_ = t.unresolved.agg(F.count_if(F.col("status") == "OPEN").alias("n"))
    dup = ql.union_all([tb.duplicate_groups(getattr(t, v), k).agg(F.count("*").alias("n")) for v, k in _UNIQUE.items()]).agg(F.sum("n").alias("n"))
    return ql.risks(domains, open_, dup)


@query("R05_risks", _R05)
def r05(t):
    return _risks(t, cut_lineage(_domains(t)))


@query("R06_actions", f"""with r as ({_R05}), d as ({_R03})
   select 2 as position, concat('Repair missing source URLs in ', domain, ' (', missing_url, ' records).') as action from (select * from d order by missing_url desc, domain desc limit 1) where missing_url > 0
   union all select 3, concat('Review ', {_OPEN}, ' open unresolved entities before entity-level coverage claims.') where {_OPEN} > 0
   union all select 4, 'Keep public-facing completeness claims qualified until red risks are resolved.' where exists (select 1 from r where level = 'red')
   union all select 5, 'No immediate data coverage action is required.' where not exists (select 1 from r where level = 'red') and {_OPEN} = 0 and (select max(missing_url) from d) = 0""")
def r06(t):
    d = cut_lineage(_domains(t))  # ten rows that three steps read; each would read all tables again
    return ql.actions(d, ql.combine_sources(d), cut_lineage(_risks(t, d)))


_COUNTED = ("bills", "vote_events", "vote_records", "meetings", "attendance", "questions")


@query("R07_dashboard", f"""select 'source' as part, source as item, records::double as value, case when records > 0 then 'available' else 'unavailable' end as note from ({_R04}) union all select 'risk', risk, value::double, level from ({_R05})
   union all select 'public_claim', 'safe', count(*) filter (where level = 'red')::double, case when count(*) filter (where level = 'red') > 0 then 'no' else 'yes' end from ({_R05})
   union all select 'election', unnest(['vote totals', 'votes', 'manifests with totals']), unnest([n, v, k]), case when n > 0 then 'ingested' else 'missing' end from (select count(*)::double as n, coalesce(sum(vote_total), 0)::double as v, count(distinct manifest_key)::double as k from vote_totals)
   union all select 'election', unnest(['manifests', 'reachable manifests']), unnest([n, r]), case when n > 0 then 'ingested' else 'missing' end from (select count(*)::double as n, count(*) filter (where reachable)::double as r from manifests)
   union all """ + " union all ".join(f"select 'accountability', '{v}', count(*)::double, case when count(*) > 0 then 'available' else 'unavailable' end from {v}" for v in _COUNTED))
def r07(t):
    domains = cut_lineage(_domains(t))
    d, r = ql.combine_sources(domains), cut_lineage(_risks(t, domains))
    red = r.agg(F.count_if(F.col("level") == "red").alias("n"))
    totals = t.vote_totals.agg(F.count("*").alias("a"), F.coalesce(F.sum("vote_total"), F.lit(0)).alias("b"), F.count_distinct("manifest_key").alias("c"))
    sources = t.manifests.agg(F.count("*").alias("a"), F.count_if("reachable").alias("b"))
    row = lambda df, part, item, value, note: df.select(F.lit(part).alias("part"), item.alias("item"), value.cast("double").alias("value"), note.alias("note"))
    return ql.union_all([
        row(d, "source", F.col("source"), F.col("records"), F.when(F.col("records") > 0, "available").otherwise("unavailable")), row(r, "risk", F.col("risk"), F.col("value"), F.col("level")),
        row(red, "public_claim", F.lit("safe"), F.col("n"), F.when(F.col("n") > 0, "no").otherwise("yes")),
        *[row(totals, "election", F.lit(item), F.col(c), F.when(F.col("a") > 0, "ingested").otherwise("missing")) for item, c in (("vote totals", "a"), ("votes", "b"), ("manifests with totals", "c"))],
        *[row(sources, "election", F.lit(item), F.col(c), F.when(F.col("a") > 0, "ingested").otherwise("missing")) for item, c in (("manifests", "a"), ("reachable manifests", "b"))],
        *[row(getattr(t, v).agg(F.count("*").alias("n")), "accountability", F.lit(v), F.col("n"), F.when(F.col("n") > 0, "available").otherwise("unavailable")) for v in _COUNTED],
    ])


@query("R08_people_scoreboard", """with e as (select distinct lower(trim(full_name)) as k from people where id % 10 <> 3), p as (select distinct lower(trim(full_name)) as k from people where id % 10 <> 7)
   select 'expected_only' as metric, (select count(*) from e where k not in (select k from p)) as value union all select 'present_only', (select count(*) from p where k not in (select k from e))
   union all select concat('party/', coalesce(party, 'unknown')), count(*) from people group by 1 union all select concat('host/', coalesce(lower(regexp_extract(profile_url, '^[A-Za-z]+://([^/]*)', 1)), 'unknown')), count(*) from people group by 1
   union all select 'duplicate_names', count(*) from (select lower(trim(full_name)) from people group by 1 having count(*) > 1)""")
def r08(t):
    from polislake.functions import urls

    sides = tb.reconcile_names(t.people.where("id % 10 <> 3"), t.people.where("id % 10 <> 7"), "full_name")
    both = sides.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("expected_only", "present_only")])
    facet = lambda c, name: t.people.groupBy(F.concat(F.lit(name + "/"), F.coalesce(c, F.lit("unknown"))).alias("metric")).agg(F.count("*").alias("value"))
    dup = tb.duplicate_groups(t.people.select(F.lower(F.trim("full_name")).alias("k")), "k").agg(F.count("*").alias("value")).select(F.lit("duplicate_names").alias("metric"), "value")
    return ql.union_all([tb.as_metric_rows(both).withColumn("value", F.col("value").cast("long")), facet(F.col("party"), "party"), facet(urls.host(F.col("profile_url")), "host"), dup])


_LINKS = {"meetings": ("meetings", "committee_id"), "attendance": ("attendance", "politician_id"), "questions": ("questions", "politician_id"), "vote_records": ("vote_records", "politician_id"), "vote_events": ("vote_events", "committee_id")}


@query("R09_link_coverage", " union all ".join(f"select '{n}' as fact, count({fk}) as linked, count(*) as total, round(cast(100 * count({fk}) as decimal(38,6)) / count(*), 2)::double as linked_pct from {tab}" for n, (tab, fk) in _LINKS.items()))
def r09(t):
    return ql.link_coverage({n: (getattr(t, tab), fk) for n, (tab, fk) in _LINKS.items()})


# Lookup paths: rows that are looked up, by what, and where it must be found.
_PMG = "(select * from docs where document_type like 'PMG%')"
_EXACT = {
    "politician_by_full_name": ("people", "full_name", "people", "full_name"), "politician_by_display_name": ("people", "display_name", "people", "display_name"), "politician_by_slug": ("people", "slug", "people", "slug"),
    "politician_by_alias": ("people", "id", "aliases", "person_id"), "entity_resolution_by_display_name": ("people", "lower(display_name)", "(select lower(full_name) as k from people union select lower(display_name) from people)", "k"),
    "politician_party_join": ("people", "coalesce(party, '')", "parties", "short_name"), "party_by_short_name": ("parties", "short_name", "parties", "short_name"), "committee_by_slug": ("committees", "slug", "committees", "slug"),
    "membership_by_politician": ("memberships", "politician_id", "people", "id"), "membership_by_committee": ("memberships", "committee_id", "committees", "id"), "pmg_doc_by_source_url": (_PMG, "source_url", "docs", "source_url"),
    "pmg_doc_mention_join": (_PMG, "id", "(select document_id from mentions m join people p on p.id = m.politician_id)", "document_id"), "question_by_number": ("questions", "question_number", "questions", "question_number"),
    "question_by_source_url": ("questions", "source_url", "questions", "source_url"), "question_by_politician_id": ("questions", "politician_id", "people", "id"), "attendance_by_name": ("attendance", "lower(trim(name_raw))", "(select lower(full_name) as k from people union select lower(display_name) from people)", "k"),
    "attendance_by_politician": ("attendance", "politician_id", "people", "id"), "attendance_by_meeting": ("attendance", "meeting_id", "meetings", "id"),
}
# A fragment of a value must be found inside some value.
_PARTIAL = {
    "politician_by_ilike": ("people", "split_part(display_name, ' ', 1)", "(select full_name as v from people union all select display_name from people union all select alias from aliases)"), "party_by_name_ilike": ("parties", "substr(name, 1, 4)", "(select name as v from parties)"),
    "committee_by_name_ilike": ("committees", "substr(split_part(name, ' ', 1), 1, 6)", "(select name as v from committees)"), "pmg_doc_by_committee_name": (_PMG, "substr(committee_name, 1, 10)", "(select committee_name as v from docs)"),
    "question_by_department_ilike": ("questions", "substr(department, 1, 10)", "(select department as v from questions)"), "unresolved_by_raw_value": ("unresolved", "substr(raw_value, 1, 10)", "(select raw_value as v from unresolved)"),
}
_R10 = " union all ".join(
    [f"select '{p}' as path, count(*) as checked, count(*) filter (where k is null or k = '' or k not in (select cast({g} as varchar) from {f} where {g} is not null)) as unreachable from (select cast({k} as varchar) as k from {w})" for p, (w, k, f, g) in _EXACT.items()]
    + [f"select '{p}', sum(n)::bigint, coalesce(sum(n) filter (where k is null or k = '' or not exists (select 1 from {f} x where contains(lower(v), k))), 0)::bigint from (select lower({k}) as k, count(*) as n from {w} group by 1)" for p, (w, k, f) in _PARTIAL.items()])


@query("R10_search_completeness", f"with {ALIAS_SQL}, r as ({_R10}) select *, case when unreachable = 0 then 'PASS' when unreachable = checked then 'FAIL' else 'WARN' end as status from r where checked > 0")
def r10(t):
    """All rows over all lookup paths; fragments by a letter-gram index."""
    views = {v: getattr(t, v) for v in ("people", "parties", "committees", "memberships", "docs", "mentions", "questions", "unresolved", "attendance", "meetings")} | {"aliases": alias_table(t.people)}
    sql = lambda text: t.spark.sql(re.sub(rf"\b(from|join) ({'|'.join(views)})\b", r"\1 {\2}", text), **{v: df for v, df in views.items() if re.search(rf"\b(from|join) {v}\b", text)})
    wanted = ql.union_all([sql(f"select '{p}' as path, cast({k} as string) as key from {w}") for p, (w, k, _, _) in _EXACT.items()])
    found = ql.union_all([sql(f"select '{p}' as path, cast({g} as string) as key from {f}") for p, (_, _, f, g) in _EXACT.items()])
    parts = cut_lineage(ql.union_all([sql(f"select '{p}' as path, lower({k}) as key from {w}") for p, (w, k, _) in _PARTIAL.items()]))
    for p, (_, _, f) in _PARTIAL.items():
        names = parts.where((F.col("path") == p) & (F.col("key") != "")).select(F.col("key").alias("_name")).distinct()
        held = tb.contained(sql(f"select v from {f}").where("v is not null").select("v").distinct(), "v", "v", names, 1)
        found = found.unionByName(held.select(F.lit(p).alias("path"), F.col("_name").alias("key")).distinct())
    return ql.reachability(wanted.unionByName(parts), found)


_LAUNCH = {"bills": 1246, "committee meetings": 34713, "parliamentary questions": 44036}


@query("R11_launch_coverage", """with c as (select 'bills' as label, count(*) as n from bills union all select 'committee meetings', count(*) from meetings union all select 'parliamentary questions', count(*) from questions),
   s as (select *, case label when 'bills' then coalesce((select max(source_total) from sweep_log), 1246) when 'committee meetings' then 34713 else 44036 end as source_total from c)
   select label, n, source_total, round(cast(100 * n as decimal(38,6)) / source_total, 2)::double as coverage_pct, case when round(cast(100 * n as decimal(38,6)) / source_total, 2) >= 80 then 'pass' else 'blocker' end as launch_status from s""")
def r11(t):
    counts = ql.union_all([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, df in (("bills", t.bills), ("committee meetings", t.meetings), ("parliamentary questions", t.questions))])
    totals = t.sweep_log.agg(F.max("source_total").alias("source_total")).select(F.lit("bills").alias("label"), "source_total")
    return ql.launch_coverage(counts, totals, _LAUNCH)


_STAGES = """select floor(id / 4) as run_key, case when floor(id / 4) % 9 = 0 then 'dry_run' else 'real' end as mode, case when id % 37 = 0 then 1 else 0 end as failed, case when id % 5 = 0 then id % 12 else 0 end as errors,
   id % 3 <> 0 as advanced, case when id % 7 = 0 then 0 else created_count end as new_records from runs"""
_CLASS = f"""st as ({_STAGES}), g as (select cast(run_key as bigint) as run_key, max(mode) as mode, count(*) filter (where failed > 0) as failed_stages, sum(errors)::bigint as errors, count(*) filter (where advanced) as advanced, count(*) as streams, sum(greatest(new_records, 0))::bigint as new_records from st group by 1),
   k as (select *, failed_stages > 0 or errors >= 10 as hard from g), cl as (select *, case when hard or (mode = 'real' and advanced = 0) then 'red' when errors > 0 or mode <> 'real' or advanced < streams or (new_records = 0 and advanced > 0) then 'yellow' else 'green' end as status from k)"""


def _classified(t):
    st = t.runs.select(
        F.floor(F.col("id") / 4).alias("run_key"), F.when(F.floor(F.col("id") / 4) % 9 == 0, "dry_run").otherwise("real").alias("mode"), F.when(F.col("id") % 37 == 0, 1).otherwise(0).alias("failed"),
        F.when(F.col("id") % 5 == 0, F.col("id") % 12).otherwise(0).alias("errors"), (F.col("id") % 3 != 0).alias("advanced"), F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("created_count")).alias("new_records"),
    )
    return ql.classify_runs(st)


@query("R13_classified_runs", f"with {_CLASS} select run_key, mode, failed_stages, errors, advanced, streams, new_records, status from cl")
def r13(t):
    return _classified(t).drop("reasons")


@query("R12_check_categories", f"""with c as ({_Q06} union all {_Q07} union all {_Q09} union all {_Q10}), g as (select category, case max(case status when 'fail' then 2 when 'warn' then 1 else 0 end) when 2 then 'red' when 1 then 'amber' else 'green' end as status from c group by 1)
   select count(*) filter (where status = 'red') as reds, count(*) filter (where status = 'green') as greens, count(*) as gates, case when count(*) filter (where status = 'red') > 0 then 'red' when count(*) filter (where status = 'green') = count(*) then 'green' else 'amber' end as overall from g""")
def r12b(t):
    c = _checks(t)
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    gates = ql.union_all([c["Q06"], c["Q07"], c["Q09"], c["Q10"]]).groupBy("category").agg(rank.alias("w"))
    return ql.readiness(gates.select(F.when(F.col("w") == 2, "red").when(F.col("w") == 1, "amber").otherwise("green").alias("status")))


_GATE_FACTS = f"""gf as (select (select count(*) > 0 from people where id % 10 <> 3) as universe, (select count(*) = 0 from people where id % 10 = 7 or id % 10 = 3) as claim_all,
     case when (select count(*) from people where id % 10 = 7 or id % 10 = 3) > 0 then 'amber' else 'green' end as people_status, (select count(*) filter (where level = 'red') = 0 from ({_R05})) as claim_safe,
     (select count(*) > 0 and count(*) filter (where vote_total is null) = 0 from vote_totals) as election_complete, 'green' as election_status,
     (select case arg_max(status, run_key) when 'yellow' then 'amber' else arg_max(status, run_key) end from cl) as brief_status, (select count(*) > 0 from run_errors where contains(lower(error), 'blocked')) as blocked,
     (select count(*) > 0 from runs) as access_report, (select count(*) > 0 from committees) as inventory, (select count(*) filter (where source_url is not null) > 0 from bills) as audit,
     (select count(*) from bills) < 0.8 * {_LAUNCH["bills"]} as short_bills, (select count(*) from questions) < 0.8 * {_LAUNCH["parliamentary questions"]} as short_questions)"""


@query("R12_readiness", f"""with {_CLASS}, {_GATE_FACTS},
   gs as (select *, case when not universe then 'red' else people_status end as g1, case when claim_safe then 'green' else 'amber' end as g2, case when election_complete and election_status = 'green' then 'green' else 'amber' end as g3, brief_status as g4,
     case when not blocked and access_report and brief_status = 'green' then 'green' else 'amber' end as g5, case when inventory and audit then 'green' when inventory then 'amber' else 'red' end as g6 from gf),
   o as (select *, case when 'red' in (g1, g2, g3, g4, g5, g6) or not universe or short_bills or short_questions then 'red' when g1 = 'green' and g2 = 'green' and g3 = 'green' and g4 = 'green' and g5 = 'green' and g6 = 'green' and election_complete and claim_all then 'green' else 'amber' end as overall from gs)
   select 'gate' as part, unnest(['people_coverage', 'parliamentary_activity', 'election_coverage', 'ingestion_health', 'source_access', 'source_inventory']) as item, unnest([g1, g2, g3, g4, g5, g6]) as status from o
   union all select 'overall', 'release', overall from o union all select 'blocker', 'expected people are not known', 'blocker' from o where not universe union all select 'blocker', 'election records are incomplete', 'blocker' from o where not election_complete
   union all select 'blocker', 'latest ingestion brief is red', 'blocker' from o where brief_status = 'red' union all select 'blocker', 'source inventory is missing', 'blocker' from o where not inventory union all select 'blocker', 'source audit is missing', 'blocker' from o where not audit
   union all select 'blocker', 'bills coverage is short', 'blocker' from o where short_bills union all select 'blocker', 'parliamentary questions coverage is short', 'blocker' from o where short_questions
   union all select 'capability', unnest(['coverage dashboard', 'election report', 'people report', 'ingestion brief']), 'capability' from o union all select 'capability', 'source inventory', 'capability' from o where inventory
   union all select 'capability', 'source audit', 'capability' from o where audit union all select 'capability', 'source block is visible and isolated', 'capability' from o where blocked""")
def r12(t):
    """The six gates from the other reports, each of which is one row."""
    sides = tb.reconcile_names(t.people.where("id % 10 <> 3"), t.people.where("id % 10 <> 7"), "full_name").agg(F.count("*").alias("apart"))
    facts = [
        t.people.agg((F.count_if(F.col("id") % 10 != 3) > 0).alias("universe")), sides.select((F.col("apart") == 0).alias("claim_all"), F.when(F.col("apart") > 0, "amber").otherwise("green").alias("people_status")),
        _risks(t, cut_lineage(_domains(t))).agg((F.count_if(F.col("level") == "red") == 0).alias("claim_safe")),
        t.vote_totals.agg(((F.count("*") > 0) & (F.count("vote_total") == F.count("*"))).alias("election_complete"), F.lit("green").alias("election_status")),
        _classified(t).agg(F.max_by("status", "run_key").alias("s")).select(F.when(F.col("s") == "yellow", "amber").otherwise(F.col("s")).alias("brief_status")),
        t.run_errors.agg((F.count_if(F.contains(F.lower("error"), F.lit("blocked"))) > 0).alias("blocked")), t.runs.agg((F.count("*") > 0).alias("access_report")), t.committees.agg((F.count("*") > 0).alias("inventory")),
        t.bills.agg((F.count("source_url") > 0).alias("audit"), (F.count("*") < 0.8 * _LAUNCH["bills"]).alias("b")), t.questions.agg((F.count("*") < 0.8 * _LAUNCH["parliamentary questions"]).alias("q")),
    ]
    # One row each with columns of its own: the union folds into one row.
    rows = None
    for f in facts:
        rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
    row = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    short = F.array_compact(F.array(F.when(F.col("b"), F.lit("bills")), F.when(F.col("q"), F.lit("parliamentary questions"))))
    return ql.release_gates(row.withColumn("short_domains", short).drop("b", "q"))


@query("R14_top_new_records", """with g as (select source_name, run_type, count(*) filter (where started_at >= timestamp '2024-01-20') as delta from runs group by 1, 2), r as (select *, row_number() over (order by delta desc, source_name, run_type) as table_rank from g where delta > 0),
   s as (select r.table_rank, r.source_name, r.run_type, delta, u.id, row_number() over (partition by r.table_rank order by u.id) as rn from r join runs u using (source_name, run_type) where r.table_rank <= 5 and u.started_at >= timestamp '2024-01-20')
   select source_name, run_type, delta, id from s where rn <= 2 order by table_rank, rn limit 5""")
def r14(t):
    fresh = F.col("started_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    top = t.runs.groupBy("source_name", "run_type").agg(F.count_if(fresh).alias("delta")).where("delta > 0").orderBy(F.desc("delta"), "source_name", "run_type").limit(5)
    samples = tb.top_k(t.runs.where(fresh).join(top, ["source_name", "run_type"]), ["source_name", "run_type"], [F.col("id")], 2, rank="rn")
    return samples.orderBy(F.desc("delta"), "source_name", "run_type", "rn").limit(5).select("source_name", "run_type", "delta", "id")


@query("R16_dataset_report", " union all ".join(f"select '{m}' as metric, {_c(m)}::double as value" for m in ("total_politicians", "total_documents", "total_document_mentions", "unresolved_entities_open"))
       + f" union all select concat('issues/', issue), count(*)::double from ({_Q02}) group by 1")
def r16(t):
    x = _all(t)
    some = ql.quality_summary(x).where(F.col("metric").isin("total_politicians", "total_documents", "total_document_mentions", "unresolved_entities_open"))
    issues = ql.quality_issues(x).groupBy(F.concat(F.lit("issues/"), "issue").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return some.unionByName(issues)


_RUN_FACTS = "1 + run_key % 7 as pages_per_run, run_key * 7 % 100 as coverage_pct, run_key % 3 as vote_events, run_key % 2 as vote_records, run_key % 5 as meetings, run_key % 4 as attendance"
_STEP = {k: "'" + re.sub(r"\{(\w)\}", r"' || {\1} || '", v) + "'" for k, v in ql.RUN_STEPS.items()}


@query("R18_next_actions", f"""with {_CLASS}, x as (select *, {_RUN_FACTS} from cl), s as (select run_key, status, list_filter([case when mode <> 'real' then {_STEP["validation"]} end, case when errors > 0 then {_STEP["errors"]} end,
     case when status = 'green' and pages_per_run < 6 then {_STEP["larger"].format(p="pages_per_run", q="least(pages_per_run * 2, 6)")} end, case when status = 'green' and pages_per_run >= 6 then {_STEP["steady"].format(p="pages_per_run")} end,
     case when coverage_pct < 50 then {_STEP["coverage"].format(c="coverage_pct")} end, case when vote_events > 0 and vote_records = 0 then {_STEP["no_votes"]} end, case when meetings > 0 and attendance = 0 then {_STEP["no_attendance"]} end,
     case when new_records = 0 and advanced > 0 then {_STEP["idle"]} end], lambda v: v is not null) as steps from x)
   select run_key, case when len(steps) > 0 then array_to_string(steps, chr(10)) else 'No action required. Scheduled sweeps continue automatically.' end as next_actions, status = 'green' as quiet from s""")
def r18(t):
    facts = [F.expr(x.rsplit(" as ", 1)[0]).alias(x.rsplit(" as ", 1)[1]) for x in _RUN_FACTS.split(", ")]
    a = ql.next_actions(_classified(t).select("*", *facts))
    return a.select("run_key", F.array_join("next_actions", "\n").alias("next_actions"), (F.size("attention") == 0).alias("quiet"))


@query("R20_recent_identity_runs", "select id, run_type, status from runs where run_type in ('identity_bootstrap', 'alias_regeneration', 'party_enrichment') order by started_at desc, id desc limit 20")
def r20(t):
    kinds = t.runs.where(F.col("run_type").isin("identity_bootstrap", "alias_regeneration", "party_enrichment"))
    return kinds.orderBy(F.desc("started_at"), F.desc("id")).limit(20).select("id", "run_type", "status")
