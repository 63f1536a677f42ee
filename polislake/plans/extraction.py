"""Sources, page extraction, vote totals and catalogues (S, T, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import html, urls
from polislake.operators import catalog as cat
from polislake.operators import extract as ex
from polislake.operators import votes
from polislake.plans.bindings import _FIRST, _TOPIC, _committee, _display, _pick, _surname
from polislake.plans.registry import query
from polislake.plans.scalars import FORMAT_SQL, READY_SQL, RESULT_KEY_SQL, STABLE_URL_SQL
from polislake.plans.sqltext import case_contains
from polislake.session import cut_lineage
from polislake.sources import readers

_ENT = "&lt;,<|&gt;,>|&quot;,\"|&#39;,''|&nbsp;, |&copy;,©|&middot;,·|&amp;,&"


def _plain(expr: str) -> str:
    """Visible text of HTML in DuckDB."""
    e = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({expr}, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
    for pair in _ENT.split("|"):
        a, b = pair.split(",", 1)
        e = f"replace({e}, '{a}', '{b}')"
    return rf"trim(regexp_replace({e}, '[\s\x{{A0}}]+', ' ', 'g'))"


# --------------------------------------------------------------------------- sources


@query("S01_table_scan", "select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '2000-01-01'")
def s01(t):
    return readers.read_table(t.spark, f"{t.sf_dir}/orders.parquet").where("o_orderdate >= timestamp_ntz '2000-01-01 00:00:00'").select("o_orderkey", "o_totalprice")


_V_FAIL = """case when trim(coalesce(contest_id, '')) = '' or trim(coalesce(party_id, '')) = '' then 'Contest_ID and Party_ID are required' when not regexp_full_match(replace(trim(coalesce(votes, '')), ',', ''), '\\d+') then 'Votes must be a non-negative integer' end"""


@query("S02_vote_rows_quarantine", f"select row_number, {_V_FAIL} as failure, case when {_V_FAIL} is null then cast(replace(trim(votes), ',', '') as bigint) end as vote_total from vote_csv")
def s02(t):
    return votes.validate(t.vote_csv).select("row_number", "failure", "vote_total")


@query("S03_listing_bills", """select o_orderkey as id, concat('Title ', o_orderkey) as title, case when o_orderkey % 3 <> 0 then concat('B', o_orderkey % 50, '-2020') end as bill_number, 2020 as year,
   case o_orderkey % 3 when 0 then 'assented' when 1 then 'passed' else 'unknown' end as status, concat('https://records.example.org/bill/', o_orderkey, '/') as source_url from orders""")
def s03(t):
    return readers.bills_of(readers.parse_listing(t.listing_json, "payload"), "https://records.example.org")


@query("S04_listing_events", """select o_orderkey as bill_id, 'introduced' as event_type, make_date(2020, 1, 1 + o_orderkey % 9) as event_date, 'Tabled' as description from orders
   union all select o_orderkey, 'unknown', null, null from orders""")
def s04(t):
    return readers.bill_events_of(readers.parse_listing(t.listing_json, "payload"))


@query("S04_listing_attendance", f"""select o_orderkey as meeting_id, concat({_surname('o_custkey')}, ', Ms ', {_pick(_FIRST, 'o_custkey')}) as name_raw, 'ANC' as party_name,
   case o_orderkey % 5 when 0 then 'present' when 1 then 'apology' when 2 then 'present' when 3 then 'absent' else 'unknown' end as attendance_status, 1.0::double as confidence from orders""")
def s04b(t):
    return readers.attendance_of(readers.parse_listing(t.listing_json, "payload"))


@query("S05_url_lines", "select trim(concat('  ', url, ' ')) as url from links where page_id % 5 > 1")
def s05(t):
    lines = t.links.select(F.expr("case page_id % 5 when 0 then '   ' when 1 then concat(' # ', url) else concat('  ', url, ' ') end").alias("value"))
    return readers.url_lines(lines, "value")


@query("S06_merged_urls", "select url from links union select source_url from docs")
def s06(t):
    return readers.merged_urls(t.links, t.docs.select(F.col("source_url").alias("url")))


@query("S07_archive_key", r"""select page_id, concat_ws('-', trim(regexp_replace(lower(coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), ''),
   regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))), '[^a-z0-9]+', '-', 'g'), '-'), substr(sha256(url), 1, 10)) as archive_key from links""")
def s07(t):
    return readers.archive(t.links, "url", "page_id").select("page_id", "archive_key")


@query("S10_inspect", """select 'parties' as table_name, 'count' as field, cast(count(*) as varchar) as value from parties union all
   select 'parties', unnest(['id', 'name', 'source_url']), unnest([cast(id as varchar), name, source_url]) from (select * from parties order by id, name limit 2) union all
   select 'committees', 'count', cast(count(*) as varchar) from committees union all
   select 'committees', unnest(['id', 'name', 'source_url', 'slug']), unnest([cast(id as varchar), name, source_url, slug]) from (select * from committees order by id, name limit 2)""")
def s10(t):
    return readers.inspect({"parties": t.parties, "committees": t.committees}, 2)


# --------------------------------------------------------------------------- pages


@query("T01_visible_text", f"select page_id, {_plain('html')} as body from links")
def t01(t):
    return t.links.select("page_id", html.visible_text(F.col("html")).alias("body"))


@query("T02_title", "select page_id, case when page_id % 4 = 0 then 'Social title' else concat('Meeting & vote ', page_id) end as title from meeting_html")
def t02(t):
    return t.meeting_html.select("page_id", html.title(F.col("html")).alias("title"))


@query("T02_title_of_pages", rf"select page_id, {_plain(chr(39).join(['regexp_extract(html, ', '<h1\\b[^>]*>(.*?)</h1\\s*>', ', 1, ', 'is', ')']))} as title from links")
def t02b(t):
    return t.links.select("page_id", html.title(F.col("html")).alias("title"))


@query("T03_links", r"""select distinct page_id, concat('https://', lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), h, case when h like '%/' then '' else '/' end) as link
   from (select page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as h from links) where regexp_matches(h, '^/[a-z]+/?$')""")
def t03(t):
    return ex.page_links(t.links, "/[a-z]+/")


@query("T04_publication_date", "select page_id, case when page_id % 3 = 0 then cast(o_orderdate as date) else make_date(1995 + o_custkey % 20, 3, 1 + o_custkey % 28) end as published from meeting_html join orders on o_orderkey = page_id")
def t04(t):
    return t.meeting_html.select("page_id", ex.publication_date(F.col("html"), html.visible_text(F.col("html"))).alias("published"))


@query("T05_committee_name", f"select o_orderkey as page_id, case when o_orderkey % 2 = 0 then {_committee('(o_custkey % 10)')} else concat('Portfolio Committee on ', {_pick(_TOPIC, 'o_custkey')}) end as committee from orders")
def t05(t):
    return t.meeting_html.select("page_id", ex.committee_of(F.col("html"), html.visible_text(F.col("html"))).alias("committee"))


@query("T06_document_type", """select id, case when id % 4 = 0 then 'PMG_COMMITTEE_MEETING' when id % 4 = 1 then 'PMG_BRIEFING' when contains(l, 'report') then 'PMG_REPORT' when contains(l, 'briefing') then 'PMG_BRIEFING' when contains(l, 'meeting') then 'PMG_COMMITTEE_MEETING' else 'PMG_DOCUMENT' end as kind
   from (select id, lower(concat_ws(' ', 'https://x.example.org/item/', title, coalesce(summary, ''))) as l from meetings)""")
def t06(t):
    url = F.expr("case id % 4 when 0 then concat('https://x.example.org/Committee-Meeting/', id) when 1 then concat('https://x.example.org/briefing/', id) else 'https://x.example.org/item/' end")
    return t.meetings.select("id", ex.document_type(url, F.col("title"), F.col("summary")).alias("kind"))


@query("T07_vote_tables", f"""select o_orderkey as page_id, 1 as "row", 'party' as level, concat('Party ', o_custkey % 5) as name, 'yes' as value, cast(o_custkey % 90 as int) as n from orders
   union all select o_orderkey, 1, 'party', concat('Party ', o_custkey % 5), 'no', cast(1000 + (o_orderkey % 9) * 10 as int) from orders union all select o_orderkey, 2, 'party', 'Party X', 'no', cast(o_orderkey % 7 as int) from orders
   union all select o_orderkey, 3, 'individual', {_display('o_custkey')}, case o_orderkey % 4 when 0 then 'yes' when 1 then 'no' when 2 then 'abstain' else 'unknown' end, null from orders""")
def t07(t):
    return ex.vote_table_records(t.vote_pages)


@query("T07_bill_tables", """select p_partkey as page_id, concat(p_name, ' Bill [B ', p_size, ']') as title, concat('B ', p_size) as bill_number, 1990 + p_size % 30 as year,
   case p_size % 4 when 0 then 'assented' when 1 then 'passed' when 2 then 'withdrawn' else 'unknown' end as status, concat('https://records.example.org/bill/', p_partkey, '/') as source_url from part""")
def t07b(t):
    return ex.bill_table_rows(t.bill_pages, "https://records.example.org")


@query("T08_bill_history", f"""with li as (select p_partkey as page_id, unnest([concat('Introduced on ', 1 + p_size % 28, ' March ', 1990 + p_size % 30), concat('Second reading ', 1990 + p_size % 30, '-06-1', p_size % 10), 'No news',
      concat('National Assembly : ', p_name, ' Act B', p_size, 'A introduced 20', 10 + p_size % 10), concat(p_name, ' Bill [B ', p_size, '] ', 1990 + p_size % 30, ' ', case p_size % 4 when 0 then 'Signed into law' when 1 then 'Passed by NCOP' when 2 then 'Withdrawn' else 'Pending' end), 'Bill Year Status']) as d,
      unnest([make_date(1990 + p_size % 30, 3, 1 + p_size % 28), make_date(1990 + p_size % 30, 6, 10 + p_size % 10), null, null, null, null]) as dt from part)
   select page_id, {case_contains('d', vocab.BILL_EVENT_KEYWORDS, 'unknown')} as event_type, dt as event_date, d as description from li where {case_contains('d', vocab.BILL_EVENT_KEYWORDS, 'unknown')} <> 'unknown' or dt is not null""")
def t08(t):
    return ex.bill_history(t.bill_pages)


_COL = r"trim(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' :-')"


@query("T09_label_fields", """select id, question_number, trim(asked_by_name) || ' (XY)' as asked_by, department, minister, cast(asked_date as varchar) as asked_on from question_texts""")
def t09(t):
    f = t.question_texts.select("id", ex.label_fields(F.col("body")).alias("f"))
    pick = lambda k: F.try_element_at("f", F.lit(k))
    return f.select("id", pick("question number").alias("question_number"), pick("asked by").alias("asked_by"), pick("department").alias("department"), pick("minister").alias("minister"), pick("question date").alias("asked_on"))


@query("T10_question_answer_split", rf"""select id, case when id % 4 <> 0 then {_COL.format(c="replace(replace(question_text, ':', ' '), '-', ' ')")} else body end as question_text,
   case when answer_text is not null and id % 4 <> 0 then {_COL.format(c="replace(replace(answer_text, ':', ' '), '-', ' ')")} end as answer_text
   from question_texts where id % 4 = 0 or not regexp_matches(question_text || coalesce(answer_text, ''), '\b(No|Number|Member|MP|Status|Question|Answer|Reply)\s*[:\-]', 'i')""")
def t10(t):
    safe = t.question_texts.where((F.col("id") % 4 == 0) | ~F.concat("question_text", F.coalesce("answer_text", F.lit(""))).rlike(r"(?i)\b(No|Number|Member|MP|Status|Question|Answer|Reply)\s*[:\-]"))
    return ex.question_records(safe.select("id", "body"), "body").select("id", "question_text", "answer_text")


@query("T11_question_record", r"""select id, nullif(regexp_extract(question_number, '\b([A-Z]{0,4}\s*\d{1,6}(?:/\d{1,6})?)\b', 1, 'i'), '') as question_number, trim(regexp_replace(trim(regexp_replace(asked_by_name, '\s+', ' ', 'g')), '\s*\(XY\)$', '')) as asked_by_name, department, minister, asked_date,
   case when id % 3 = 0 then 'Pending' when answer_text is null or id % 4 = 0 then 'UNANSWERED' else 'ANSWERED' end as status, 'PARSED' as parse_status from question_texts""")
def t11(t):
    r = ex.question_records(t.question_texts.select("id", "body"), "body")
    return r.select("id", "question_number", "asked_by_name", "department", "minister", "asked_date", "status", "parse_status")


@query("T12_question_number", "select id, case when id % 2 = 0 then concat('NW', id % 1000) else concat('PQ ', id % 1000, '/20') end as question_number from questions")
def t12(t):
    body = F.expr("case when id % 2 = 0 then concat('Reply to parliamentary question NW', cast(id % 1000 as string), ' of the house') else concat('No: see PQ ', cast(id % 1000 as string), '/20') end")
    return ex.question_records(t.questions.select("id", body.alias("b")), "b").select("id", "question_number")


@query("T13_binary_bodies", "select doc_id, doc_id % 7 in (0, 1) as is_binary, length(text) as n_clean from documents")
def t13(t):
    nul = F.lit("\x00")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("PK\x03\x04"), "text")).when(F.col("doc_id") % 7 == 1, F.concat(F.repeat(nul, 5), "text")).when(F.col("doc_id") % 7 == 2, F.concat(nul, "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", ex.binary_record(body).alias("is_binary"), F.length("text").alias("n_clean"))


_MARK = "(" + " or ".join(f"contains(lower(summary), '{m}')" for m in vocab.DIVISION_MARKERS) + ")"
_KIND = case_contains("summary", [(p, k) for p, k, _ in vocab.VOTE_SIGNALS], "unknown")
_RES = case_contains("summary", [(p, r) for p, _, r in vocab.VOTE_SIGNALS])


@query("T14_vote_signal", f"select id, case when {_MARK} then {_KIND} end as vote_type, case when {_MARK} then {_RES} end as result from meetings")
def t14(t):
    return t.meetings.select("id", ex.vote_signal(F.col("summary")).alias("s")).select("id", "s.vote_type", "s.result")


@query("T15_vote_counts", r"""select id, v as vote_value, cast(n as int) as n from (select id, unnest(['yes', 'no', 'abstain']) as v, unnest([regexp_extract(summary, '(\d+)\s+vot(?:es|ed)\s+in\s+favour', 1, 'i'),
   regexp_extract(summary, '(\d+)\s+vot(?:es|ed)\s+against', 1, 'i'), regexp_extract(summary, '(\d+)\s+abstentions?', 1, 'i')]) as n from meetings) where n <> ''""")
def t15(t):
    return t.meetings.select("id", F.explode(ex.vote_counts(F.col("summary"))).alias("c")).select("id", "c.vote_value", "c.n")


@query("T16_vote_events", f"select id, concat('Committee decision: ', title) as title, date, case when {_KIND} = 'unknown' then 'committee_decision' else {_KIND} end as vote_type, {_RES} as result from meetings where {_MARK}")
def t16(t):
    return ex.vote_events(t.meetings, "summary").select("id", "title", "date", "vote_type", "result")


@query("T17_source_status", "select c_custkey as page_id, case c_custkey % 4 when 0 then 'CURRENT' when 1 then 'FORMER' when 2 then 'UNKNOWN' else 'CURRENT' end as status from customer")
def t17(t):
    return t.profile_pages.select("page_id", ex.source_status(F.col("html"), F.col("url")).alias("status"))


@query("T18_field_presence", "select page_id, case when contains(l, 'position') or contains(l, 'role') or contains(l, 'whip') or contains(l, 'chairperson') then 'role' else '' end as role_field, contains(l, 'party') as has_party from (select page_id, lower(regexp_replace(html, '<[^>]+>', ' ', 'g')) as l from profile_pages)")
def t18(t):
    f = t.profile_pages.select("page_id", ex.field_presence(F.col("html")).alias("f"))
    return f.select("page_id", F.when(F.array_contains("f", F.lit("role")), "role").otherwise("").alias("role_field"), F.array_contains("f", F.lit("party")).alias("has_party"))


@query("T19_person_contexts", rf"""with c as (select id, list_filter(list_transform(regexp_split_to_array(regexp_replace(summary, '([.!?])\s+', '\1|', 'g'), '\|'), lambda s: trim(s)), lambda s: s <> '') as ch, {_surname('asker_id')} as who from meetings where summary is not null)
   select id, array_to_string(ch[1:3], ' ') as context from c""")
def t19(t):
    m = t.meetings.where("summary is not null").select("id", ex.person_contexts(F.col("summary"), F.array(F.expr(_surname("asker_id")))).alias("c"))
    return m.select("id", F.explode("c").alias("context"))


@query("T20_topic_excerpt", r"""with c as (select id, list_filter(list_transform(regexp_split_to_array(regexp_replace(summary, '([.!?])\s+', '\1|', 'g'), '\|'), lambda s: trim(s)), lambda s: s <> '') as ch from meetings where summary is not null)
   select id, array_to_string(list_concat(ch[1:1], ch[3:4]), ' ') as topic from c""")
def t20(t):
    return t.meetings.where("summary is not null").select("id", ex.topic_excerpt(F.col("summary"), F.array(F.expr(_surname("asker_id")))).alias("topic"))


@query("T21_infer_asker", f"select id, case when id % 3 = 0 then concat('Mr ', d) when id % 3 = 1 then concat('Dr ', d, ' (DA)') end as asker from (select id, {_display('asker_id')} as d from meetings)")
def t21(t):
    body = F.expr(f"case id % 3 when 0 then concat('12. Mr ', {_display('asker_id')}, ' to ask the Minister') when 1 then concat('Dr ', {_display('asker_id')}, ' (DA) to ask the Minister') else 'nobody to ask' end")
    return t.meetings.select("id", ex.infer_asker(body).alias("asker"))


@query("T22_committee_members", f"""select o_orderkey as page_id, {_display('o_custkey')} as name, 'Chairperson' as role from orders union all select o_orderkey, {_display('(o_custkey + 1)')}, 'Whip' from orders
   union all select o_orderkey, concat('Visitor ', upper(substr(l, 1, 1)), substr(l, 2)), 'Member' from (select o_orderkey, translate(cast(o_orderkey as varchar), '0123456789', 'abcdefghij') as l from orders)""")
def t22(t):
    return ex.committee_members(t.member_pages).select("page_id", "name", "role")


@query("T23_profiles", f"""select c_custkey as page_id, {_display('c_custkey')} as full_name, concat(c_mktsegment, ' Front') as party_name, substr(c_mktsegment, 1, 3) as party_short_name,
   case when c_custkey % 2 = 0 then 'https://www.example.org/media/p.jpg' else concat('https://img.example.org/', c_custkey, '.png') end as photo_url from customer""")
def t23(t):
    return ex.profiles(t.profile_pages).select("page_id", "full_name", "party_name", "party_short_name", "photo_url")


@query("T23_profile_committees", f"select c_custkey as page_id, {_committee('(c_custkey % 10)')} as committee, 'Chairperson' as role, make_date(2010 + c_custkey % 10, 5, 3) as start_date from customer")
def t23b(t):
    return ex.profile_committees(ex.profiles(t.profile_pages))


@query("T24_bill_links", """select p_partkey as page_id, concat(p_name, ' Act B', p_size, 'A') as title, concat('B', p_size, 'A') as bill_number, 2010 + p_size % 10 as year, 'National Assembly' as house, 'introduced' as status,
   concat('https://laws.example.org/bill/', p_partkey) as source_url from part""")
def t24(t):
    return ex.bill_links(t.bill_pages, "https://records.example.org")


@query("T25_meeting_pages", f"""select o_orderkey as page_id, concat('Meeting & vote ', o_orderkey) as title, make_date(1995 + o_custkey % 20, 3, 1 + o_custkey % 28) as date, concat('Portfolio Committee on ', {_pick(_TOPIC, 'o_custkey')}, '; notes of the day. minutes paper') as summary from orders where o_orderkey % 4 <> 0""")
def t25(t):
    return ex.meeting_pages(t.meeting_html)


@query("T25_meeting_attendance", f"""select o_orderkey as page_id, {_display('o_custkey')} as name_raw, 'present' as attendance_status, 0.9::double as confidence from orders union all select o_orderkey, concat('Mr ', {_surname('(o_custkey + 1)')}), 'present', 0.9 from orders
   union all select o_orderkey, {_display('(o_custkey + 2)')}, 'apology', 0.85 from orders union all select o_orderkey, concat('Ms ', {_surname('(o_custkey + 3)')}), 'absent', 0.85 from orders""")
def t25b(t):
    return ex.meeting_page_attendance(t.meeting_html)


@query("T26_first_pdf_link", "select page_id, concat('https://records.example.org/files/minutes-', page_id, '.pdf') as pdf_url from meeting_html")
def t26(t):
    return ex.first_pdf_link(t.meeting_html)


@query("T26_question_links", "select page_id, 'https://records.example.org/question-papers/x/' as link from meeting_html")
def t26b(t):
    found = t.meeting_html.select("page_id", "url", F.explode(html.links(F.col("html"))).alias("l"))
    full = found.select("page_id", urls.canonical(urls.absolute(F.col("l.href"), F.col("url"))).alias("link"), "l.label")
    return full.where(urls.looks_question_related(F.col("link"), F.col("label"))).select("page_id", "link")


# --------------------------------------------------------------------------- vote totals


@query("V01_validated_rows", f"""select row_number, {RESULT_KEY_SQL.format(cand="nullif(trim(candidate_id), '')", contest="trim(contest_id)", geo="province_id", manifest="manifest_key", party="trim(party_id)")} as result_key, cast(replace(votes, ',', '') as bigint) as vote_total
   from vote_csv where {_V_FAIL} is null""")
def v01(t):
    return votes.keyed_totals(votes.validate(t.vote_csv)).select("row_number", "result_key", "vote_total")


@query("U13_vote_total_upsert", f"""with g as (select row_number, contest_id, party_id, candidate_id, province_id, manifest_key, cast(replace(votes, ',', '') as bigint) as v from vote_csv where {_V_FAIL} is null),
   n as (select contest_id, party_id, candidate_id, province_id, manifest_key, arg_max(v, row_number) as v from g where (row_number % 3 = 0 or row_number % 2 = 1) group by 1, 2, 3, 4, 5), o as (select contest_id, party_id, candidate_id, province_id, manifest_key, arg_max(v, row_number) as v from g where row_number % 2 = 0 group by 1, 2, 3, 4, 5)
   select coalesce(o.manifest_key, n.manifest_key) as manifest_key, coalesce(o.contest_id, n.contest_id) as contest_id, coalesce(o.party_id, n.party_id) as party_id, coalesce(n.v, o.v) as vote_total, case when o.v is null then 'created' when n.v is null then 'unchanged' else 'updated' end as change
   from o full join n on (o.contest_id, o.party_id, o.candidate_id, o.province_id, o.manifest_key) = (n.contest_id, n.party_id, n.candidate_id, n.province_id, n.manifest_key)""")
def u13(t):
    from polislake.operators.merge import merge_upsert
    from polislake.operators.tables import first_per_key

    good = votes.keyed_totals(votes.validate(t.in_file_order("vote_csv", "lineitem"))).select("result_key", "manifest_key", "contest_id", "party_id", "vote_total", "row_number", "_at")
    last = [F.desc("row_number"), F.col("_at")]
    old = first_per_key(good.where("row_number % 2 = 0"), ["result_key"], last).drop("row_number", "_at")
    return merge_upsert(old, good.where("row_number % 3 = 0 or row_number % 2 = 1"), ["result_key"], {}, order=last).drop("result_key")


@query("V02_ingest_report", f"""with g as (select *, cast(replace(votes, ',', '') as bigint) as v, concat_ws('~', manifest_key, trim(contest_id), province_id, trim(party_id), coalesce(nullif(trim(candidate_id), ''), '-')) as k from vote_csv where {_V_FAIL} is null),
   o as (select distinct k from g where row_number % 2 = 0)
   select (select count(*) from vote_csv) as input_rows, (select count(*) from g) as valid_rows, (select count(*) from vote_csv) - (select count(*) from g) as failed_rows, (select count(distinct k) from g where k not in (select k from o)) as created,
     (select count(distinct k) from g where k in (select k from o)) as updated, (select sum(v)::bigint from g) as vote_sum, (select count(*) from (select distinct party_id, party_name from g)) as unresolved_parties,
     (select count(*) from (select distinct nullif(trim(candidate_id), ''), candidate_name from g where nullif(trim(candidate_id), '') is not null or candidate_name is not null)) as unresolved_candidates, 0 as exit_code""")
def v02(t):
    checked = votes.validate(t.vote_csv)
    stored = votes.keyed_totals(checked).where("row_number % 2 = 0").select("result_key")
    return votes.ingest_report(checked, stored)


_V03 = """select (select count(*) from manifests) as manifests, (select count(*) from manifests where reachable) as reachable, (select count(*) from manifests where source_type in ('csv', 'json', 'xlsx')) as structured,
   (select count(*) from manifests where trim(coalesce(source_url, '')) = '') as manifests_without_url, (select count(*) from vote_totals) as totals, (select sum(vote_total)::bigint from vote_totals) as vote_sum,
   (select count(*) from vote_totals where trim(coalesce(source_url, '')) = '') as totals_without_url, (select count(*) from vote_totals where trim(coalesce(manifest_key, '')) = '') as totals_without_key,
   (select count(*) from manifests where manifest_key not in (select manifest_key from vote_totals)) as manifests_without_totals, (select count(*) from vote_totals where manifest_key not in (select manifest_key from manifests)) as totals_without_manifest,
   (select count(*) from (select id from vote_totals group by 1 having count(*) > 1)) as duplicate_keys"""


@query("V03_coverage_report", _V03)
def v03(t):
    return votes.coverage_report(t.manifests, t.vote_totals)


@query("V04_traffic_light", f"with r as ({_V03}) select case when totals_without_manifest + manifests_without_url + totals_without_url + totals_without_key + duplicate_keys > 0 then 'red' when manifests = 0 or totals = 0 or manifests_without_totals > 0 then 'yellow' else 'green' end as readiness, vote_sum from r")
def v04(t):
    return votes.traffic_light(votes.coverage_report(t.manifests, t.vote_totals)).select("readiness", "vote_sum")


@query("V05_unresolved_identifiers", " union all ".join(f"select '{k}' as kind, {c} as identifier, count(*) as n, sum(vote_total)::bigint as votes, min(manifest_key) as manifest from vote_totals where trim(coalesce({c}, '')) <> '' group by 2" for k, c in (("party", "party_id"), ("candidate", "candidate_id"), ("geography", "geography_id"), ("contest", "contest_id"))))
def v05(t):
    return votes.unresolved_identifiers(t.vote_totals)


# --------------------------------------------------------------------------- catalogues

_MAN = f"""m0 as (select *, case when election_type in ('national', 'provincial', 'municipal', 'by-election') then concat_ws('-', election_type, cast(election_year as varchar)) end as election_key, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format, {STABLE_URL_SQL.format(u='source_url')} as base from catalogue),
   man as (select id, concat_ws('#', base, election_key) as manifest_key, election_key, format, {READY_SQL.format(ok='ok', f='format')} as readiness, sha256(body) as checksum, cast(strlen(body) as int) as byte_size, source_url, election_type, election_year, geography_level, ok as reachable from m0)"""


@query("V06_manifests", f"with {_MAN} select id, manifest_key, election_key, format, readiness, checksum, byte_size from man")
def v06(t):
    return cat.manifests(t.catalogue).select("id", "manifest_key", "election_key", "format", "readiness", "checksum", "byte_size")


@query("V06_elections", f"with {_MAN} select election_key, arg_min(election_type, id) as election_type, arg_min(coalesce(election_year, 0), id) as election_year, arg_min(source_url, id) as source_url from man where election_key is not null group by 1")
def v06b(t):
    return cat.elections(cat.manifests(t.catalogue)).withColumn("election_year", F.coalesce("election_year", F.lit(0)))


_FACETS = ("election_type", "election_year", "geography_level", "readiness", "reachable")


@query("V07_facets", f"with {_MAN} " + " union all ".join(f"select '{c}' as facet, coalesce(cast({c} as varchar), 'unknown') as key, count(*) as n from man group by 2" for c in _FACETS))
def v07(t):
    return cat.facets(cat.manifests(t.catalogue), list(_FACETS))


@query("V08_download_audit", f"""with f as (select *, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format, strlen(body) as size, lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)) as h from catalogue),
   g as (select *, h <> 'example.org' and h not like '%.example.org' as off, concat_ws('|', case when h <> 'example.org' and h not like '%.example.org' then 'redirect_off_official_domain' end,
      case when size > 3000 then 'oversize' end, case when size >= 3000 then 'body_sampled_not_full' end, case when format = 'csv' then 'csv_header_missing_expected_columns' end) as flags from f)
   select id, flags, coalesce(status between 200 and 399, false) and not off as reachable, case when format in ('csv', 'json', 'xlsx') and flags = '' and coalesce(status between 200 and 399, false) and not off then 'structured-candidate' when format in ('html', 'pdf') then 'needs-parser-design' else 'unknown' end as profile from g""")
def v08(t):
    a = cat.audit_downloads(t.catalogue, "example.org", 3000, ["contest_id", "party_id", "votes"])
    return a.select("id", F.array_join("risk_flags", "|").alias("flags"), "reachable", "profile")


@query("V09_format_audit", f"""with f as (select id, source_url, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format from catalogue), s as (select *, format in ('csv', 'json', 'xlsx') and id % 4 < 2 as safe from f)
   select id, safe, case when safe then case format when 'csv' then 1 when 'json' then 2 else 3 end end as priority, row_number() over (order by case when safe then case format when 'csv' then 1 when 'json' then 2 else 3 end end nulls last, source_url, id) = 1 as chosen from s""")
def v09(t):
    from polislake.plans.scalars import HEADERS

    src = t.catalogue.select("id", "source_url", urls.file_format(F.col("source_url"), F.col("content_type")).alias("format"), F.split(F.expr(HEADERS.format(k="id")), r"\|").alias("columns"))
    audited = cat.audit_headers(src).select("id", "source_url", "safe", "priority")
    best = audited.where("safe").orderBy(F.asc_nulls_last("priority"), "source_url", "id").limit(1).select("id", F.lit(True).alias("chosen"))
    return audited.join(best, "id", "left").select("id", "safe", "priority", F.coalesce("chosen", F.lit(False)).alias("chosen"))


_OFF = "case when id % 3 = 0 then 'official' else 'supporting' end"
_USE = "case when id % 2 = 0 then 'baseline authority' else 'not safe yet' end"


@query("V10_member_audit", f"""with k as (select id, ok, {_OFF} as o, {_USE} as u, case when split_part(lower(source_url), '?', 1) like '%.html' then 'html' when content_type = 'text/csv' then 'csv' when content_type = 'application/json' then 'api' when content_type = 'application/pdf' then 'pdf'
     when content_type = 'text/html' then 'html' else 'unknown' end as source_kind from catalogue)
   select source_kind, case when not ok then 'unreachable' when source_kind in ('csv', 'api') then 'structured-candidate' when source_kind in ('html', 'pdf') then 'needs-parser-validation' else 'unknown' end as readiness, count(*) as n,
     count(*) filter (where o = 'official' and u = 'baseline authority') as baseline_candidates from k group by 1, 2""")
def v10(t):
    a = cat.audit_members(t.catalogue.withColumns({"officialness": F.expr(_OFF), "recommended_use": F.expr(_USE)}))
    return a.groupBy("source_kind", "readiness").agg(F.count("*").alias("n"), F.count_if("baseline").alias("baseline_candidates"))


@query("V11_division_audit", f"""with f as (select id % 5 = 0 as implemented, ok, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format, id % 11 = 0 as mp from catalogue)
   select case when implemented then 'implemented-limited' when not ok then 'unreachable' when format in ('json', 'csv', 'xlsx') then 'structured-candidate' else 'needs-parser-design' end as readiness, count(*) as n, bool_or(mp) as mp_level from f group by 1""")
def v11(t):
    a = cat.audit_divisions(t.catalogue.withColumns({"implemented": F.col("id") % 5 == 0, "mp": F.col("id") % 11 == 0}))
    return a.groupBy("readiness").agg(F.count("*").alias("n"), F.bool_or("mp").alias("mp_level"))


@query("V12_discovery_report", f"""with f as (select id, ok, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format, lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)) like '%.example.net' as rejected from catalogue)
   select id, format, rejected, case when rejected then 'rejected' else {READY_SQL.format(ok='ok', f='format')} end as readiness from f""")
def v12(t):
    return cat.discovery_report(t.catalogue, ["example.net"]).select("id", "format", "rejected", "readiness")


# --------------------------------------------------------------------------- compositions


@query("E22_committee_page_ingest", f"""with mem as (select o_orderkey as page_id, {_display('o_custkey')} as name, 'Chairperson' as role from orders union all select o_orderkey, {_display('(o_custkey + 1)')}, 'Whip' from orders
     union all select o_orderkey, concat('Visitor ', translate(cast(o_orderkey as varchar), '0123456789', 'abcdefghij')), 'Member' from orders),
   dn as (select lower(display_name) as k, min(id) as d from people group by 1), fn as (select lower(full_name) as k, min(id) as f from people group by 1),
   r as (select mem.*, coalesce(fn.f, dn.d) as pid, o_custkey % 10 as committee_id from mem left join dn on dn.k = lower(mem.name) left join fn on fn.k = lower(mem.name) join orders on o_orderkey = page_id)
   select 'memberships' as outcome, count(*) as n from (select distinct pid, committee_id, role from r where pid is not null) union all select 'mentions', count(*) from (select distinct page_id, pid from r where pid is not null)
   union all select 'unresolved', count(*) from (select distinct page_id, lower(name) from r where pid is null)""")
def e22(t):
    from polislake.operators import resolve

    members = cut_lineage(ex.committee_members(t.member_pages).drop("slug"))  # their names are counted before they are looked up
    members = members.join(t.member_pages.select("page_id", "committee_id"), "page_id")
    r = cut_lineage(resolve.resolve(members, t.people, resolve.alias_table(t.people), "name"))
    linked = r.where("person_id is not null")
    parts = {
        "memberships": linked.select("person_id", "committee_id", "role").distinct(), "mentions": linked.select("page_id", "person_id").distinct(),
        "unresolved": r.where("person_id is null").select("page_id", "name").distinct(),
    }
    out = None
    for k, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("outcome"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("E23_document_ingest")
def e23(t):
    """Meeting pages to typed documents and their mentions, counted; covered piecewise by T01…T06 and E10."""
    from polislake.operators import mentions, resolve

    h = F.col("html")
    docs = t.meeting_html.select(
        "page_id", "url", html.title(h).alias("title"), html.visible_text(h).alias("raw_text"), ex.publication_date(h, html.visible_text(h)).alias("publication_date"),
    ).withColumn("document_type", ex.document_type(F.col("url"), F.col("title"), F.col("raw_text")))
    docs = cut_lineage(docs.select("page_id", "raw_text", "document_type"))  # pages are extracted once, their texts are read several times
    found = mentions.detect(docs, "page_id", "raw_text", t.people, resolve.alias_table(t.people), snippets=False).groupBy("page_id").agg(F.count("*").alias("mentions"))
    return docs.join(found, "page_id", "left").groupBy("document_type").agg(F.count("*").alias("documents"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"), F.count_if(F.col("mentions").isNull()).alias("skipped"))


@query("E24_profile_ingest", f"""with p as (select c_custkey as page_id, {_display('c_custkey')} as full_name, concat('https://www.example.org/person/p', c_custkey, '/') as url from customer),
   s as (select trim(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, arg_min(full_name, page_id) as full_name, arg_min(url, page_id) as profile_url from p group by 1)
   select coalesce(s.slug, o.slug) as slug, coalesce(s.full_name, o.full_name) as full_name, coalesce(s.profile_url, o.profile_url) as profile_url, case when o.slug is null then 'created' when s.slug is null then 'unchanged' else 'updated' end as change
   from (select slug, arg_min(full_name, id) as full_name, arg_min(coalesce(profile_url, ''), id) as profile_url from people where id % 2 = 0 group by 1) o full join s on s.slug = o.slug""")
def e24(t):
    from polislake.operators.merge import merge_upsert
    from polislake.operators.tables import first_per_key

    p = ex.profiles(t.profile_pages).select("page_id", "slug", "full_name", F.col("url").alias("profile_url"))
    old = first_per_key(t.people.where("id % 2 = 0"), ["slug"], [F.col("id")]).select("slug", "full_name", F.coalesce("profile_url", F.lit("")).alias("profile_url"))
    return merge_upsert(old, p, ["slug"], {}, order=[F.col("page_id")])


@query("E25_identity_bootstrap_counts")
def e25(t):
    """All bootstrap steps in order with one count each; each step has its own check."""
    from polislake.operators import linking, resolve

    people = cut_lineage(linking.people_hints(t.attendance, t.questions).withColumn("id", F.xxhash64("slug")))  # three steps read them
    committees = linking.committee_hints(t.docs).withColumn("id", F.xxhash64("slug"))
    index = resolve.name_index(people, resolve.alias_table(people))
    mm = t.meetings.withColumn("summary_document_id", F.lit(None).cast("long"))
    return linking.step_counts([
        ("committees", committees), ("politicians", people), ("aliases", resolve.alias_table(people)),
        ("meetings_linked", linking.link_meetings(mm, t.docs.select("id", "source_url", "committee_name"), t.committees)),
        ("attendance_linked", linking.link_attendance(t.attendance, index)),
        ("memberships", linking.memberships_from_attendance(t.attendance, t.meetings, t.memberships)),
        ("questions_linked", linking.link_questions(t.questions, t.question_mentions, index)),
        ("vote_events_linked", linking.link_vote_events(t.vote_events, t.meetings, t.committees)),
    ])


