"""Scalar normalisers over whole tables (P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import dates, keys, names, text, urls
from polislake.plans.registry import query
from polislake.plans.sqltext import case_contains, regex_title


@query("P01_slug", "select id, trim(regexp_replace(lower(name_raw), '[^a-z0-9]+', '-', 'g'), '-') as slug from attendance")
def p01(t):
    return t.attendance.select("id", names.slug(F.col("name_raw")).alias("slug"))


@query("P01_slug_of_texts")
def p01_texts(t):
    """Slug of accented text; DuckDB has no compatibility decomposition, so rows only."""
    return t.docs.select("id", names.slug(F.col("title")).alias("slug"))


@query("P02_person_name", f"select id, {regex_title(r'''trim(regexp_replace(name_raw, '\s+', ' ', 'g'))''')} as name from attendance")
def p02(t):
    return t.attendance.select("id", names.person_name(F.col("name_raw")).alias("name"))


_COMMITTEE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_replace({c}, '\s+', ' ', 'g')),
  '^(committee|portfolio committee|standing committee|select committee|joint committee)\s+on\s+', '', 'i'),
  '^(committee|portfolio committee|standing committee|select committee|joint committee)\s+for\s+', '', 'i'),
  '\s+([,.;:])', '\1', 'g'), '([,.;:])[,.;:]+', '\1', 'g'), ' -,.;:')"""


@query("P03_committee_name", f"select id, {_COMMITTEE.format(c='title')} as committee from meetings")
def p03(t):
    return t.meetings.select("id", names.committee_name(F.col("title")).alias("committee"))


def _party_sql() -> str:
    known = ", ".join(
        f"('{k}', '{n}', '{s}')" for k, (n, s) in vocab.PARTY_ALIASES.items()
    )
    return rf"""
    with raw as (select id, case id % 6 when 0 then concat(party_name, ' (P', cast(id % 9 as varchar), ')') when 1 then 'anc'
             when 2 then 'Democratic Alliance (DA)' when 3 then ' ff+ ' when 4 then '' else party_name end as p from vote_totals),
    clean as (select id, trim(regexp_replace(p, '\s+', ' ', 'g'), ' .,-') as c from raw),
    parts as (select id, c, case when regexp_matches(c, '^.+?\s*\([^)]+\)\s*$') then trim(regexp_extract(c, '^(.+?)\s*\(([^)]+)\)\s*$', 1)) else c end as l,
        case when regexp_matches(c, '^.+?\s*\([^)]+\)\s*$') then trim(regexp_extract(c, '^(.+?)\s*\(([^)]+)\)\s*$', 2)) else c end as s from clean),
    known(k, n, a) as (values {known})
    select id, case when c = '' then 'Unknown' else coalesce(k1.n, k2.n, l) end as name,
      case when c = '' then 'UNKNOWN' else coalesce(k1.a, k2.a,
        case when length(s) <= 20 and upper(s) = s and lower(s) <> s then s
             else substr(upper(trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-')), 1, 20) end) end as short_name
    from parts left join known k1 on k1.k = trim(regexp_replace(lower(s), '[^a-z0-9+]+', ' ', 'g'))
      left join known k2 on k2.k = trim(regexp_replace(lower(l), '[^a-z0-9+]+', ' ', 'g'))"""


@query("P04_party", _party_sql())
def p04(t):
    written = F.expr(
        """case id % 6 when 0 then concat(party_name, ' (P', cast(id % 9 as string), ')') when 1 then 'anc'
             when 2 then 'Democratic Alliance (DA)' when 3 then ' ff+ ' when 4 then '' else party_name end"""
    )
    return t.vote_totals.select("id", names.party(written).alias("p")).select("id", "p.name", "p.short_name")


_ROLE_RAW = "case when id % 3 = 0 then concat('Deputy ', upper(role)) when id % 3 = 1 then 'alternate member' else concat('Observer: ', role) end"


@query("P05_role", f"""
  with r as (select politician_id + committee_id as id, role from memberships), s as (select id, {_ROLE_RAW} as raw from r)
  select raw, count(*) as n, coalesce({case_contains("raw", vocab.ROLE_KEYWORDS)}, trim(replace(raw, ':', ' '))) as role
  from s group by raw""")
def p05(t):
    raw = t.memberships.select((F.col("politician_id") + F.col("committee_id")).alias("id"), "role").select(
        F.expr(_ROLE_RAW).alias("raw")
    )
    return raw.groupBy("raw").agg(F.count("*").alias("n")).withColumn("role", names.role(F.col("raw")))


@query("P06_strip_honorific", r"select id, regexp_replace(trim(name_raw), '^(mr|ms|mrs|miss|dr|adv|prof|hon)\.?\s+', '', 'i') as name from attendance")
def p06(t):
    return t.attendance.select("id", names.strip_honorific(F.col("name_raw")).alias("name"))


ATTENDEE_SQL = r"""
    a1 as (select distinct name_raw, trim(regexp_replace(regexp_replace(trim(regexp_replace(name_raw, '\s+', ' ', 'g'), ' ,.;:-'), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'), ' ,.;:-') as c from @src@),
    a2 as (select name_raw, c, array_to_string(list_filter(list_transform(string_split(trim(case when contains(c, ',') then substr(c, strpos(c, ',') + 1) else c end), ' '),
        lambda p: trim(p, '()[]{}.,;:')), lambda p: p <> '' and lower(p) not in
        ('adv','advocate','dr','hon','honourable','miss','mr','mrs','ms','prof','professor')), ' ') as given from a1),
    a3 as (select name_raw, c, trim(case when contains(c, ',') then trim(concat(given, ' ', trim(split_part(c, ',', 1)))) else given end, ' ,.;:-') as nm from a2),
    attendee as (select name_raw, case when c <> '' and length(nm) >= 3 and regexp_matches(nm, '[A-Za-z]')
        and lower(c) not in ('apology','apologies','chairperson','department','minister','national assembly','none','present','unknown')
        and not regexp_matches(lower(c), '\b(committee|department|parliamentary|secretary|staff|team)\b') then {title} end as person from a3)""".replace(
    "{title}", regex_title("nm")
)


@query("P07_attendee_name", "with " + ATTENDEE_SQL.replace("@src@", "attendance") + " select name_raw, person from attendee")
def p07(t):
    return t.attendance.select("name_raw").distinct().select("name_raw", names.attendee_name(F.col("name_raw")).alias("person"))


@query("P08_display_name", """select id, case when len(string_split(full_name, ' ')) <= 2 then full_name
   else concat(split_part(full_name, ' ', 1), ' ', split_part(full_name, ' ', -1)) end as display from people""")
def p08(t):
    return t.people.select("id", names.display_name(F.col("full_name")).alias("display"))


@query("P09_name_tokens", r"""select id, array_to_string(list_transform(list_filter(regexp_extract_all(
   regexp_replace(regexp_replace(name_raw, '\([^)]+\)', ' ', 'g'), '\b(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\b', ' ', 'gi'), '[A-Za-z][A-Za-z''-]*'),
   lambda w: length(w) > 1), lambda w: lower(w)), '|') as tokens from attendance""")
def p09(t):
    return t.attendance.select("id", F.array_join(names.name_tokens(F.col("name_raw")), "|").alias("tokens"))


ALIAS_SQL = """
  w as (select id, full_name, display_name, string_split(full_name, ' ') as p, split_part(display_name, ' ', -1) as s from people),
  i as (select *, list_transform(p[1:len(p)-1], lambda x: upper(x[1])) as ini from w),
  f as (select id, unnest([full_name, display_name, concat(ini[1], ' ', s), concat(array_to_string(ini, ''), ' ', s),
      concat(array_to_string(ini, '. '), '. ', s), concat('Hon ', s), concat('Mr ', s), concat('Ms ', s), concat('Dr ', s), s]) as alias,
      unnest(['FULL_NAME','DISPLAY_NAME','INITIAL_SURNAME','INITIAL_SURNAME','INITIAL_SURNAME','TITLE_SURNAME','TITLE_SURNAME','TITLE_SURNAME','TITLE_SURNAME','SURNAME_ONLY']) as alias_type,
      unnest(range(10)) as pos from i),
  aliases as (select id as person_id, alias, arg_min(alias_type, pos) as alias_type from f group by id, alias)"""


@query("P10_alias_forms", f"with {ALIAS_SQL} select * from aliases")
def p10(t):
    from polislake.operators.resolve import alias_table

    return alias_table(t.people).select("person_id", "alias", "alias_type")


@query("P11_asker_candidates", r"""
  with c as (select id, nullif(trim(regexp_replace(trim(regexp_replace(asked_by_name, '\s+', ' ', 'g')), '\s*\([^)]{1,80}\)\s*$', '')), '') as raw from questions),
  f as (select id, [raw, trim(regexp_replace(raw, '^(hon|mr|ms|mrs|dr|adv|prof)\.?\s+', '', 'i')),
     case when regexp_matches(raw, '^[^,]+,\s*.+$') then concat(trim(regexp_extract(raw, '^([^,]+),\s*(.+)$', 2)), ' ', trim(regexp_extract(raw, '^([^,]+),\s*(.+)$', 1))) end,
     case when regexp_matches(raw, '^[^,]+,\s*.+$') then trim(regexp_extract(raw, '^([^,]+),\s*(.+)$', 1)) end,
     case when contains(raw, ' ') then split_part(raw, ' ', -1) end] as v from c),
  e as (select id, unnest(v) as candidate, unnest(range(5)) as pos from f),
  d as (select id, candidate, min(pos) as pos from e where coalesce(candidate, '') <> '' group by id, candidate)
  select id, candidate, row_number() over (partition by id order by pos) - 1 as position from d""")
def p11(t):
    return t.questions.select("id", F.posexplode(names.asker_candidates(F.col("asked_by_name"))).alias("position", "candidate"))


@query("P12_canonical_url", r"""
  with u as (select page_id, regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1) as h, regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') as p,
     regexp_extract(url, '[?&]((?:page|Page|PAGE)=[^&#]*)', 1) as q from links)
  select page_id, concat('https://', lower(h), p, case when p like '%/' then '' else '/' end, case when q <> '' then concat('?', q) else '' end) as url from u""")
def p12(t):
    return t.links.select("page_id", urls.canonical(F.col("url")).alias("url"))


STABLE_URL_SQL = r"""concat(lower(regexp_extract(trim({u}), '^([A-Za-z]+)://', 1)), '://', lower(regexp_extract(trim({u}), '^[A-Za-z]+://([^/?#]*)', 1)),
   regexp_replace(regexp_extract(trim({u}), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), regexp_extract(trim({u}), '(\?[^#]+)', 1))"""


@query("P13_stable_url", f"select page_id, {STABLE_URL_SQL.format(u='url')} as url from links")
def p13(t):
    return t.links.select("page_id", urls.stable(F.col("url")).alias("url"))


@query("P14_host", r"""select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host,
   lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) = 'example.org' or lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) like '%.example.org' as official from links""")
def p14(t):
    u = F.col("url")
    return t.links.select("page_id", urls.host(u).alias("host"), urls.on_domain(u, "example.org").alias("official"))


@query("P15_detail_api_url", r"""select id, case when regexp_extract(source_url, 'records\.example\.org/bill/(\d+)', 1) <> ''
   then concat('https://api.example.org/bill/', regexp_extract(source_url, 'records\.example\.org/bill/(\d+)', 1), '/') end as api_url from bills""")
def p15(t):
    return t.bills.select("id", urls.detail_api_url(F.col("source_url"), "records.example.org", "bill", "https://api.example.org").alias("api_url"))


_WRITTEN = """case {k} % 7 when 0 then {iso} when 1 then concat(cast(day({d}) as string), ' ', {month}, ' ', cast(year({d}) as string))
   when 2 then concat(cast(day({d}) as string), 'th ', {month}, ' ', cast(year({d}) as string))
   when 3 then concat({month}, ' ', cast(day({d}) as string), ', ', cast(year({d}) as string))
   when 4 then concat('tabled on ', cast(day({d}) as string), ' ', {month}, ' ', cast(year({d}) as string), ' in the house')
   when 5 then concat(cast(year({d}) as string), '-13-45') else 'date unknown' end"""
_MONTHS = "split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', cast(month({d}) as int))"


def _written(k: str, d: str) -> str:
    return _WRITTEN.format(k=k, d=d, iso=f"cast({d} as string)", month=_MONTHS.format(d=d))


@query("P16_parse_date", "select id, case when id % 7 <= 4 then event_date end as parsed from bill_events")
def p16(t):
    written = t.bill_events.select("id", F.expr(_written("id", "event_date")).alias("w"))
    return written.select("id", dates.parse(F.col("w")).alias("parsed"))


@query("P17_sane_date", """select id, case when id % 7 = 0 and year(event_date) between 1996 and 2000 then event_date end as in_window,
   case when year(event_date) between 1996 and 2000 then event_date end as from_name from bill_events""")
def p17(t):
    w = t.bill_events.select("id", F.expr(_written("id", "event_date")).alias("w"), F.concat(F.lit("RNW12-"), F.col("event_date").cast("string"), F.lit("-final")).alias("stem"))
    return w.select("id", dates.sane(F.col("w"), 2000, 1996).alias("in_window"), dates.sane(F.regexp_extract("stem", r"(\d{4}-\d{2}-\d{2})", 1), 2000, 1996).alias("from_name"))


@query("P18_iso_prefix", "select id, cast(started_at as date) as day from runs")
def p18(t):
    return t.runs.select("id", dates.iso_prefix(F.col("started_at").cast("string")).alias("day"))


@query("P19_numbers_in_text", r"""select id, try_cast(nullif(regexp_extract(t, '\b((?:19|20)\d{2})\b', 1), '') as int) as year,
   nullif(regexp_extract(t, '\b(B\s*\d+[A-Z]?)\b', 1, 'i'), '') as bill_number, try_cast(replace(trim(v), ',', '') as int) as votes
   from (select id, concat(title, ' b', cast(id % 50 as varchar), ' of ', cast(1890 + id % 160 as varchar)) as t, concat(' ', cast(id as varchar), case when id % 5 = 0 then 'x' else ',000' end) as v from bills)""")
def p19(t):
    b = t.bills.select("id", F.expr("concat(title, ' b', cast(id % 50 as string), ' of ', cast(1890 + id % 160 as string))").alias("t"),
                       F.expr("concat(' ', cast(id as string), case when id % 5 = 0 then 'x' else ',000' end)").alias("v"))
    return b.select("id", dates.year_in(F.col("t")).alias("year"), dates.bill_number(F.col("t")).alias("bill_number"), dates.int_with_commas(F.col("v")).alias("votes"))


@query("P20_keyword_case", f"""select id, {case_contains("summary", vocab.BILL_STATUS_KEYWORDS, "unknown")} as status,
   {case_contains("summary", vocab.BILL_EVENT_KEYWORDS, "unknown")} as event, {case_contains("title", vocab.VOTE_TYPE_KEYWORDS, "unknown")} as vote_type,
   {case_contains("summary", vocab.VOTE_RESULT_KEYWORDS)} as result, {case_contains("summary", vocab.ATTENDANCE_KEYWORDS, "unknown")} as attendance,
   {case_contains("title", vocab.HOUSE_KEYWORDS)} as house from meetings""")
def p20(t):
    s, title = F.col("summary"), F.col("title")
    return t.meetings.select(
        "id",
        text.keyword_case(s, vocab.BILL_STATUS_KEYWORDS, "unknown").alias("status"),
        text.keyword_case(s, vocab.BILL_EVENT_KEYWORDS, "unknown").alias("event"),
        text.keyword_case(title, vocab.VOTE_TYPE_KEYWORDS, "unknown").alias("vote_type"),
        text.keyword_case(s, vocab.VOTE_RESULT_KEYWORDS).alias("result"),
        text.keyword_case(s, vocab.ATTENDANCE_KEYWORDS, "unknown").alias("attendance"),
        text.keyword_case(title, vocab.HOUSE_KEYWORDS).alias("house"),
    )


@query("P21_code_map", """select id, coalesce({'P': 'present', 'A': 'absent', 'AP': 'apology', 'L': 'present', 'DE': 'present', 'LDE': 'present'}[
     case id % 8 when 0 then 'P' when 1 then 'A' when 2 then 'AP' when 3 then 'L' when 4 then 'DE' when 5 then 'LDE' when 6 then 'ZZ' else '' end], 'unknown') as status,
   case vote_value when 'yes' then 'yes' when 'no' then 'no' when 'abstain' then 'abstain' else 'unknown' end as vote from vote_records""".replace("coalesce({", "coalesce(MAP {"))
def p21(t):
    code = F.expr("case id % 8 when 0 then ' p' when 1 then 'A' when 2 then 'ap ' when 3 then 'L' when 4 then 'DE' when 5 then 'lde' when 6 then 'ZZ' else null end")
    return t.vote_records.select(
        "id", text.code_map(code, vocab.ATTENDANCE_CODES, "unknown").alias("status"),
        text.code_map(F.upper("vote_value"), vocab.VOTE_VALUES, "unknown", upper=False).alias("vote"),
    )


@query("P22_clean_and_limit", r"""select row_number as id, nullif(trim(contest_id), '') as contest, nullif(trim(candidate_id), '') as candidate,
   substr(trim(regexp_replace(party_name, '\s+', ' ', 'g')), 1, 7) as party from vote_csv""")
def p22(t):
    return t.vote_csv.select(
        F.col("row_number").alias("id"), text.blank_to_null(F.col("contest_id")).alias("contest"),
        text.blank_to_null(F.col("candidate_id")).alias("candidate"), text.limit_string(F.col("party_name"), 7).alias("party"),
    )


_HIT_SQL = r"""select id, s - 1 as start, concat(case when s - 1 - 250 > 0 then '...' else '' end,
   trim(regexp_replace(substr(raw_text, greatest(s - 250, 1), least(s - 1 + 3 + 250, length(raw_text)) - greatest(s - 1 - 250, 0)), '\s+', ' ', 'g')),
   case when s - 1 + 3 + 250 < length(raw_text) then '...' else '' end) as snippet
   from (select id, raw_text, strpos(raw_text, ' the ') + 1 as s from docs where contains(raw_text, ' the '))"""


@query("P23_snippet", _HIT_SQL)
def p23(t):
    start = F.locate(" the ", F.col("raw_text"))
    hits = t.docs.select("id", "raw_text", start.alias("start")).where(F.col("start") > 0)
    return hits.select("id", "start", text.snippet(F.col("raw_text"), F.col("start"), F.lit(3)).alias("snippet"))


EXCERPT_SQL = r"""case when length(trim(regexp_replace({c}, '\s+', ' ', 'g'))) > {n} then
   concat(rtrim(substr(trim(regexp_replace({c}, '\s+', ' ', 'g')), 1, {n})), '...') else nullif(trim(regexp_replace({c}, '\s+', ' ', 'g')), '') end"""


@query("P24_excerpt", f"select id, {EXCERPT_SQL.format(c='raw_text', n=260)} as excerpt from docs")
def p24(t):
    return t.docs.select("id", text.excerpt(F.col("raw_text")).alias("excerpt"))


@query("P25_clean_display", r"""select id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
   concat(trim(regexp_replace(title, '\s+', ' ', 'g')), ' – “x”… it’s [source] a—b'), '’', ''''), '‘', ''''), '–', '-'), '—', '-'), '…', '...'), '[source]', ''), '‑', '-'), '\s+', ' ', 'g')) as shown from docs""")
def p25(t):
    return t.docs.select("id", text.clean_display(F.concat(F.col("title"), F.lit(" – “x”… it’s [source] a—b"))).alias("shown"))


REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace({c},
   '\b(database_url|password|passwd|secret|token|api_key|authorization)\b(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'gi'),
   '\b([a-z][a-z0-9+.-]*://)([^/\s:@]+):([^@\s/]+)@', '\1[REDACTED]:[REDACTED]@', 'gi'),
   '\b(?:gh[pousr]_[A-Za-z0-9_]{{20,}}|github_pat_[A-Za-z0-9_]{{20,}})\b', '[REDACTED]', 'g')"""


@query("P26_redact", f"select doc_id, {REDACT_SQL.format(c='text')} as shown from documents")
def p26(t):
    return t.documents.select("doc_id", text.redact(F.col("text")).alias("shown"))


RESULT_KEY_SQL = """concat('iec-vote:', sha256(concat('{{"candidate_id":', coalesce('"' || {cand} || '"', 'null'), ',"contest_id":"', {contest}, '","geography_id":', coalesce('"' || {geo} || '"', 'null'),
   ',"manifest_key":"', {manifest}, '","party_id":"', {party}, '"}}')))"""


@query("P27_result_key", f"""select id, {RESULT_KEY_SQL.format(cand="nullif(candidate_id, '')", contest="contest_id", geo="geography_id", manifest="manifest_key", party="party_id")} as result_key
   from vote_totals where party_id is not null""")
def p27(t):
    v = t.vote_totals.where(F.col("party_id").isNotNull())
    return v.select("id", keys.result_key(F.col("manifest_key"), F.col("contest_id"), F.col("geography_id"), F.col("party_id"), text.blank_to_null(F.col("candidate_id"))).alias("result_key"))


@query("P28_universe_key", """select id, sha256(concat('["people register","', coalesce(lower(profile_url), ''), '","', lower(coalesce(party, '')), '","","', lower(full_name), '"]')) as universe_key from people""")
def p28(t):
    return t.people.select("id", keys.universe_key([F.lit("People  Register"), F.col("profile_url"), F.col("party"), F.lit(None), F.upper("full_name")]).alias("universe_key"))


@query("P29_fingerprint", """select id, list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(slug, ''), lambda ch: cast(ascii(ch) as bigint))),
   lambda acc, x: (acc * 31 + x) % 1000000007) as fingerprint from people""")
def p29(t):
    return t.people.select("id", text.fingerprint(F.col("slug")).alias("fingerprint"))


FORMAT_SQL = """case when lower(split_part({u}, '?', 1)) like '%.csv' then 'csv' when lower(split_part({u}, '?', 1)) like '%.json' then 'json'
   when lower(split_part({u}, '?', 1)) like '%.pdf' then 'pdf' when lower(split_part({u}, '?', 1)) like '%.xlsx' then 'xlsx' when lower(split_part({u}, '?', 1)) like '%.xls' then 'xlsx'
   when lower(split_part({u}, '?', 1)) like '%.html' then 'html' when lower(split_part({u}, '?', 1)) like '%.htm' then 'html'
   when {ct} like '%csv%' then 'csv' when {ct} like '%json%' then 'json' when {ct} like '%pdf%' then 'pdf' when {ct} like '%spreadsheet%' then 'xlsx'
   when {ct} like '%excel%' then 'xlsx' when {ct} like '%html%' then 'html' else 'unknown' end"""
READY_SQL = """case when not coalesce({ok}, false) then 'unreachable' when {f} in ('csv', 'json', 'xlsx') then 'structured-candidate'
   when {f} in ('html', 'pdf') then 'needs-parser-design' else 'unknown' end"""


@query("P30_format_and_readiness", f"""with f as (select id, ok, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format from catalogue)
   select id, format, {READY_SQL.format(ok='ok', f='format')} as readiness from f""")
def p30(t):
    fmt = urls.file_format(F.col("source_url"), F.col("content_type"))
    return t.catalogue.select("id", "ok", fmt.alias("format")).select("id", "format", urls.readiness(F.col("format"), F.col("ok")).alias("readiness"))


HEADERS = "case when {k} % 4 = 0 then 'Contest_ID|Party_ID|Votes' when {k} % 4 = 1 then ' contest code |Candidate ID|Valid_Votes|Extra' when {k} % 4 = 2 then 'Name|Total' else '' end"


@query("P31_header_audit", f"""
  with h as (select id, {FORMAT_SQL.format(u='source_url', ct='content_type')} as format,
     list_distinct(list_transform(list_filter(string_split({HEADERS.format(k='id')}, '|'), lambda c: c <> ''), lambda c: trim(regexp_replace(replace(lower(trim(c)), '_', ' '), '\\s+', ' ', 'g')))) as cols from catalogue),
  s as (select *, list_has_any(cols, ['votes','vote total','valid votes','total votes']) as votes_ok,
     list_has_any(cols, ['contest id','contest code']) and list_has_any(cols, ['party id','party code','candidate id']) as ids_ok, format in ('csv','json','xlsx') as structured from h)
  select id, array_to_string(list_sort(list_filter(cols, lambda c: c in ('votes','vote total','valid votes','total votes'))), '|') as vote_columns, ids_ok as identifiers_ok,
     case when structured and votes_ok and ids_ok then case format when 'csv' then 1 when 'json' then 2 else 3 end end as priority,
     (case when not structured then 1 else 0 end) + (case when structured and len(cols) = 0 then 1 else 0 end) + (case when structured and not votes_ok then 1 else 0 end)
       + (case when structured and not ids_ok then 1 else 0 end) as n_risks from s""")
def p31(t):
    from polislake.operators.catalog import audit_headers

    headers = F.split(F.expr(HEADERS.format(k="id")), r"\|")
    audited = audit_headers(t.catalogue.select("id", urls.file_format(F.col("source_url"), F.col("content_type")).alias("format"), headers.alias("columns")))
    return audited.select("id", F.array_join("vote_columns", "|").alias("vote_columns"), "identifiers_ok", "priority", F.size("risks").alias("n_risks"))


@query("P32_metadata_overlay", """
  with p as (select id, source_url, case when id % 3 = 0 then concat('Parliamentary question: ', source_url) else title end as title, case when id % 2 = 0 then null else question_number end as number,
      case when id % 5 = 0 then null else asked_date end as asked_date, status from questions),
  m as (select source_url, concat('Reply ', question_number) as m_title, question_number as m_number, case when id % 4 = 0 then null else asked_date end as m_date, 'ANSWERED' as m_status from questions where id % 3 <> 1)
  select p.id, case when m_title is not null and p.title = concat('Parliamentary question: ', p.source_url) then m_title else p.title end as title,
    coalesce(p.number, m_number) as question_number, coalesce(p.asked_date, m_date) as asked_date,
    case when m_status is not null and p.status = 'UNANSWERED' then m_status else p.status end as status,
    concat_ws(', ', case when m_title is not null and p.title = concat('Parliamentary question: ', p.source_url) then 'title' end, case when p.number is null and m_number is not null then 'question_number' end,
       case when p.asked_date is null and m_date is not null then 'asked_date' end, case when m_status is not null and p.status = 'UNANSWERED' then 'status' end) as applied
  from p left join m using (source_url)""")
def p32(t):
    from polislake.operators.extract import overlay_metadata

    q = t.questions
    parsed = q.select(
        "id", "source_url", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Parliamentary question: "), "source_url")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("id") % 2 != 0, F.col("question_number")).alias("question_number"), F.when(F.col("id") % 5 != 0, F.col("asked_date")).alias("asked_date"), "status",
    )
    meta = q.where(F.col("id") % 3 != 1).select(
        "source_url", F.concat(F.lit("Reply "), "question_number").alias("title"), "question_number", F.when(F.col("id") % 4 != 0, F.col("asked_date")).alias("asked_date"),
        F.lit("ANSWERED").alias("status"),
    )
    return overlay_metadata(parsed, meta).select("id", "title", "question_number", "asked_date", "status", F.array_join("applied", ", ").alias("applied"))


@query("P33_file_metadata", r"""
  with r as (select id, case id % 4 when 0 then 'EXE_RQ_NA' when 1 then 'EXE_R_NCOP' when 2 then 'QUEST_PAP' else 'OTHER' end as type,
      concat(case when id % 3 = 0 then 'rnw' when id % 3 = 1 then 'NO' else 'file-' end, cast(id % 5000 as varchar), '-', cast(asked_date as varchar), '.docx') as name,
      case when id % 2 = 0 then cast(asked_date as varchar) else '5127-10-10' end as date from questions),
  s as (select id, type, name, regexp_replace(name, '\.[A-Za-z0-9]{1,5}$', '') as stem, date from r),
  n as (select *, nullif(regexp_extract(upper(stem), '^R?([A-Z]{1,4}\d{1,6})\b', 1), '') as number,
      coalesce(case when year(try_cast(date as date)) between 1994 and 2027 then try_cast(date as date) end, try_cast(regexp_extract(stem, '(\d{4}-\d{2}-\d{2})', 1) as date)) as d,
      case type when 'EXE_RQ_NA' then 'Written question reply' when 'EXE_R_NCOP' then 'Written question reply' when 'QUEST_PAP' then 'Question paper' else 'Parliamentary question document' end as label,
      case type when 'EXE_RQ_NA' then '(National Assembly)' when 'EXE_R_NCOP' then '(NCOP)' end as house from s)
  select id, concat_ws(' ', label, number, house, concat('— ', cast(d as varchar))) as title, number as question_number,
    case when type in ('EXE_RQ_NA', 'EXE_R_NCOP') then d end as answered_date, case when type not in ('EXE_RQ_NA', 'EXE_R_NCOP') then d end as asked_date,
    case when type in ('EXE_RQ_NA', 'EXE_R_NCOP') then 'ANSWERED' end as status from n""")
def p33(t):
    from polislake.operators.extract import file_metadata

    rec = t.questions.select(
        "id", F.expr("case id % 4 when 0 then 'EXE_RQ_NA' when 1 then 'EXE_R_NCOP' when 2 then 'QUEST_PAP' else 'OTHER' end").alias("type"),
        F.expr("concat(case when id % 3 = 0 then 'rnw' when id % 3 = 1 then 'NO' else 'file-' end, cast(id % 5000 as string), '-', cast(asked_date as string), '.docx')").alias("name"),
        F.expr("case when id % 2 = 0 then cast(asked_date as string) else '5127-10-10' end").alias("date"),
    )
    return file_metadata(rec, max_year=2027).select("id", "title", "question_number", "answered_date", "asked_date", "status")


@query("P34_title_from_file", r"""
  with u as (select id, concat('https://records.example.org/docs/', replace(case when id % 2 = 0 then name else upper(name) end, ' ', '%20'), case when id % 3 = 0 then '.pdf' when id % 3 = 1 then '.PDF?x=1' else '' end) as u,
     case when id % 3 < 2 then true else false end as pdf, name from (select id, replace(slug, 'a', '_') as name from committees))
  select id, trim(replace(replace(case when id % 2 = 0 then name else upper(name) end, '-', ' '), '_', ' ')) as title, pdf as is_pdf, id % 2 = 0 as from_url from u""")
def p34(t):
    name = F.replace("slug", F.lit("a"), F.lit("_"))
    shown = F.when(F.col("id") % 2 == 0, name).otherwise(F.upper(name))
    u = F.concat(F.lit("https://records.example.org/docs/"), shown, F.expr("case when id % 3 = 0 then '.pdf' when id % 3 = 1 then '.PDF?x=1' else '' end"))
    return t.committees.select(
        "id", urls.title_from_file(u).alias("title"), urls.is_pdf(u).alias("is_pdf"),
        urls.title_is_from_url(F.translate(name, "-_", "  "), u).alias("from_url"),
    )


@query("P35_media_url", r"""select id, case id % 4 when 0 then concat('http://files.example.org/', slug) when 1 then concat('https://www.parliament.gov.za/storage/', slug, '.pdf')
    when 2 then concat('https://www.parliament.gov.za/storage/app/media/Docs/', slug, '.pdf') end as url from committees""")
def p35(t):
    loc = F.expr(r"case id % 4 when 0 then concat('http:\\/\\/files.example.org\\/', slug, '?v=1') when 1 then concat('/storage/', slug, '.pdf') when 2 then concat(slug, '.pdf#x') else ' ' end")
    return t.committees.select("id", urls.media_url(loc).alias("url"))


@query("P36_question_text", rf"""
  with q as (select id, concat('NATIONAL ASSEMBLY (NA) QUESTION FOR WRITTEN REPLY ', cast(id % 90 as varchar), '. ', trim(asked_by_name), ' to ask the ', minister, ' ', question_text) as t, trim(asked_by_name) as asker, concat('Answer: ', answer_text) as a from questions)
  select id, {EXCERPT_SQL.format(c="concat('asked the ', minister, ' ', question_text)", n=260)} as question, {EXCERPT_SQL.format(c="answer_text", n=260)} as answer from q join questions using (id)""")
def p36(t):
    from polislake.operators.extract import clean_question_text

    t1 = F.expr("concat('NATIONAL ASSEMBLY (NA) QUESTION FOR WRITTEN REPLY ', cast(id % 90 as string), '. ', trim(asked_by_name), ' to ask the ', minister, ' ', question_text)")
    return t.questions.select(
        "id", clean_question_text(t1, F.trim("asked_by_name")).alias("question"),
        clean_question_text(F.concat(F.lit("Answer: "), "answer_text"), F.lit(None).cast("string")).alias("answer"),
    )


@query("P37_label_free_name", r"""select id, trim(trim(regexp_replace(regexp_replace(name_raw, '\s*\(\s*da\s*\)\s*', ' ', 'gi'), '\s+', ' ', 'g')), ' ,.;') as name,
   trim(regexp_replace(trim(regexp_replace(name_raw, '\s+', ' ', 'g')), '\s*\([^)]{1,80}\)\s*$', '')) as person, lower(trim(name_raw)) in ('', 'unknown', 'unk', 'n/a', 'none') as unknown from attendance""")
def p37(t):
    n = F.col("name_raw")
    return t.attendance.select("id", names.without_party_label(n, F.lit("DA")).alias("name"), names.clean_person_value(n).alias("person"), names.is_unknown_label(n).alias("unknown"))


@query("P38_years_in_range", "select id, unnest(generate_series(1995 + id % 3, 1995 + id % 3 + id % 4)) as year from committees")
def p38(t):
    start, end = F.make_date(1995 + F.col("id") % 3, F.lit(1), F.lit(1)), F.make_date(1995 + F.col("id") % 3 + F.col("id") % 4, F.lit(12), F.lit(31))
    return t.committees.select("id", F.explode(dates.years_between(start, end)).alias("year"))
