"""Civic-record inputs derived from the supplied tables.

The supplied star schema holds no civic data, so each civic table is a
projection of one of them. The projections are plain SQL that Spark and
DuckDB read alike; they rename, map codes and derive missing values, and
never filter by id, cap rows or shorten texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_FIRST = "Anna,Ben,Chloe,Dumisani,Elena,Farouk,Grace,Hendrik,Imani,Julius,Kagiso,Lerato,Mandla,Naledi,Olga,Pieter,Quentin,Refilwe,Sipho,Thandi"
_MIDDLE = "Abel,Beth,Carol,David,Esther,Frank,Gert,Hannah,Ivan,Jane,Karl"
_LAST = (
    "Adams,Botha,Cele,Dlamini,Eksteen,Fourie,Gumede,Hlophe,Ismail,Jacobs,Khumalo,Louw,Mokoena,Ndlovu,Oliphant,"
    "Pillay,Radebe,Sithole,Tshabalala,Venter,Williams,Xaba,Yengeni,Zulu,Nkosi,Mthembu,Naidoo,Buthelezi,Govender"
)
_TOPIC = (
    "Finance,Health,Energy,Transport,Defence,Labour,Tourism,Police,Justice,Water,Mining,Housing,Trade,Sports,Arts,"
    "Culture,Science,Forestry,Fisheries,Youth"
)
_FIELD = "Development,Planning,Reform,Safety,Services,Oversight,Affairs,Enterprise,Training,Heritage,Standards"


def _pick(words: str, expr: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', cast(({expr}) % {n} as int) + 1)"


def _letters(expr: str) -> str:
    return f"translate(cast({expr} as string), '0123456789', 'abcdefghij')"


def _surname(k: str) -> str:
    return f"concat({_pick(_LAST, k)}, case when {k} % 4 = 0 then '' else {_letters(k)} end)"


def _person(k: str) -> str:
    middle = f"case when {k} % 3 = 0 then concat({_pick(_MIDDLE, k)}, ' ') else '' end"
    return f"concat({_pick(_FIRST, k)}, ' ', {middle}, {_surname(k)})"


def _display(k: str) -> str:
    return f"concat({_pick(_FIRST, k)}, ' ', {_surname(k)})"


def _committee(k: str) -> str:
    return (
        f"concat({_pick(_TOPIC, k)}, ' and ', {_pick(_FIELD, k)}, "
        f"case when {k} >= 220 then concat(' ', {_letters(k)}) else '' end)"
    )


def _spelled(person: str, key: str) -> str:
    """The ways a source may write one person's name."""
    return f"""case {key} % 11
      when 0 then {_person(person)}
      when 1 then upper({_person(person)})
      when 2 then concat('Mr ', {_surname(person)})
      when 3 then concat(substr({_pick(_FIRST, person)}, 1, 1), ' ', {_surname(person)})
      when 4 then {_surname(person)}
      when 5 then concat({_surname(person)}, ', Ms ', {_pick(_FIRST, person)})
      when 6 then concat('  ', {_display(person)}, '  ')
      when 7 then concat('Hon ', {_display(person)}, ' (DA)')
      when 8 then lower(replace({_display(person)}, ' ', '-'))
      when 9 then 'Portfolio Committee Staff'
      else concat('Visitor ', {_letters(key)}) end"""


VIEWS: dict[str, str] = {
    # People, parties, committees -------------------------------------------------
    "people": f"""select c_custkey as id, {_person('c_custkey')} as full_name, {_display('c_custkey')} as display_name,
        lower(replace({_person('c_custkey')}, ' ', '-')) as slug,
        case when c_custkey % 11 = 0 then null else c_mktsegment end as party,
        case when c_custkey % 13 = 0 then null
             else concat('https://records.example.org/person/', cast(c_custkey as string), '/') end as profile_url,
        c_custkey % 7 <> 0 as is_active,
        case c_custkey % 5 when 0 then 'FORMER' when 1 then 'UNKNOWN' when 2 then null else 'CURRENT' end as source_status,
        c_nationkey as nation, c_acctbal as balance
      from {{customer}}""",
    "parties": """select c_mktsegment as short_name,
        concat(c_mktsegment, ' Alliance') as name, min(c_custkey) as id,
        concat('https://records.example.org/party/', lower(c_mktsegment)) as source_url, count(*) as n_people
      from {customer} group by c_mktsegment""",
    "committees": f"""select s_suppkey as id, {_committee('s_suppkey')} as name,
        lower(replace({_committee('s_suppkey')}, ' ', '-')) as slug,
        case when s_suppkey % 6 = 0 then null else concat('Oversight of ', lower({_committee('s_suppkey')})) end as description,
        concat('https://records.example.org/committee/', cast(s_suppkey as string), '/') as source_url
      from {{supplier}}""",
    "memberships": f"""select l_suppkey as politician_id, l_partkey % 13 as committee_id,
        case when l_linenumber = 1 then 'Chairperson' when l_linenumber = 2 then 'Whip' else 'Member' end as role,
        concat('https://records.example.org/committee/', cast(l_partkey % 13 as string), '/') as source_url,
        min(cast(l_shipdate as date)) as start_date
      from {{lineitem}} group by l_suppkey, l_partkey % 13, case when l_linenumber = 1 then 'Chairperson'
        when l_linenumber = 2 then 'Whip' else 'Member' end""",
    # Meetings and attendance -------------------------------------------------------
    "meetings": f"""select o_orderkey as id,
        case when o_orderkey % 4 = 0 then null else o_custkey % 10 end as committee_id,
        case when o_orderkey % 6 = 0 then null
             else concat('Portfolio Committee on ', {_committee('(o_custkey % 10)')}) end as committee_name,
        case o_orderkey % 5
          when 0 then concat('Portfolio Committee on ', {_committee('(o_custkey % 10)')}, ': Budget Vote ', cast(o_orderkey % 40 as string))
          when 1 then concat('Briefing by department on ', lower({_committee('(o_custkey % 10)')}), ' matters')
          when 2 then concat('Joint sitting: public hearing ', cast(o_orderkey as string))
          when 3 then concat({_pick(_TOPIC, 'o_custkey')}, ' quarterly report')
          else concat('Meeting ', cast(o_orderkey as string)) end as title,
        case when o_orderkey % 17 = 0 then null else cast(o_orderdate as date) end as date,
        concat('https://records.example.org/committee-meeting/', cast(o_orderkey as string), '/') as source_url,
        case when o_orderkey % 3 = 0 then null else concat(
            'The committee met on ', lower({_pick(_TOPIC, 'o_custkey')}), '. ',
            {_display('(o_custkey)')}, case o_orderkey % 4 when 0 then ' asked about the budget. '
               when 1 then ' sent an apology. ' when 2 then ' was thanked. ' else ' is listed. ' end,
            case o_orderkey % 7 when 0 then 'Following a division, the Bill was agreed to. 8 votes in favour and 3 votes against.'
               when 1 then 'The agenda was adopted.' when 2 then 'The matter was put to the vote.'
               when 3 then 'After a division the motion was negatived with 2 abstentions.' else 'The meeting adjourned.' end) end as summary,
        o_custkey as asker_id, o_totalprice as weight
      from {{orders}}""",
    "attendance": f"""select l_orderkey * 100 + l_linenumber as id, l_orderkey as meeting_id,
        case when l_partkey % 10 = 0 then null else l_suppkey end as politician_id,
        {_spelled('l_suppkey', 'l_partkey')} as name_raw,
        case when l_returnflag = 'A' then 'absent' when l_returnflag = 'R' then 'apology'
             when l_linestatus = 'F' then 'present' else 'excused' end as attendance_status,
        case when l_linenumber % 3 = 0 then null else l_partkey % 5 end as party_id,
        case when l_linenumber = 2 then null
             else concat('https://records.example.org/attendance/', cast(l_orderkey as string)) end as source_url,
        cast(case when l_linenumber % 2 = 0 then 0.9 else 0.5 end as double) as confidence
      from {{lineitem}}""",
    # Bills and votes -----------------------------------------------------------------
    "bills": """select p_partkey as id, concat(p_name, ' Bill') as title, concat('B', cast(p_size as string)) as bill_number,
        case when p_size % 9 = 0 then null else 1990 + p_size % 35 end as year,
        case p_brand when 'Brand#1' then 'National Assembly' when 'Brand#2' then 'NCOP' else null end as house,
        case p_type when 'STANDARD' then 'introduced' when 'SMALL' then 'passed' when 'MEDIUM' then 'assented'
             when 'LARGE' then 'rejected' when 'ECONOMY' then 'lapsed' else 'unknown' end as status,
        case when p_partkey % 10 = 0 then null
             else concat('https://records.example.org/bill/', cast(p_partkey as string), '/') end as source_url,
        p_retailprice as price
      from {part}""",
    "bill_events": """select l_orderkey * 100 + l_linenumber as id, l_partkey as bill_id,
        case concat(l_returnflag, l_linestatus) when 'AF' then 'introduced' when 'AO' then 'first_reading'
             when 'NF' then 'second_reading' when 'NO' then 'committee_referral' when 'RF' then 'passed' else 'assented' end as event_type,
        cast(l_shipdate as date) as event_date,
        concat('https://records.example.org/bill/', cast(l_partkey as string), '/') as source_url
      from {lineitem}""",
    "vote_events": f"""select o_orderkey as id,
        concat('Committee decision: ', {_committee('(o_custkey % 10)')}) as title,
        case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as date,
        case o_orderstatus when 'F' then 'National Assembly' when 'O' then 'NCOP' else null end as chamber,
        case o_orderpriority when '1-URGENT' then 'bill_vote' when '2-HIGH' then 'motion'
             when '3-MEDIUM' then 'amendment' else 'committee_decision' end as vote_type,
        case o_orderkey % 4 when 0 then 'agreed_to' when 1 then 'negatived' when 2 then 'adopted' else null end as result,
        o_orderkey % 200 as bill_id,
        cast(null as bigint) as committee_id,
        concat('https://records.example.org/committee-meeting/', cast(o_orderkey as string), '/') as source_url
      from {{orders}}""",
    "vote_records": """select l_orderkey * 100 + l_linenumber as id, l_orderkey as vote_event_id,
        case when l_linenumber % 3 = 0 then l_suppkey else null end as politician_id,
        case when l_linenumber % 3 = 1 then l_suppkey % 5 else null end as party_id,
        case l_returnflag when 'A' then 'yes' when 'R' then 'no' else 'abstain' end as vote_value,
        case l_linenumber % 3 when 0 then 'individual' when 1 then 'party' else 'aggregate' end as record_level,
        cast(l_quantity as int) as n_votes
      from {lineitem}""",
    # Documents, questions --------------------------------------------------------------
    "docs": """select doc_id as id, split_part(text, chr(10), 1) as title,
        case cast(replace(source, 'src', '') as int) % 5 when 0 then 'PMG_REPORT' when 1 then 'PMG_BRIEFING'
             when 2 then 'PMG_COMMITTEE_MEETING' when 3 then 'MP_PROFILE' else 'COMMITTEE_PAGE' end as document_type,
        source, lang, concat('https://records.example.org/document/', cast(doc_id as string), '/') as source_url,
        case when doc_id % 6 = 0 then null else concat('archive/', cast(doc_id as string), '.html') end as archive_path,
        case when doc_id % 9 = 0 then null else text end as raw_text, n_chars,
        case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then concat('Standing Committee on ', source)
             else concat('Portfolio Committee on ', source) end as committee_name
      from {documents}""",
    "mentions": """select o_orderkey as id, o_custkey % 211 as document_id, o_custkey as politician_id,
        cast(case when o_orderkey % 3 = 0 then 0.72 when o_orderkey % 3 = 1 then 0.9 else 0.99 end as double) as confidence_score,
        cast(o_orderdate as date) as created_on
      from {orders}""",
    "qa": """select u.conv_id, u.turn, u.text as question_text, a.text as answer_text
      from {conversations} u left join {conversations} a
        on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
      where u.role = 'user'""",
    "questions": f"""select conv_id * 1000 + turn as id, concat('NW', cast(conv_id * 1000 + turn as string), 'E') as question_number,
        concat('Written question ', cast(conv_id as string)) as title,
        case when conv_id % 3 = 0 then null else conv_id % 150 end as politician_id,
        {_spelled('(conv_id % 150)', 'conv_id')} as asked_by_name,
        {_pick('Finance,Health,Water,Energy', 'conv_id')} as department,
        concat('Minister of ', {_pick('Finance,Health,Water,Energy', 'conv_id')}) as minister,
        question_text, answer_text,
        date_add(cast('2020-01-01' as date), cast(conv_id % 900 as int)) as asked_date,
        case when answer_text is null then 'UNANSWERED' else 'ANSWERED' end as status,
        case conv_id % 5 when 0 then 'PARTIAL' when 1 then 'FAILED' else 'PARSED' end as parse_status,
        case when conv_id % 2 = 0 then 'PDF' else 'HTML' end as source_file_type,
        case when conv_id % 7 = 0 then null else concat('archive/q', cast(conv_id as string)) end as archive_path,
        concat('https://records.example.org/question/', cast(conv_id as string), '/', cast(turn as string)) as source_url
      from {{qa}}""",
    "question_mentions": """select o_orderkey as id, o_orderkey % 400 * 1000 as question_id, o_custkey % 3 + o_orderkey % 400 as politician_id,
        cast(0.9 as double) as confidence_score from {orders}""",
    "unresolved": f"""select o_orderkey as id, {_spelled('o_custkey', 'o_orderkey')} as raw_value, 'POLITICIAN' as entity_type,
        concat('source-', cast(o_custkey % 25 as string)) as source_name,
        case when o_orderkey % 8 = 0 then null else concat('https://records.example.org/page/', cast(o_orderkey as string)) end as source_url,
        case o_orderstatus when 'O' then 'OPEN' when 'F' then 'RESOLVED' else 'IGNORED' end as status,
        o_orderdate as created_at
      from {{orders}}""",
    # Runs, sweeps -------------------------------------------------------------------------
    "runs": """select event_id as id, concat('source-', cast(user_id % 5 as string)) as source_name,
        case user_id % 4 when 0 then 'identity_bootstrap' when 1 then 'alias_regeneration' when 2 then 'bills' else 'meetings' end as run_type,
        ts as started_at,
        case event_type when 'error' then 'failed' when 'signup' then 'running' else 'completed' end as status,
        cast(floor(value) as bigint) as processed_count, cast(floor(value) as bigint) % 7 as created_count,
        cast(floor(value) as bigint) % 5 as updated_count, user_id % 3 as skipped_count,
        case when event_type = 'error' then cast(floor(value) as bigint) % 6 else 0 end as failed_count
      from {events}""",
    "run_errors": """select event_id as id, user_id as run_id, ts as created_at,
        concat('https://records.example.org/page/', cast(user_id as string)) as source_url,
        case event_id % 6 when 0 then 'HTTPError' when 1 then 'Timeout' when 2 then 'ConnectionError'
             when 3 then 'ValueError' when 4 then 'EmptyResponse' else 'OperationalError' end as error_type,
        case when event_id % 4 = 0 then 'server closed the connection unexpectedly' else concat('parse failure ', props) end as error
      from {events} where event_type = 'error'""",
    "sweep_log": """select event_id as seq, 'listing' as source_name, concat(event_type, '-', cast(user_id % 4 as string)) as stream_name,
        case when user_id % 19 = 0 then 'reset' when event_id % 11 = 0 then 'fail' else 'complete' end as action,
        1 + user_id % 5 as pages_attempted, 50 * (1 + user_id % 5) as seen, event_id % 40 as created, event_id % 13 as updated,
        event_id % 3 as failed, event_id % 17 = 0 as end_reached, event_id % 23 <> 0 as advance,
        case when event_id % 29 = 0 then 1000 + event_id else null end as source_total,
        case when event_id % 5 = 0 then concat('error at ', cast(event_id as string)) else null end as error
      from {events}""",
    # Votes, catalogues -----------------------------------------------------------------------
    "vote_csv": """select l_orderkey * 100 + l_linenumber as row_number, concat('m-', cast(l_orderkey % 7 as string)) as manifest_key,
        case when l_partkey % 31 = 0 then ' ' else o_orderpriority end as contest_id,
        case when o_orderkey % 10 = 0 then null else concat('Contest ', o_orderpriority) end as contest_name,
        cast(o_custkey % 25 as string) as province_id, concat('Nation ', cast(o_custkey % 25 as string)) as province_name,
        case when l_partkey % 37 = 0 then null else concat('P', cast(l_suppkey as string)) end as party_id,
        concat('Party ', cast(l_suppkey as string)) as party_name,
        case when l_linenumber = 1 then concat('C', cast(l_partkey as string)) else '' end as candidate_id,
        case when l_linenumber = 1 then concat('Candidate ', cast(l_partkey as string)) else null end as candidate_name,
        case when l_partkey % 41 = 0 then 'not-a-number'
             when l_partkey % 43 = 0 then concat('1,', '0', cast(cast(l_quantity as int) + 10 as string))
             else cast(cast(l_quantity as int) as string) end as votes
      from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "vote_totals": """select row_number as id, manifest_key, contest_id, province_id as geography_id, party_id, party_name, candidate_id,
        cast(replace(votes, ',', '') as bigint) as vote_total,
        concat('https://records.example.org/results/', manifest_key) as source_url
      from {vote_csv} where votes <> 'not-a-number'""",
    "catalogue": """select page_id as id, url as source_url,
        case page_id % 5 when 0 then 'national' when 1 then 'provincial' when 2 then 'municipal' when 3 then 'dashboard' else null end as election_type,
        case when page_id % 4 = 0 then null else 1994 + page_id % 30 end as election_year,
        case page_id % 3 when 0 then 'national' when 1 then 'ward' else null end as geography_level,
        case page_id % 7 when 0 then 404 when 1 then 500 when 2 then null else 200 end as status,
        case page_id % 6 when 0 then 'text/csv' when 1 then 'application/json' when 2 then 'application/pdf'
             when 3 then 'text/html' when 4 then 'application/octet-stream' else 'application/vnd.ms-excel' end as content_type,
        page_id % 7 not in (0, 1, 2) as ok, html as body
      from {pages}""",
    "manifests": """select distinct concat('m-', cast(l_orderkey % 9 as string)) as manifest_key,
        l_orderkey % 9 % 2 = 0 as reachable,
        case when l_orderkey % 9 % 3 = 0 then 'csv' when l_orderkey % 9 % 3 = 1 then 'html' else 'json' end as source_type,
        case when l_orderkey % 9 % 4 = 0 then null else concat('https://records.example.org/results/', cast(l_orderkey % 9 as string)) end as source_url
      from {lineitem}""",
    # Pages built from one row each --------------------------------------------------------------
    "vote_pages": f"""select o_orderkey as page_id, concat('https://records.example.org/vote/', cast(o_orderkey as string), '/') as url,
        concat('<html><h1>Division ', cast(o_orderkey as string), '</h1><table><tr><th>Party</th><th>Yes</th><th>No</th></tr>',
          '<tr><td>Party ', cast(o_custkey % 5 as string), '</td><td>', cast(o_custkey % 90 as string), '</td><td>1,0', cast(o_orderkey % 9 as string), '0</td></tr>',
          '<tr><td>Party X</td><td>n/a</td><td> ', cast(o_orderkey % 7 as string), ' </td></tr>',
          '<tr><td>', {_display('o_custkey')}, '</td><td>', case o_orderkey % 4 when 0 then 'Aye' when 1 then 'NO' when 2 then 'abstain' else 'maybe' end, '</td></tr></table></html>') as html
      from {{orders}}""",
    "bill_pages": """select p_partkey as page_id, concat('https://records.example.org/bills/', cast(p_partkey as string)) as url,
        concat('<table><tr><th>Bill</th><th>Year</th><th>Status</th></tr><tr><td><a href="/bill/', cast(p_partkey as string), '/">', p_name, ' Bill [B ', cast(p_size as string), ']</a></td><td>',
          cast(1990 + p_size % 30 as string), '</td><td>', case p_size % 4 when 0 then 'Signed into law' when 1 then 'Passed by NCOP' when 2 then 'Withdrawn' else 'Pending' end, '</td></tr></table><ul>',
          '<li>Introduced on ', cast(1 + p_size % 28 as string), ' March ', cast(1990 + p_size % 30 as string), '</li><li>Second reading ', cast(1990 + p_size % 30 as string), '-06-1', cast(p_size % 10 as string), '</li>',
          '<li>Second reading ', cast(1990 + p_size % 30 as string), '-06-1', cast(p_size % 10 as string), '</li><li>No news</li>',
          '<li><b>National Assembly</b>: <a href="https://laws.example.org/bill/', cast(p_partkey as string), '">', p_name, ' Act B', cast(p_size as string), 'A</a> introduced 20', cast(10 + p_size % 10 as string), '</li></ul>') as html
      from {part}""",
    "member_pages": f"""select o_orderkey as page_id, 'https://www.example.org/committees/' as url, o_custkey % 10 as committee_id,
        concat('<html><h1>Portfolio Committee on ', {_committee('(o_custkey % 10)')}, ' :: Register</h1><ul><li><a href="/person/p', cast(o_custkey as string), '/">Hon ', {_display('o_custkey')}, '</a> (Chairperson)</li>',
          '<li>Whip: <a href="http://www.example.org/person/p', cast(o_custkey + 1 as string), '">', upper({_display('(o_custkey + 1)')}), '</a></li><li><a href="/person/q/">Profile</a></li>',
          '<li><a href="/place/x/">Somewhere</a></li><li><a href="/person/p', cast(o_custkey as string), '/">Hon ', {_display('o_custkey')}, '</a> chairperson</li>',
          '<li><a href="/person/unknown-', {_letters('o_orderkey')}, '">Ms Visitor ', {_letters('o_orderkey')}, '</a></li></ul></html>') as html
      from {{orders}}""",
    "profile_pages": f"""select c_custkey as page_id, concat('https://www.example.org/person/p', cast(c_custkey as string), '/') as url,
        concat('<html><head><title>', {_display('c_custkey')}, ' :: Register</title>', case when c_custkey % 3 = 0 then concat('<meta property="profile:first_name" content="', {_pick(_FIRST, 'c_custkey')}, '"><meta property="profile:last_name" content="', {_surname('c_custkey')}, '">') else '' end,
          '<meta property="og:image" content="https://img.example.org/', cast(c_custkey as string), '.png"></head><body><h1 class="mp-name">Dr ', upper({_display('c_custkey')}), '</h1>',
          case when c_custkey % 2 = 0 then '<img class="mp-image" src="/media/p.jpg">' else '' end,
          '<div class="mp-block"><h3 class="mp-block__title">Political Party</h3><a href="/party/">', c_mktsegment, ' Front (', substr(c_mktsegment, 1, 3), ')</a></div><div class="current-mp-positions">',
          '<div class="text-link"><span class="text-link__text">Chairperson at <a href="/c/1/">Portfolio Committee on ', {_committee('(c_custkey % 10)')}, '</a></span><span class="text-link__date">since 3rd May 20', cast(10 + c_custkey % 10 as string), '</span></div>',
          '<div class="text-link"><span class="text-link__text">Member at <a href="/c/2/">', c_mktsegment, ' Front</a></span></div></div><p>',
          case c_custkey % 4 when 0 then 'Member of Parliament' when 1 then 'The member resigned' when 2 then 'Nothing here' else 'Current positions: none' end, '</p></body></html>') as html
      from {{customer}}""",
    "meeting_html": f"""select o_orderkey as page_id, concat('https://records.example.org/committee-meeting/', cast(o_orderkey as string), '/') as url,
        concat('<html><head><meta property="og:title" content="Social title | PMG">', case when o_orderkey % 3 = 0 then concat('<meta property="article:published_time" content="', cast(cast(o_orderdate as date) as string), 'T08:00:00+02:00">') else '' end, '</head><body>',
          case when o_orderkey % 4 = 0 then '' else concat('<h1>Meeting &amp; vote ', cast(o_orderkey as string), '</h1>') end,
          '<p class="date">', cast(1 + o_custkey % 28 as string), ' March ', cast(1995 + o_custkey % 20 as string), '</p>', case when o_orderkey % 2 = 0 then concat('<a class="committee-name" href="/committee/1">', {_committee('(o_custkey % 10)')}, '</a>') else '' end,
          '<div class="summary">Portfolio Committee on ', {_pick(_TOPIC, 'o_custkey')}, '; notes <b>of</b> the day. <a href="/files/minutes-', cast(o_orderkey as string), '.pdf">minutes</a> <a href="/question-papers/x">paper</a></div>',
          '<h3>Members present</h3><ul><li>', {_display('o_custkey')}, '</li><li>Mr ', {_surname('(o_custkey + 1)')}, '</li></ul><h3>Apologies</h3><table><tr><td>', {_display('(o_custkey + 2)')}, '</td><td></td></tr><tr><td>Ms ', {_surname('(o_custkey + 3)')}, '</td><td>Absent</td></tr></table></body></html>') as html
      from {{orders}}""",
    "question_texts": """select id, source_url, concat('Question Number: ', question_number, ' Asked By: ', trim(asked_by_name), ' (XY) Department: ', department, ' Minister - ', minister, ' Question Date: ',
          cast(asked_date as string), case when id % 3 = 0 then ' Status: Pending' else '' end, case when id % 4 = 0 then '' else concat(' Question: ', replace(replace(question_text, ':', ' '), '-', ' ')) end,
          case when answer_text is null or id % 4 = 0 then '' else concat(' Reply: ', replace(replace(answer_text, ':', ' '), '-', ' ')) end) as body, question_text, answer_text, question_number, asked_by_name, department, minister, asked_date
      from {questions}""",
    "listing_json": f"""select o_orderkey as page_no, concat('{{{{"count": 9, "next": null, "results": [{{{{"id": ', cast(o_orderkey as string), ', "title": "Title ', cast(o_orderkey as string), '", "date": "', cast(cast(o_orderdate as date) as string), 'T10:00", "code": "B', cast(o_orderkey % 50 as string), '-2020", "number": ',
          case when o_orderkey % 3 = 0 then 'null' else cast(o_orderkey % 50 as string) end, ', "year": 2020, "status": {{{{"name": "', case o_orderkey % 3 when 0 then 'Signed by President' when 1 then 'Passed' else 'new' end, '"}}}}, "events": [{{{{"type": "introduced", "date": "2020-01-0', cast(1 + o_orderkey % 9 as string),
          '", "title": "Tabled"}}}}, {{{{"type": null, "date": "bad", "title": ""}}}}], "attendance": [{{{{"attendance": "', case o_orderkey % 5 when 0 then 'P' when 1 then 'ap' when 2 then 'LDE' when 3 then 'A' else 'ZZ' end, '", "member": {{{{"name": "', {_surname('o_custkey')}, ', Ms ', {_pick(_FIRST, 'o_custkey')},
          '", "party": {{{{"name": "ANC"}}}}}}}}}}}}, {{{{"attendance": "P", "member": {{{{"name": null}}}}}}}}]}}}}]}}}}') as payload
      from {{orders}}""",
    # Pages and listings ------------------------------------------------------------------------
    "links": """select page_id, url, html from {pages}""",
    "asks": f"""select conv_id * 1000 + turn as question_id,
        case conv_id % 10
          when 0 then concat('What did Mr ', {_surname('(conv_id % 150)')}, ' ask about ', lower({_pick(_TOPIC, 'conv_id')}), ' budgets?')
          when 1 then concat('Who is ', {_display('(conv_id % 150)')}, '?')
          when 2 then concat('Who sits on the ', lower({_committee('(conv_id % 10)')}), ' committee?')
          when 3 then concat('Which members belong to the ', {_pick('BUILDING,MACHINERY,HOUSEHOLD,FURNITURE,AUTOMOBILE', 'conv_id')}, ' party?')
          when 4 then concat('Show the hearing on ', lower({_pick(_TOPIC, 'conv_id')}), ' matters')
          when 5 then concat('Which ', {_pick('small,red,blue,green', 'conv_id')}, ' bill is assented')
          when 6 then concat('How did they vote on ', lower({_pick(_TOPIC, 'conv_id')}))
          when 7 then concat('Who was absent from ', lower({_pick(_TOPIC, 'conv_id')}))
          when 8 then concat('What did ', {_display('(conv_id % 150)')}, ' say at the hearing on ', lower({_pick(_TOPIC, 'conv_id')}), '?')
          else concat('Find ', {_pick(_FIRST, 'conv_id')}) end as question
      from {{qa}}""",
}


#: Views of long texts that every row is built into: their rows are dealt out first, as a small file is read by few tasks.
PAGES = ("vote_pages", "bill_pages", "member_pages", "profile_pages", "meeting_html", "listing_json")


class Tables:
    """Lazy access to the supplied tables and the civic views on top of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                sql = VIEWS[name]
                deps = {d: getattr(self, d) for d in set(re.findall(r"\{(\w+)\}", sql))}
                if name in PAGES:
                    n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                    deps = {d: df.repartition(n, df.columns[0]) for d, df in deps.items()}
                self._cache[name] = self.spark.sql(sql, **deps)
            else:
                raise AttributeError(name)
        return self._cache[name]

    def in_file_order(self, view: str, base: str) -> DataFrame:
        """A view of ``base`` with ``_at``, the place of its row in the files, where repeated ids leave the first row open."""
        rows = getattr(self, base).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
        sql = VIEWS[view].replace("select ", "select _at, ", 1)
        return self.spark.sql(sql, **({d: getattr(self, d) for d in set(re.findall(r"\{(\w+)\}", sql))} | {base: rows}))
