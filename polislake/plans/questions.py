"""Evidence retrieval for a table of questions (I)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import names, text
from polislake.operators import answers
from polislake.operators import evidence as ev
from polislake.operators.resolve import alias_table
from polislake.operators.textindex import TextIndex, alphabetical, first_sources, newest
from polislake.plans.registry import QUERIES, query
from polislake.plans.scalars import ALIAS_SQL
from polislake.session import cut_lineage, if_small, shared_folder

_STOP = ", ".join(f"'{w}'" for w in vocab.SEARCH_STOP_WORDS)


def _terms(expr: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({expr}), '[a-zA-Z][a-zA-Z0-9+-]{{2,}}'), lambda w: w not in ({_STOP}))"
    return f"case when len({kept}) > 0 then ({kept})[1:8] else [trim({expr})] end"


@query("I01_normalize_question", r"select question_id, substr(regexp_replace(lower(trim(question)), '\s+', ' ', 'g'), 1, 500) as normalized from asks")
def i01(t):
    return t.asks.select("question_id", ev.normalize_question(F.col("question")).alias("normalized"))


def _has(*words: str) -> str:
    return "(" + " or ".join(f"contains(lower(question), '{w}')" for w in words) + ")"


INTENT_SQL = rf"""case when regexp_matches(lower(question), '\b(who is|who''s|tell me about|profile of|what is known about)\b') then 'profile'
   when regexp_matches(lower(question), '\b(how many|who|which|name|list|people|mps?|members?)\b') and regexp_matches(lower(question), '\b(party|parties|member|members|belong|belongs)\s+(?:of|to|in)\b|\bmembers?\s+of\b|\bfrom\s+the\b') then 'parties'
   when {_has('hearing', 'enquiry', 'inquiry', 'testimony', 'testified', 'briefing')} then 'hearings' when {_has('question', 'asked', ' ask ', 'minister', 'department')} then 'questions'
   when {_has('attend', 'absent', 'apology', 'present')} then 'attendance' when {_has('committee', 'sits on', 'sit on', 'serve on', 'serves on')} then 'committees'
   when {_has('bill', 'act', 'legislation')} then 'bills' when {_has('vote', 'division')} then 'votes' else 'politicians' end"""


@query("I02_intent", f"select question_id, {INTENT_SQL} as intent from asks")
def i02(t):
    return t.asks.select("question_id", ev.intent(F.col("question")).alias("intent"))


@query("I03_action", r"""select question_id, case when regexp_matches(lower(question), '\b(ask|asked|question|questions|say|said|raised|intervention|interventions)\b') then 'spoken_question' when regexp_matches(lower(question), '\b(attend|attended|present|absent|apology|apologies)\b') then 'attendance'
   when regexp_matches(lower(question), '\b(vote|voted|division)\b') then 'vote' when regexp_matches(lower(question), '\b(sit|sits|serve|serves|served|member)\b') then 'membership' else 'general' end as action from asks""")
def i03(t):
    return t.asks.select("question_id", ev.action(F.col("question")).alias("action"))


@query("I04_person_subject", r"""select question_id, case conv_id % 10 when 0 then regexp_extract(question, '^What did (.+) ask about', 1) when 1 then regexp_extract(question, '^Who is (.+)\?$', 1) when 8 then regexp_extract(question, '^What did (.+) say at', 1)
   when 6 then 'They' end as subject from (select *, cast(floor(question_id / 1000) as bigint) as conv_id from asks)""")
def i04(t):
    q = F.col("question")
    return t.asks.select("question_id", ev.person_subject(q, ev.intent(q)).alias("subject"))


@query("I05_search_terms", f"select question_id, array_to_string({_terms('question')}, '|') as terms from asks")
def i05(t):
    return t.asks.select("question_id", F.array_join(text.search_terms(F.col("question")), "|").alias("terms"))


@query("I06_topic_terms", rf"""select question_id, case when regexp_extract(question, '\babout\s+(.+?)(?:\?|$)', 1, 'i') <> '' then array_to_string({_terms("regexp_extract(question, '" + chr(92) + "babout" + chr(92) + "s+(.+?)(?:" + chr(92) + "?|$)', 1, 'i')")}, '|') else array_to_string({_terms('question')}, '|') end as terms from asks""")
def i06(t):
    return t.asks.select("question_id", F.array_join(ev.topic_terms(F.col("question")), "|").alias("terms"))


@query("I06_committee_terms", rf"""select question_id, array_to_string(case when len(k) > 0 then k[1:8] else [c] end, '|') as terms from (select question_id, c, list_filter(regexp_extract_all(lower(c), '[a-zA-Z][a-zA-Z0-9+-]{{2,}}'), lambda w: w not in ({_STOP})) as k from
   (select question_id, trim(regexp_replace(regexp_replace(question, '\b(who|which|mps?|members?|sits?|serves?|served|serve|on|the|committee|committees|of)\b', ' ', 'gi'), '\s+', ' ', 'g')) as c from asks))""")
def i06b(t):
    return t.asks.select("question_id", F.array_join(ev.committee_terms(F.col("question")), "|").alias("terms"))


@query("I07_person_aliases", """select id, array_to_string(list_distinct_ordered, '|') as aliases from (select id, list_filter(all_a, lambda x, i: list_position(list_transform(all_a, lambda y: lower(y)), lower(x)) = i) as list_distinct_ordered from (
   select id, [display_name, s, 'Mr ' || s, 'Ms ' || s, 'Mrs ' || s, 'Dr ' || s, f || ' ' || s, 'Mr ' || f || ' ' || s, 'Ms ' || f || ' ' || s] as all_a from (select id, display_name, split_part(display_name, ' ', 2) as s, substr(display_name, 1, 1) as f from people)))""")
def i07(t):
    return t.people.select("id", F.array_join(ev.person_aliases(F.col("display_name")), "|").alias("aliases"))


def _asked(t):
    """Topic terms of all questions: small next to the corpora, used several times, so planned once."""
    return cut_lineage(t.asks.select("question_id", F.explode(ev.topic_terms(F.col("question"))).alias("term")))


_ASKED = rf"""about as (select question_id, question, regexp_extract(question, '\babout\s+(.+?)(?:\?|$)', 1, 'i') as ab from asks), src as (select question_id, case when ab <> '' then ab else question end as s from about),
   asked as (select distinct question_id, unnest({_terms('s')}) as term from src)"""


@query("I08_question_evidence", f"""with {_ASKED}, c as (select id, asked_date, lower(concat_ws(chr(10), title, question_text, answer_text, department)) as b from questions), terms as (select distinct term from asked),
   hits as (select term, id, asked_date from terms join c on contains(c.b, lower(term))), pairs as (select distinct question_id, id, asked_date from asked join hits using (term))
   select question_id, id, position from (select *, row_number() over (partition by question_id order by asked_date desc nulls last, id) as position from pairs) where position <= 8""")
def i08(t):
    asked = _asked(t)
    hits = ev.term_hits(t.questions, "id", ["title", "question_text", "answer_text", "department"], asked)
    return ev.newest_sources(asked, hits, t.questions, "id", [F.desc_nulls_last("asked_date")], among=["asked_date"]).select("question_id", "id", "position")


def _index(t, corpus, columns, order, name):
    """An index of a corpus, built in two segments and merged."""
    place = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    parts = TextIndex(t.spark, place)
    for i in range(2):
        parts.add(corpus.where(F.pmod("id", F.lit(2)) == i), "id", columns, order, i)
    return parts.merged(f"{place}-merged")


@query("I08_indexed_evidence", QUERIES["I08_question_evidence"].sql)
def i08c(t):
    """I08 from a stored index."""
    columns, asked = ["title", "question_text", "answer_text", "department"], _asked(t)
    index = _index(t, t.questions, columns, newest("asked_date", "id"), "questions")
    return first_sources(asked, index.search(asked, t.questions, "id", columns), "id")


_ASKERS = r"""askers as (select question_id, unnest(list_distinct([regexp_extract(question, '\bMr ([A-Z][A-Za-z]+) ask', 1)])) as asker from asks where regexp_matches(question, '\bMr [A-Z][A-Za-z]+ ask'))"""


@query("I08_question_evidence_by_asker", f"""with {_ASKED}, {_ASKERS}, c as (select id, asked_date, lower(concat_ws(chr(10), title, question_text, answer_text, department)) as b, lower(concat_ws(chr(10), asked_by_name, question_text)) as w from questions),
   pairs as (select distinct a.question_id, c.id, c.asked_date from asked a join askers s using (question_id) join c on contains(c.b, lower(a.term)) and contains(c.w, lower(s.asker)))
   select question_id, id, position from (select *, row_number() over (partition by question_id order by asked_date desc nulls last, id) as position from pairs) where position <= 8""")
def i08b(t):
    asked = _asked(t)
    askers = cut_lineage(t.asks.select("question_id", F.explode(ev.asker_terms(F.col("question"))).alias("term")))
    hits = ev.term_hits(t.questions, "id", ["title", "question_text", "answer_text", "department"], asked)
    who = ev.term_hits(t.questions, "id", ["asked_by_name", "question_text"], askers)
    return ev.question_sources(asked, askers, t.questions, hits, who, "id", [F.desc_nulls_last("asked_date")], ["asked_date"]).select("question_id", "id", "position")


_FOUND = {"committee": ("committees", ["name", "description"], "name", "name"), "bill": ("bills", ["title", "bill_number", "status"], "year desc nulls last", "year"),
          "vote": ("vote_events", ["title", "chamber", "vote_type", "result"], "date desc nulls last", "date"), "politician": ("people", ["full_name", "display_name", "slug", "party"], "display_name", "display_name"),
          "attendance": ("(select a.id, name_raw, attendance_status, m.title, m.committee_name, m.date from attendance a join meetings m on m.id = a.meeting_id)", ["name_raw", "attendance_status", "title", "committee_name"], "date desc nulls last", "date")}


@query("I09_typed_evidence", f"with {_ASKED}, terms as (select distinct term from asked), " + ", ".join(
    f"""h_{k} as (select '{k}' as kind, question_id, id, row_number() over (partition by question_id order by {o}, id) as position from (select distinct question_id, id, {oc} from asked join (select term, id, {oc} from terms join {tab} on contains(lower(concat_ws(chr(10), {', '.join(cs)})), lower(term))) using (term)))"""
    for k, (tab, cs, o, oc) in _FOUND.items()) + " " + " union all ".join(f"select kind, question_id, id, position from h_{k} where position <= 8" for k in _FOUND))
def i09(t):
    asked = _asked(t)
    out = None
    for kind, (tab, cols, order, col) in _FOUND.items():
        by = F.desc_nulls_last(col) if "desc" in order else F.col(col)
        if kind == "attendance":
            found = ev.attendance_sources(asked, t.attendance, t.meetings)
        else:
            df = getattr(t, tab)
            found = ev.newest_sources(asked, ev.term_hits(df, "id", cols, asked), df, "id", [by], among=[col])
        part = found.select(F.lit(kind).alias("kind"), "question_id", "id", "position")
        out = part if out is None else out.unionByName(part)
    return out


_INDEXED = [k for k in _FOUND if k != "attendance"]


@query("I09_indexed_evidence", f"with {_ASKED}, terms as (select distinct term from asked), " + ", ".join(
    f"""h_{k} as (select '{k}' as kind, question_id, id, row_number() over (partition by question_id order by {o}, id) as position from (select distinct question_id, id, {oc} from asked join (select term, id, {oc} from terms join {tab} on contains(lower(concat_ws(chr(10), {', '.join(cs)})), lower(term))) using (term)))"""
    for k, (tab, cs, o, oc) in _FOUND.items() if k in _INDEXED) + " " + " union all ".join(f"select kind, question_id, id, position from h_{k} where position <= 8" for k in _INDEXED))
def i09b(t):
    """I09 from stored indexes."""
    asked, out = _asked(t), None
    orders = {"committee": alphabetical("name", "id"), "politician": alphabetical("display_name", "id"), "vote": newest("date", "id"),
              "bill": F.struct(F.col("year").isNull().alias("none"), (-F.coalesce("year", F.lit(0))).alias("at"), F.col("id").alias("key"))}
    for kind in _INDEXED:
        tab, columns, _, _ = _FOUND[kind]
        corpus = getattr(t, tab)
        found = _index(t, corpus, columns, orders[kind], tab).search(asked, corpus, "id", columns)
        part = first_sources(asked, found, "id").select(F.lit(kind).alias("kind"), "question_id", "id", "position")
        out = part if out is None else out.unionByName(part)
    return out


@query("I10_committee_match", rf"""with q as (select question_id, list_sort(list_distinct(case when len(k) > 0 then k[1:8] else [c] end)) as ts from (select question_id, c, list_filter(regexp_extract_all(lower(c), '[a-zA-Z][a-zA-Z0-9+-]{{2,}}'), lambda w: w not in ({_STOP})) as k from
   (select question_id, trim(regexp_replace(regexp_replace(question, '\b(who|which|mps?|members?|sits?|serves?|served|serve|on|the|committee|committees|of)\b', ' ', 'gi'), '\s+', ' ', 'g')) as c from asks))),
   n as (select id, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w)), lambda w: length(w) > 1) as tok from committees),
   s as (select question_id, id, case when list_has_all(tok, ts) then 100 else 70 end as score from q join n on list_has_any(tok, ts))
   select question_id, id as committee_id, score from (select *, row_number() over (partition by question_id order by score desc, id) as rn from s) where rn = 1""")
def i10(t):
    asked = t.asks.select("question_id", ev.committee_terms(F.col("question")).alias("terms"))
    return ev.committee_matches(asked, t.committees)


@query("I10_committee_members", """with m as (select committee_id, role, p.display_name, p.party, row_number() over (partition by committee_id order by role, politician_id) as position from memberships join people p on p.id = politician_id)
   select committee_id, position, concat(display_name, ' (', concat_ws(', ', party, role), ')') as member from m where position <= 8""")
def i10b(t):
    from polislake.operators.tables import top_k

    first = top_k(t.memberships, ["committee_id"], [F.col("role"), F.col("politician_id")], vocab.MAX_SOURCES, rank="position")
    p = t.people.select(F.col("id").alias("politician_id"), "display_name", F.when(~names.is_unknown_label(F.col("party")), F.col("party")).alias("party"))
    label = F.concat("display_name", F.lit(" ("), F.concat_ws(", ", "party", "role"), F.lit(")"))
    return first.join(p, "politician_id").select("committee_id", "position", label.alias("member"))


@query("I11_party_of_question", """select question_id, short_name as party from (select a.question_id, y.short_name, row_number() over (partition by a.question_id order by length(short_name) desc, short_name) as rn from asks a join parties y on regexp_matches(lower(question), '\\b' || lower(short_name) || '\\b')) where rn = 1""".replace("\\\\", "\\"))
def i11(t):
    return ev.party_of_question(t.asks, t.parties)


@query("I11_party_members", r"""with r as (select party, display_name as name, 'politician_party_link' as evidence, 0 as rank, id from people where party is not null union all
     select 'BUILDING', trim(trim(regexp_replace(asked_by_name, '\s*\(DA\)\s*', ' ', 'g')), ' ,.;'), 'parliamentary_question_party_label', 2, id from questions where contains(asked_by_name, '(DA)')),
   k as (select *, array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(name, '\b(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\b', ' ', 'gi'), '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 1), lambda w: lower(w)), ' ') as key from r),
   b as (select * from (select *, row_number() over (partition by party, key order by rank, id) as rn from k where key <> '') where rn = 1)
   select party, count(*) as members, count(*) filter (where evidence = 'politician_party_link') as linked, count(*) filter (where evidence <> 'politician_party_link') as labelled from b group by 1""")
def i11b(t):
    a = t.people.where("party is not null").select("party", F.col("display_name").alias("name"), F.lit("politician_party_link").alias("evidence"), "id")
    b = t.questions.where(F.contains("asked_by_name", F.lit("(DA)"))).select(
        F.lit("BUILDING").alias("party"), names.without_party_label(F.col("asked_by_name"), F.lit("DA")).alias("name"), F.lit("parliamentary_question_party_label").alias("evidence"), "id")
    m = ev.merge_party_members(a.unionByName(b), ["party"])
    linked = F.col("evidence") == "politician_party_link"
    return m.groupBy("party").agg(F.count("*").alias("members"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("labelled"))


_HT = r"trim(regexp_replace(regexp_replace(question, '\b(what|did|does|ask|asked|question|questions|in|during|at|the|hearing|hearings|enquiry|inquiry|testimony|testified|briefing|lieutenant|general)\b', ' ', 'gi'), '\s+', ' ', 'g'))"
_MEET = f"""hq as (select question_id, {_HT} as s from asks where contains(question, 'hearing')), asked as (select distinct question_id, unnest({_terms('s')}) as term from hq),
   c as (select id, date, lower(concat_ws(chr(10), title, committee_name, summary)) as b from meetings), terms as (select distinct term from asked), hits as (select term, id, date, list_contains(regexp_extract_all(b, '[a-z0-9+-]+'), lower(term)) as exact from terms join c on contains(c.b, lower(term))),
   sc as (select question_id, id, date, sum(case when exact and length(term) >= 6 then 3 else 1 end)::bigint as score from asked join hits using (term) group by 1, 2, 3),
   mt as (select question_id, id, score, rank from (select *, row_number() over (partition by question_id order by score desc, date desc nulls last, id) as rank from (select *, max(score) over (partition by question_id) as top from sc) where score >= 2 or top < 2) where rank <= 8)"""


def _meeting_matches(t):
    asked = cut_lineage(t.asks.where(F.contains("question", F.lit("hearing"))).select("question_id", F.explode(F.array_distinct(ev.hearing_terms(F.col("question")))).alias("term")))
    hits = ev.term_hits(t.meetings, "id", ["title", "committee_name", "summary"], asked)
    return ev.meeting_scores(asked, hits, t.meetings, "id", [F.desc_nulls_last("date")], ["date"])


@query("I12_meeting_relevance", f"with {_MEET} select question_id, id, score, rank from mt")
def i12(t):
    return _meeting_matches(t)


def _person_rows(t):
    """Involvement of the named person at the matched meetings of each question."""
    q = F.col("question")
    who = cut_lineage(t.asks.select("question_id", ev.person_subject(q, ev.intent(q)).alias("subject")).where("subject is not null"))
    person = cut_lineage(ev.profile_matches(who, t.people, cut_lineage(alias_table(t.people))))
    matched = cut_lineage(_meeting_matches(t)).join(who, "question_id").join(person, "subject", "left").select("question_id", "id", "subject", "person_id", ev.person_aliases(F.col("subject")).alias("aliases"))
    return ev.person_meetings(cut_lineage(matched), t.meetings, t.attendance)


@query("I13_person_meetings", rf"""with {_MEET},
   w as (select question_id, regexp_extract(question, '^What did (.+?) say', 1) as subject from asks where regexp_matches(question, '^What did .+ say')),
   n as (select *, split_part(subject, ' ', -1) as s, substr(subject, 1, 1) as f from w), u as (select question_id, subject, s, [lower(subject), lower(s), 'mr ' || lower(s), 'ms ' || lower(s), 'mrs ' || lower(s), 'dr ' || lower(s), lower(f) || ' ' || lower(s), 'mr ' || lower(f) || ' ' || lower(s), 'ms ' || lower(f) || ' ' || lower(s)] as forms, (select min(id) from people p where p.display_name = subject) as pid from n),
   m as (select mt.question_id, mt.id, u.subject, u.s, u.forms, u.pid, x.date, x.summary from mt join u using (question_id) join meetings x on x.id = mt.id),
   a as (select m.question_id, m.id, coalesce(arg_min(r.attendance_status, r.id) filter (where r.politician_id = m.pid), arg_min(r.attendance_status, r.id) filter (where len(list_filter(m.forms, lambda z: contains(lower(r.name_raw), z))) > 0)) as status
     from m left join attendance r on r.meeting_id = m.id group by 1, 2),
   c0 as (select m.*, list_filter(regexp_split_to_array(regexp_replace(coalesce(summary, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda z: trim(z) <> '') as ch from m),
   cx as (select question_id, id, subject, date, lower(array_to_string(list_filter(list_transform(ch, lambda z, i: case when regexp_matches(lower(z), '(^|[^a-z''-])' || lower(s) || '($|[^a-z''-])') then array_to_string(ch[greatest(i - 1, 1):i + 1], ' ') end), lambda z: z is not null), ' ')) as ctx from c0),
   v as (select cx.*, case when regexp_matches(ctx, '\b(apology|apologies|apologised|prior commitment|prior commitments)\b') then 'apology' when regexp_matches(ctx, '\b(asked|questioned|enquired|wanted to know|sought clarity|raised|said|submitted|proposed)\b') then 'intervention'
     when status in ('present', 'absent', 'apology') then status when ctx <> '' then 'mentioned' else 'not_found' end as involvement from cx join a using (question_id, id))
   select question_id, id, involvement, row_number() over (partition by question_id order by case involvement when 'intervention' then 0 when 'present' then 1 when 'mentioned' then 2 when 'apology' then 3 when 'absent' then 4 else 5 end, coalesce(date::varchar, ''), id) as position from v""")
def i13(t):
    return _person_rows(t).select("question_id", "id", "involvement", "position")


PROFILE_SQL = ALIAS_SQL + r""",
   toks as (select distinct id, list_filter(list_transform(regexp_extract_all(regexp_replace(n, '\b(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\b', ' ', 'gi'), '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w)), lambda w: length(w) > 1) as t from (select id, unnest([full_name, display_name, replace(slug, '-', ' ')]) as n from people union all select person_id, alias from aliases)),
   subj as (select distinct display_name as subject, list_transform(string_split(display_name, ' '), lambda w: lower(w)) as q from people union select concat(substr(display_name, 1, 1), 'xx ', split_part(display_name, ' ', 2)), [lower(substr(display_name, 1, 1)) || 'xx', lower(split_part(display_name, ' ', 2))] from people),
   sc as (select subject, id, max(case when t = q then 100 when list_has_all(t, q) then 90 when list_contains(t, q[len(q)]) and substr(q[1], 1, 1) = substr(t[1], 1, 1) then 80 when list_contains(t, q[len(q)]) then 65 else 0 end) as score
     from subj join (select id, t, unnest(t) as w from toks) x on x.w = q[len(q)] group by 1, 2)"""


@query("I14_profile_match", f"with {PROFILE_SQL} select subject, id as person_id, score from (select *, row_number() over (partition by subject order by score desc, id) as rn from sc where score >= 50) where rn = 1")
def i14(t):
    p = t.people
    subjects = p.select(F.col("display_name").alias("subject")).union(
        p.select(F.concat(F.left("display_name", F.lit(1)), F.lit("xx "), F.substring_index("display_name", " ", -1))))
    return ev.profile_matches(subjects, p, alias_table(p))


@query("I14_profile_card", """select p.id, p.display_name, concat_ws(' | ', p.full_name, 'Party: ' || p.party, 'Linked parliamentary questions: ' || (select count(*) from questions q where q.politician_id = p.id), 'Linked attendance records: ' || (select count(*) from attendance a where a.politician_id = p.id), p.source_status) as card from people p""")
def i14b(t):
    n = ev.activity_counts(t.people, t.questions, t.attendance, t.memberships)
    line = F.concat_ws(" | ", "full_name", F.concat(F.lit("Party: "), "party"), F.concat(F.lit("Linked parliamentary questions: "), F.col("questions").cast("string")), F.concat(F.lit("Linked attendance records: "), F.col("attendance").cast("string")), "source_status")
    return t.people.join(n, "id").select("id", "display_name", text.excerpt(line).alias("card"))


def _every_term(t):
    """All search terms of the questions, whatever they are about."""
    return cut_lineage(t.asks.select("question_id", F.explode(F.array_distinct(ev.text.search_terms(F.col("question")))).alias("term")))


def _routed(t):
    """Evidence of every intent for the questions of that intent, each with its own terms."""
    from polislake.operators.tables import top_k

    q = F.col("question")
    asks = cut_lineage(t.asks.withColumn("intent", ev.intent(q)).withColumn("asked_by", F.size(ev.asker_terms(q)) > 0))
    of = lambda intent: asks.where(F.col("intent") == intent).select("question_id")
    terms, topics = _every_term(t), _asked(t)
    only = lambda rows, ids: rows.join(ids, "question_id", "left_semi")
    cols = {"questions": ["title", "question_text", "answer_text", "department"], "bills": ["title", "bill_number", "status"], "votes": ["title", "chamber", "vote_type", "result"], "politicians": ["full_name", "display_name", "slug", "party"]}

    def newest(wanted, corpus, kind, col, desc=True):
        by = F.desc_nulls_last(col) if desc else F.col(col)
        return ev.newest_sources(wanted, ev.term_hits(corpus, "id", cols[kind], wanted), corpus, "id", [by], among=[col]).select("question_id", "id", "position")

    asking = only(topics, of("questions"))
    askers = cut_lineage(asks.where("intent = 'questions' and asked_by").select("question_id", F.explode(ev.asker_terms(q)).alias("term")))
    by_asker = ev.question_sources(
        only(asking, askers.select("question_id")), askers, t.questions, ev.term_hits(t.questions, "id", cols["questions"], asking), ev.term_hits(t.questions, "id", ["asked_by_name", "question_text"], askers),
        "id", [F.desc_nulls_last("asked_date")], ["asked_date"]).select("question_id", "id", "position")
    plain = newest(asking.join(askers.select("question_id"), "question_id", "left_anti"), t.questions, "questions", "asked_date")
    named = cut_lineage(asks.where("intent = 'profile'").select("question_id", ev.profile_subject(q).alias("subject")).where("subject is not null"))
    profile = named.join(ev.profile_matches(named, t.people, cut_lineage(alias_table(t.people))), "subject").select("question_id", F.col("person_id").alias("id"), F.lit(1).alias("position"))
    party = ev.party_of_question(only(t.asks, of("parties")), t.parties)
    members = top_k(t.people.where("party is not null").select("party", "id", "display_name"), ["party"], [F.col("display_name"), F.col("id")], vocab.MAX_SOURCES, rank="position")
    committee = ev.committee_matches(only(t.asks, of("committees")).select("question_id", ev.committee_terms(q).alias("terms")), t.committees)
    seats = top_k(t.memberships, ["committee_id"], [F.col("role"), F.col("politician_id")], vocab.MAX_SOURCES, rank="position")
    found = {
        "questions": by_asker.unionByName(plain), "bills": newest(only(terms, of("bills")), t.bills, "bills", "year"), "votes": newest(only(terms, of("votes")), t.vote_events, "votes", "date"),
        "politicians": newest(only(terms, of("politicians")), t.people, "politicians", "display_name", False), "profile": profile,
        "parties": party.join(members, "party").select("question_id", "id", "position"), "committees": committee.join(seats, "committee_id").select("question_id", F.col("politician_id").alias("id"), "position"),
        "attendance": ev.attendance_sources(only(terms, of("attendance")), t.attendance, t.meetings).select("question_id", "id", "position"),
        "hearings": only(_meeting_matches(t), of("hearings")).select("question_id", "id", F.col("rank").alias("position")),
    }
    person = t.people.select("id", F.col("display_name").alias("title"), F.lit(None).cast("string").alias("date"), F.concat_ws(" | ", "full_name", "party").alias("excerpt"), "full_name", F.col("party").alias("place"), F.col("source_status").alias("status"))
    shown = lambda df, title, date, excerpt, **more: df.select("id", F.col(title).alias("title"), F.col(date).cast("string").alias("date"), text.excerpt(F.col(excerpt).cast("string")).alias("excerpt"), *[F.col(c).alias(a) for a, c in more.items()])
    meet = t.meetings.select(F.col("id").alias("meeting_id"), "date", F.col("title").alias("meeting_title"))

    def attended(hits):
        # Of all attendance, what was found: the rest needs no title.
        seen = t.attendance.join(if_small(hits.select("id").distinct()), "id", "left_semi").join(meet, "meeting_id")
        rows = seen.select("id", F.concat_ws(": ", "name_raw", "attendance_status").alias("title"), F.col("date").cast("string").alias("date"), F.col("meeting_title").alias("excerpt"))
        return top_k(rows, ["id"], [F.col("title")], 1)

    asked_rows = shown(t.questions, "title", "asked_date", "question_text", who="asked_by_name", department="department", status="status")
    card = {"questions": asked_rows, "bills": shown(t.bills, "title", "year", "status"), "votes": shown(t.vote_events, "title", "date", "result"), "hearings": shown(t.meetings, "title", "date", "summary", place="committee_name")}

    def with_card(intent, hits):
        hits = cut_lineage(hits)
        cards = attended(hits) if intent == "attendance" else card.get(intent, person)
        return hits.join(cards, "id").withColumn("intent", F.lit(intent)).withColumn("id", F.col("id").cast("string"))

    every = None
    for intent, hits in found.items():
        part = with_card(intent, hits)
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    fallback = with_card("questions", newest(only(terms, of("politicians")), t.questions, "questions", "asked_date"))
    return asks.drop("asked_by"), ev.route(asks, every, fallback)


_HAS_ANY = "contains(lower(concat_ws(chr(10), {c})), lower(term))"


def _newest_sql(intent, tab, cols, order, terms="every"):
    return f"""select question_id, '{intent}' as intent, id, row_number() over (partition by question_id order by {order}, id) as position from (select distinct e.question_id, x.id, x.{order.split()[0]} from {terms} e join qi using (question_id) join {tab} x on {_HAS_ANY.format(c=cols)} where qi.intent = '{intent}')"""


@query("I15_routed_evidence", "with " + PROFILE_SQL.strip().replace("sc as (select subject", "psc as (select subject") + rf""", qi as (select question_id, question, {INTENT_SQL} as intent from asks), every as (select distinct question_id, unnest({_terms('question')}) as term from asks), {_ASKED.replace("asked as (select distinct", "t_asked as (select distinct")}, {_ASKERS}, {_MEET},
   att as (select a.id, name_raw, attendance_status, m.title, m.committee_name, m.date from attendance a join meetings m on m.id = a.meeting_id),
   party_of as (select question_id, short_name from (select qi.question_id, y.short_name, row_number() over (partition by qi.question_id order by length(short_name) desc, short_name) as rn from qi join parties y on regexp_matches(lower(question), '\b' || lower(short_name) || '\b') where intent = 'parties') where rn = 1),
   seat_terms as (select question_id, list_sort(list_distinct(case when len(k) > 0 then k[1:8] else [c] end)) as ts from (select question_id, c, list_filter(regexp_extract_all(lower(c), '[a-zA-Z][a-zA-Z0-9+-]{{2,}}'), lambda w: w not in ({_STOP})) as k from
     (select question_id, trim(regexp_replace(regexp_replace(question, '\b(who|which|mps?|members?|sits?|serves?|served|serve|on|the|committee|committees|of)\b', ' ', 'gi'), '\s+', ' ', 'g')) as c from qi where intent = 'committees'))),
   seat_names as (select id, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w)), lambda w: length(w) > 1) as tok from committees),
   seat_of as (select question_id, id from (select question_id, id, row_number() over (partition by question_id order by case when list_has_all(tok, ts) then 100 else 70 end desc, id) as rn from seat_terms join seat_names on list_has_any(tok, ts)) where rn = 1),
   q_plain as (select question_id, 'questions' as intent, id, row_number() over (partition by question_id order by asked_date desc nulls last, id) as position from (select distinct a.question_id, x.id, x.asked_date from t_asked a join qi using (question_id) join questions x on {_HAS_ANY.format(c="title, question_text, answer_text, department")}
     where qi.intent = 'questions' and not exists (select 1 from askers s where s.question_id = a.question_id))),
   q_by as (select question_id, 'questions' as intent, id, row_number() over (partition by question_id order by asked_date desc nulls last, id) as position from (select distinct a.question_id, x.id, x.asked_date from t_asked a join qi using (question_id) join askers s using (question_id)
     join questions x on {_HAS_ANY.format(c="title, question_text, answer_text, department")} and contains(lower(concat_ws(chr(10), asked_by_name, question_text)), lower(s.asker)) where qi.intent = 'questions')),
   found as (select * from q_plain union all select * from q_by union all {_newest_sql("bills", "bills", "title, bill_number, x.status", "year desc nulls last")} union all {_newest_sql("votes", "vote_events", "title, chamber, vote_type, result", "date desc nulls last")}
     union all {_newest_sql("politicians", "people", "full_name, display_name, slug, party", "display_name")} union all {_newest_sql("attendance", "att", "name_raw, attendance_status, title, committee_name", "date desc nulls last")}
     union all select question_id, 'hearings', mt.id, rank from mt join qi using (question_id) where intent = 'hearings'
     union all select question_id, 'parties', p.id, row_number() over (partition by question_id order by display_name, p.id) from party_of y join people p on p.party = y.short_name
     union all select question_id, 'committees', politician_id, row_number() over (partition by question_id order by role, politician_id) from seat_of s join memberships m on m.committee_id = s.id
     union all select question_id, 'profile', id, 1 from (select qi.question_id, psc.id, row_number() over (partition by qi.question_id order by psc.score desc, psc.id) as rn from qi join psc on psc.subject = trim(regexp_replace(regexp_replace(question, '^Who is ', ''), '\?$', '')) where intent = 'profile' and psc.score >= 50) where rn = 1),
   own as (select question_id, intent, id, position, 0 as part from found where position <= 8), cnt as (select question_id, count(*) as n from own group by 1),
   more as ({_newest_sql("politicians", "questions", "title, question_text, answer_text, department", "asked_date desc nulls last")}),
   extra as (select m.question_id, m.intent, m.id, m.position, 1 as part from more m left join cnt using (question_id) where coalesce(n, 0) < 3 and position <= 8)
   select question_id, intent, cast(id as varchar) as id, rank from (select *, row_number() over (partition by question_id order by part, position) as rank from (select * from own union all select * from extra)) where rank <= 8""")
def i15(t):
    return _routed(t)[1].select("question_id", "intent", "id", "rank")


@query("I16_answers")
def i16(t):
    """Answers of every kind; their sentences are unit-tested."""
    q = F.col("question")
    asks, routed = _routed(t)
    asks, routed = cut_lineage(asks), cut_lineage(routed)
    heard = cut_lineage(_person_rows(t))
    about = heard.select("question_id", F.col("position").alias("rank"), "title", F.col("date").cast("string").alias("date"), F.col("committee_name").alias("place"), "excerpt", "involvement", F.col("topic_excerpt").alias("summary"))
    hearings = asks.where("intent = 'hearings'").select("question_id")
    about = about.join(hearings, "question_id", "left_semi")
    sources = routed.join(about.select("question_id").distinct(), "question_id", "left_anti").unionByName(about, allowMissingColumns=True)
    subjects = asks.select("question_id", "intent", ev.person_subject(q, F.col("intent")).alias("who"), ev.titled_subject(q).alias("asker"), text.title_case(F.element_at(text.search_terms(q), -1)).alias("topic"))
    found = about.select("question_id").distinct().withColumn("_heard", F.lit(True))
    subjects = subjects.join(found, "question_id", "left").select("question_id", "topic", F.when(F.col("intent") == "questions", F.col("asker")).when(F.col("_heard"), F.col("who")).alias("subject"))
    counts = ev.activity_counts(t.people, t.questions, t.attendance, t.memberships)
    seats = t.memberships.join(t.committees.select(F.col("id").alias("committee_id"), "name"), "committee_id").groupBy(F.col("politician_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("committees"))
    first = routed.where("rank = 1 and intent = 'profile'").select("question_id", F.col("id").cast("bigint").alias("id"))
    profile = first.join(t.people.select("id", F.col("display_name").alias("name"), "full_name", "party"), "id").join(counts.select("id", F.col("questions").alias("question_count"), F.col("attendance").alias("attendance_count")), "id", "left").join(seats, "id", "left").drop("id")
    size = t.people.where("party is not null").groupBy("party").agg(F.count("*").alias("member_count"))
    party = ev.party_of_question(asks.where("intent = 'parties'").select("question_id", "question"), t.parties).join(size, "party", "left").select("question_id", F.col("party").alias("name"), "member_count", F.col("member_count").alias("linked_count"))
    asked = asks.where("intent = 'committees'").select("question_id", ev.committee_terms(q).alias("terms"))
    held = t.memberships.groupBy("committee_id").agg(F.count("*").alias("member_count"))
    committee = ev.committee_matches(asked, t.committees).join(t.committees.select(F.col("id").alias("committee_id"), "name"), "committee_id").join(held, "committee_id", "left").select("question_id", "name", "member_count")
    known = profile.unionByName(party, allowMissingColumns=True).unionByName(committee, allowMissingColumns=True)
    return answers.build(asks, sources, subjects.join(known, "question_id", "left"))


@query("I17_faithfulness", r"""with a as (select id, concat('I found ', display_name, ' of ', coalesce(party, 'no party'), case when id % 2 = 0 then concat(' – ', slug) else '' end) as answer, [display_name, upper(replace(slug, '-', ' '))] as req from people),
   n as (select id, trim(regexp_replace(lower(replace(answer, '–', '-')), '[^a-z0-9]+', ' ', 'g')) as x, list_transform(req, lambda r: trim(regexp_replace(lower(r), '[^a-z0-9]+', ' ', 'g'))) as rs from a)
   select id, len(list_filter(rs, lambda r: contains(x, r))) = len(rs) as faithful from n""")
def i17(t):
    answer = F.concat(F.lit("I found "), "display_name", F.lit(" of "), F.coalesce("party", F.lit("no party")), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" – "), "slug")).otherwise(""))
    return t.people.select("id", ev.is_faithful(answer, F.array("display_name", F.upper(F.replace("slug", F.lit("-"), F.lit(" "))))).alias("faithful"))


@query("I18_answer_cache", r"""select question_id, question_id % 2 = 0 and question_id % 3 <> 0 as hit, case when question_id % 2 = 0 and question_id % 3 <> 0 then 'cached' end as cached_answer from asks""")
def i18(t):
    snapshot = ev.data_snapshot({"politicians": t.people, "bills": t.bills})
    version = snapshot.select(F.sha2(F.to_json(F.struct("bills", "politicians")), 256)).first()[0]  # one value, the key of this data state
    marked = t.asks.withColumn("question", F.concat("question", F.lit(" #"), F.col("question_id").cast("string")))
    old = marked.where("question_id % 2 = 0")
    cache = old.select(ev.question_key(F.col("question")).alias("question_key"), F.when(F.col("question_id") % 3 == 0, "stale").otherwise(F.lit(version)).alias("snapshot"), F.lit("cached").alias("answer"))
    return ev.cache_lookup(marked, cache, snapshot).select("question_id", "hit", "cached_answer")


