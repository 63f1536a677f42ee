"""Evidence for plain-language questions, many questions at once (I-*, A-17, A-18, D-08)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import names, text
from polislake.operators.tables import contained, top_k
from polislake.session import cut_lineage, if_small

# How much a kind of evidence is trusted, best first.
EVIDENCE_RANK = {"politician_party_link": 0, "committee_attendance_party_link": 1, "parliamentary_question_party_label": 2}


def activity_counts(people: DataFrame, questions: DataFrame, attendance: DataFrame, memberships: DataFrame) -> DataFrame:
    """A-17: per person, how many questions, attendance rows and memberships are linked."""
    out = people.select("id")
    for name, child in (("questions", questions), ("attendance", attendance), ("memberships", memberships)):
        n = child.where("politician_id is not null").groupBy(F.col("politician_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(n, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def data_snapshot(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A-18: the row counts of the tables in one row, the version key of cached answers."""
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name in tables])


def merge_party_members(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D-08: one row per person, the most trusted evidence kept.

    ``keys`` are further grouping columns, such as the question asked.
    """
    rank = F.create_map(*[F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv])
    named = rows.withColumn("name", text.clean_display(F.col("name"))).withColumn("key", F.array_join(names.name_tokens(F.col("name")), " "))
    order = [F.coalesce(F.try_element_at(rank, F.col("evidence")), F.lit(9)), F.col("id")]
    return top_k(named.where("key <> ''"), [*keys, "key"], order, 1)


# --------------------------------------------------------------------------- understanding the question


def normalize_question(q: Column, shown: int | None = 500) -> Column:
    """I-01: collapsed, lower case, the first ``shown`` characters."""
    whole = F.regexp_replace(F.lower(F.trim(q)), r"\s+", " ")
    return whole if shown is None else F.left(whole, F.lit(shown))


def question_key(q: Column) -> Column:
    """Key of a question in the answer cache: a hash of its whole normal form."""
    return F.sha2(normalize_question(q, None), 256)


def intent(q: Column) -> Column:
    """I-02: nine intents, the first rule that fits."""
    t = F.lower(q)
    any_of = lambda *w: text.contains_any(t, w)
    asks_people = t.rlike(r"\b(how many|who|which|name|list|people|mps?|members?)\b")
    of_party = t.rlike(r"\b(party|parties|member|members|belong|belongs)\s+(?:of|to|in)\b|\bmembers?\s+of\b|\bfrom\s+the\b")
    return (
        F.when(t.rlike(r"\b(who is|who's|tell me about|profile of|what is known about)\b"), "profile").when(asks_people & of_party, "parties")
        .when(any_of("hearing", "enquiry", "inquiry", "testimony", "testified", "briefing"), "hearings")
        .when(any_of("question", "asked", " ask ", "minister", "department"), "questions")
        .when(any_of("attendance", "attend", "absent", "apology", "present"), "attendance")
        .when(any_of("committee", "sits on", "sit on", "serve on", "serves on"), "committees")
        .when(any_of("bill", "act", "legislation"), "bills").when(any_of("vote", "division"), "votes").otherwise("politicians")
    )


def action(q: Column) -> Column:
    """I-03: what the question asks to find out."""
    t = F.lower(q)
    return (
        F.when(t.rlike(r"\b(ask|asked|question|questions|say|said|raised|intervention|interventions)\b"), "spoken_question")
        .when(t.rlike(r"\b(attend|attended|present|absent|apology|apologies)\b"), "attendance").when(t.rlike(r"\b(vote|voted|division)\b"), "vote")
        .when(t.rlike(r"\b(sit|sits|serve|serves|served|member)\b"), "membership").otherwise("general")
    )


# Wordings around the person a question is about, in order.
SUBJECT_PATTERNS = [
    r"\bwhat\s+did\s+(.+?)\s+(?:ask|say|raise)\b", r"\bwhat\s+has\s+(.+?)\s+(?:asked|said|raised|done)\b",
    r"\bdid\s+(.+?)\s+(?:ask|say|raise|attend|vote)\b", r"\bwhich\s+questions\s+did\s+(.+?)\s+ask\b",
    r"\bwhere\s+was\s+(.+?)\s+(?:present|absent)\b", r"\b(?:attendance|profile|record)\s+for\s+(.+?)(?:\?|$)",
]
TITLED_NAME = r"\b((?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\s+[A-Z][A-Za-z .'-]{0,90}?(?:\s+\([A-Za-z0-9 +.-]+\))?)(?=\s+(?:ask|asked|asks|question|questions|about)\b|\?|$)"


def titled_subject(q: Column) -> Column:
    return F.nullif(text.collapse(F.regexp_extract(q, TITLED_NAME, 1)), F.lit(""))


def profile_subject(q: Column) -> Column:
    t = F.regexp_replace(F.trim(q), r"(?i)^\s*(?:who is|who's|tell me about|profile of|what is known about)\s+", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\?\s*$", "")), F.lit(""))


def person_subject(q: Column, kind: Column) -> Column:
    """I-04: the person the question is about, NULL if none is named."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(q, "(?i)" + p, 1), F.lit("")) for p in SUBJECT_PATTERNS])
    clean = text.strip_chars(text.collapse(F.regexp_replace(found, r"\([^)]+\)", " ")), " ?.,")
    clean = text.let(clean, lambda c: F.when((F.lower(c) == c) & (F.upper(c) != c), text.title_case(c)).otherwise(F.nullif(c, F.lit(""))))
    return F.coalesce(clean, F.when(kind == "profile", profile_subject(q)).otherwise(titled_subject(q)))


def asker_terms(q: Column) -> Column:
    """Full name and surname of a titled person in the question."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(titled_subject(q), F.lit("")), r"\([^)]+\)", ""), r"(?i)^(?:Mr|Ms|Mrs|Dr|Adv|Prof|Hon)\s+", "")
    words = F.regexp_extract_all(bare, F.lit(r"([A-Za-z][A-Za-z'-]{2,})"), F.lit(1))
    return text.let(words, lambda w: F.when(F.size(w) > 0, F.array_distinct(F.array(F.array_join(w, " "), F.element_at(w, -1)))).otherwise(F.array().cast("array<string>")))


def topic_terms(q: Column) -> Column:
    """I-06: terms of the about clause, else all terms but the asker's words."""
    about = F.regexp_replace(F.regexp_extract(q, r"(?i)\babout\s+(.+?)(?:\?|$)", 1), r"\([^)]+\)", " ")
    who = F.transform(F.flatten(F.transform(asker_terms(q), lambda a: F.split(a, " "))), F.lower)
    words = text.let(about, lambda a: text.search_terms(F.when(a != "", a).otherwise(q)))
    return text.let(words, lambda ws: F.when(about != "", ws).otherwise(text.let(who, lambda w: F.filter(ws, lambda x: ~F.array_contains(w, F.lower(x))))))


def hearing_terms(q: Column) -> Column:
    """I-06: topic terms of a hearing question."""
    words = "what|did|does|ask|asked|question|questions|in|during|at|the|hearing|hearings|enquiry|inquiry|testimony|testified|briefing|lieutenant|general"
    return text.search_terms(text.collapse(F.regexp_replace(q, rf"(?i)\b({words})\b", " ")))


def committee_terms(q: Column) -> Column:
    """I-06: topic terms of a committee question."""
    words = "who|which|mps?|members?|sits?|serves?|served|serve|on|the|committee|committees|of"
    return text.search_terms(text.collapse(F.regexp_replace(q, rf"(?i)\b({words})\b", " ")))


def person_aliases(subject: Column) -> Column:
    """I-07: spellings to look for when a person is named by ``subject``."""

    def forms(tokens: Column) -> Column:
        surname = text.title_case(F.element_at(tokens, -1))
        initials = F.array_join(F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), lambda x: F.upper(F.left(x, F.lit(1)))), " ")
        more = F.size(tokens) > 1
        titles = [F.concat(F.lit(f"{x} "), surname) for x in ("Mr", "Ms", "Mrs", "Dr")]
        full = [F.when(more, F.concat(initials, F.lit(" "), surname))] + [F.when(more, F.concat(F.lit(f"{x} "), initials, F.lit(" "), surname)) for x in ("Mr", "Ms")]
        return F.array(surname, *titles, *full)

    spelled = text.let(names.name_tokens(subject), lambda tk: F.when(F.size(tk) > 0, forms(tk)))
    return text.unique_values(F.array_compact(F.concat(F.array(text.clean_display(subject)), F.coalesce(spelled, F.array().cast("array<string>")))))


# --------------------------------------------------------------------------- retrieval

_TOKEN = r"([a-z0-9+-]+)"


def term_hits(corpus: DataFrame, key: str, columns: Sequence[str], terms: DataFrame) -> DataFrame:
    """Documents holding a term anywhere, case aside: ``(term, key, exact)``.

    A term is made of letters, digits, plus and hyphen, so it can only occur
    inside a run of those. The terms are looked up in the distinct runs of the
    corpus (its word list), never in every document. ``exact`` tells that the
    term is a whole run. Terms of several words are verified on the text. Hits
    are stored: both kinds of terms read them, and the driver would otherwise
    hold the stages of all searches of a query at once.
    """
    body = F.lower(F.concat_ws("\n", *columns))
    toks = corpus.select(F.col(key).alias("_doc"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(1)))).alias("_tok"))
    runs = F.regexp_extract_all(F.lower("term"), F.lit(_TOKEN), F.lit(1))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r")))), 1)["r"]
    wanted = terms.select("term").distinct().withColumn("_name", F.when(F.size(runs) > 0, longest)).where("_name is not null")
    words = contained(toks.select("_tok").distinct(), "_tok", "_tok", wanted.select("_name").distinct(), 1).distinct()
    # Where few words are looked for, the runs of the corpus stay where they are read.
    pairs = toks.join(if_small(cut_lineage(words.join(wanted, "_name"))), "_tok")
    hits = cut_lineage(pairs.groupBy("term", "_doc").agg(F.bool_or(F.col("_tok") == F.lower("term")).alias("exact")))
    single = F.lower("term").rlike(r"^[a-z0-9+-]+$")
    phrases = hits.where(~single).join(corpus.select(F.col(key).alias("_doc"), body.alias("_b")), "_doc").where(F.contains("_b", F.lower("term"))).drop("_b")
    return hits.where(single).unionByName(phrases).withColumnRenamed("_doc", key)


def newest_sources(asked: DataFrame, hits: DataFrame, corpus: DataFrame, key: str, order: Sequence[Column], k: int = vocab.MAX_SOURCES, among: Sequence[str] = ()) -> DataFrame:
    """I-08/I-09: per question the first ``k`` documents that hold any of its terms.

    ``asked`` is ``(question_id, term)``. The first ``k`` documents of a union
    are among the first ``k`` of its parts, so hits are cut to ``k`` per term
    before questions join them; a term asked by a third of all questions or
    held by a third of all documents stays small.
    """
    keep = [key, *among]
    ranked = hits.join(corpus.select(*keep), key)
    per_term = top_k(ranked, ["term"], [*order, F.col(key)], k)
    pairs = asked.select("question_id", "term").distinct().join(per_term.select("term", *keep), "term").drop("term").distinct()
    return top_k(pairs, ["question_id"], [*order, F.col(key)], k, rank="position")


def attendance_sources(asked: DataFrame, attendance: DataFrame, meetings: DataFrame, k: int = vocab.MAX_SOURCES) -> DataFrame:
    """I-09: attendance rows that hold a term themselves or whose meeting does, of the newest meetings first."""
    held = attendance.join(meetings.select(F.col("id").alias("meeting_id"), "date"), "meeting_id").select("id", "meeting_id", "date")
    own = term_hits(attendance, "id", ["name_raw", "attendance_status"], asked).select("term", "id").join(held, "id")
    met = term_hits(meetings, "id", ["title", "committee_name"], asked).select("term", F.col("id").alias("meeting_id")).join(held, "meeting_id")
    order = [F.desc_nulls_last("date"), F.col("id")]
    per_term = top_k(own.select("term", "id", "date").unionByName(met.select("term", "id", "date")).distinct(), ["term"], order, k)
    pairs = asked.select("question_id", "term").distinct().join(per_term, "term").drop("term").distinct()
    return top_k(pairs, ["question_id"], order, k, rank="position")


def question_sources(asked: DataFrame, askers: DataFrame, corpus: DataFrame, hits: DataFrame, asker_hits: DataFrame, key: str, order: Sequence[Column], among: Sequence[str], k: int = vocab.MAX_SOURCES) -> DataFrame:
    """I-08 with askers: a topic term and an asker term must both occur.

    The pairs of terms in use are few and shared between questions; each pair
    is answered once, starting from the rarer asker side.
    """
    combos = asked.select("question_id", "term").join(askers.select("question_id", F.col("term").alias("asker")), "question_id")
    distinct = combos.select("term", "asker").distinct()
    from_asker = distinct.join(asker_hits.select(F.col("term").alias("asker"), key), "asker")
    both = from_asker.join(hits.select("term", key), ["term", key], "left_semi").join(corpus.select(key, *among), key)
    best = top_k(both, ["term", "asker"], [*order, F.col(key)], k)
    pairs = combos.join(best, ["term", "asker"]).select("question_id", key, *among).distinct()
    return top_k(pairs, ["question_id"], [*order, F.col(key)], k, rank="position")


def meeting_scores(asked: DataFrame, hits: DataFrame, corpus: DataFrame, key: str, order: Sequence[Column], among: Sequence[str], k: int = vocab.MAX_SOURCES) -> DataFrame:
    """I-12: relevance of all matching meetings; strong hits if any, else all hits, the best ``k``, newer ones first.

    Questions of the same terms are scored once; a meeting's score is a sum
    that combines before the shuffle. The strongest hit comes first, so the
    best ``k`` tell whether there is a strong one.
    """
    sets = asked.groupBy("question_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    weight = F.when(F.col("exact") & (F.length("term") >= 6), 3).otherwise(1)
    wanted = sets.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    scored = wanted.join(hits.withColumn("_w", weight), "term").groupBy("terms", key).agg(F.sum("_w").alias("score")).join(corpus.select(key, *among), key)
    best = top_k(scored, ["terms"], [F.desc("score"), *order, F.col(key)], k, rank="rank")
    strong = best.where("rank = 1 and score >= 2").select("terms").withColumn("_strong", F.lit(True))
    kept = best.join(strong, "terms", "left").where((F.col("score") >= 2) | F.col("_strong").isNull())
    return sets.join(kept, "terms").select("question_id", key, "score", "rank")


def committee_matches(asked: DataFrame, committees: DataFrame) -> DataFrame:
    """I-10: best committee per term list: 100 if its name holds all terms, 70 if it holds one."""
    sets = asked.select("question_id", F.array_sort(F.array_distinct(F.transform("terms", F.lower))).alias("ts")).where("size(ts) > 0")
    term_rows = sets.select("ts").distinct().select("ts", F.explode("ts").alias("tok"))
    name_rows = committees.select(F.col("id").alias("committee_id"), F.explode(F.array_distinct(names.name_tokens(F.col("name")))).alias("tok"))
    n = term_rows.join(name_rows, "tok").groupBy("ts", "committee_id").agg(F.count("*").alias("n"))
    score = F.when(F.col("n") == F.size("ts"), 100).otherwise(70)
    best = n.groupBy("ts").agg(F.min(F.struct((-score).alias("s"), F.col("committee_id"))).alias("b"))
    return sets.join(best, "ts").select("question_id", "b.committee_id", (-F.col("b.s")).alias("score"))


def party_of_question(asked: DataFrame, parties: DataFrame) -> DataFrame:
    """I-11: party named by a question: whole-word hit of a name, longest short name first, else a shared word."""
    from polislake.operators.mentions import word_hits

    forms = parties.select("short_name", F.explode(F.array(F.lower("short_name"), F.lower("name"))).alias("_key")).where("_key <> ''")
    keyed = forms.groupBy("_key").agg(F.min(F.struct((-F.length("short_name")).alias("l"), "short_name")).alias("b"))
    hits = word_hits(asked, "question_id", "question", keyed.select("_key"), shown=False).join(keyed, "_key")
    exact = hits.groupBy(F.col("_tid").alias("question_id")).agg(F.min("b").alias("b")).select("question_id", F.col("b.short_name").alias("exact"))
    words = parties.select("short_name", F.explode(F.concat(F.array(F.lower("short_name")), names.name_tokens(F.col("name")))).alias("term")).groupBy("term").agg(F.min("short_name").alias("short_name"))
    loose = asked.select("question_id", F.explode(text.search_terms(F.col("question"))).alias("term")).join(words, "term").groupBy("question_id").agg(F.min("short_name").alias("loose"))
    return asked.select("question_id").join(exact, "question_id", "left").join(loose, "question_id", "left").select("question_id", F.coalesce("exact", "loose").alias("party")).where("party is not null")


def profile_matches(subjects: DataFrame, people: DataFrame, aliases: DataFrame) -> DataFrame:
    """I-14: best person per subject: 100 same words, 90 all words, 80 surname and initial, 65 surname.

    Every score of 50 or more shares the subject's last word with the name, so
    each tier is an equi-join against a dictionary with one row per key: the
    words in order, single words, and last word with initial. Only the tier
    "all of several words" looks at candidates, by the subject's rarest word.
    """
    forms = people.select("id", F.explode(F.array("full_name", "display_name", F.replace("slug", F.lit("-"), F.lit(" ")))).alias("f")).unionByName(aliases.select(F.col("person_id").alias("id"), F.col("alias").alias("f")))
    toks = forms.select("id", names.name_tokens(F.col("f")).alias("t")).where("size(t) > 0").distinct()
    subj = subjects.select("subject").distinct().withColumn("q", names.name_tokens(F.col("subject"))).where("size(q) > 0")
    last, first = F.element_at("q", -1), F.element_at("q", 1)
    same = toks.groupBy(F.array_join("t", " ").alias("k")).agg(F.min("id").alias("p100"))
    single = toks.select("id", F.explode("t").alias("k"), F.left(F.element_at("t", 1), F.lit(1)).alias("i"))
    word = single.groupBy("k").agg(F.min("id").alias("p65"), F.count_distinct("id").alias("freq"))
    initial = single.groupBy("k", "i").agg(F.min("id").alias("p80"))
    df = subj.join(same.withColumnRenamed("k", "_k100"), F.array_join("q", " ") == F.col("_k100"), "left")
    df = df.join(word.select(F.col("k").alias("_k65"), "p65"), last == F.col("_k65"), "left")
    df = df.join(initial.select(F.col("k").alias("_k80"), "i", "p80"), (last == F.col("_k80")) & (F.left(first, F.lit(1)) == F.col("i")), "left")
    several = subj.where("size(q) > 1").select("subject", "q", F.explode("q").alias("k")).join(word.select("k", "freq"), "k")
    rare = several.groupBy("subject", "q").agg(F.min(F.struct("freq", "k")).alias("b")).select("subject", "q", F.col("b.k").alias("k"))
    wide = toks.select("id", "t", F.explode(F.array_distinct("t")).alias("k"))
    all_words = rare.join(wide, "k").where(F.size(F.array_except("q", "t")) == 0).groupBy("subject").agg(F.min("id").alias("p90"))
    df = df.join(all_words, "subject", "left").withColumn("p90", F.when(F.size("q") == 1, F.col("p65")).otherwise(F.col("p90")))
    score = F.when(F.col("p100").isNotNull(), 100).when(F.col("p90").isNotNull(), 90).when(F.col("p80").isNotNull(), 80).when(F.col("p65").isNotNull(), 65)
    return df.select("subject", F.coalesce("p100", "p90", "p80", "p65").alias("person_id"), score.alias("score")).where("person_id is not null")


def involvement(contexts: Column, status: Column) -> Column:
    """I-13: what a person did at a meeting, by the words around the name, else by attendance."""
    low = F.lower(F.array_join(contexts, " "))
    return (
        F.when(low.rlike(r"\b(apology|apologies|apologised|prior commitment|prior commitments)\b"), "apology")
        .when(low.rlike(r"\b(asked|questioned|enquired|wanted to know|sought clarity|raised|said|submitted|proposed)\b"), "intervention")
        .when(F.lower(status).isin("present", "absent", "apology"), F.lower(status)).when(F.size(contexts) > 0, "mentioned").otherwise("not_found")
    )


# Order of involvement in an answer.
INVOLVEMENT_RANK = {"intervention": 0, "present": 1, "mentioned": 2, "apology": 3, "absent": 4, "not_found": 5}


def person_meetings(matched: DataFrame, meetings: DataFrame, attendance: DataFrame, k: int = vocab.MAX_SOURCES) -> DataFrame:
    """I-13: involvement of the asked person at each matched meeting.

    ``matched`` is ``(question_id, id, subject, person_id, aliases)``, at most
    ``k`` meetings per question. Attendance counts where it is linked to the
    person, else where its name holds one of the person's spellings.
    """
    from polislake.operators.extract import person_contexts, topic_excerpt

    df = matched.join(meetings.select("id", "title", "date", "committee_name", "summary"), "id")
    rows = attendance.select(F.col("meeting_id").alias("id"), F.col("id").alias("_row"), "politician_id", "name_raw", "attendance_status")
    linked = rows.where("politician_id is not null").groupBy("id", F.col("politician_id").alias("person_id")).agg(F.min_by(F.struct("attendance_status", "name_raw"), "_row").alias("linked"))
    wanted = matched.select("question_id", "id", F.transform("aliases", F.lower).alias("_forms"))
    named = rows.join(wanted, "id").where(F.exists("_forms", lambda a: F.contains(F.lower("name_raw"), a) & (a != "")))
    named = named.groupBy("question_id", "id").agg(F.min_by(F.struct("attendance_status", "name_raw"), "_row").alias("named"))
    df = df.join(linked, ["id", "person_id"], "left").join(named, ["question_id", "id"], "left")
    df = df.withColumns({"_seen": F.coalesce("linked", "named"), "contexts": person_contexts(F.col("summary"), F.col("aliases"))})
    df = df.withColumns({"status": F.col("_seen.attendance_status"), "attendance_name": F.col("_seen.name_raw"), "involvement": involvement(F.col("contexts"), F.col("_seen.attendance_status"))})
    recorded = F.concat(F.coalesce("attendance_name", "subject"), F.lit(" recorded as "), "status", F.lit("."))
    df = df.withColumns({"excerpt": text.excerpt(F.coalesce(F.get("contexts", F.lit(0)), recorded)), "topic_excerpt": topic_excerpt(F.col("summary"), F.col("aliases"))})
    rank = F.create_map(*[F.lit(x) for kv in INVOLVEMENT_RANK.items() for x in kv])
    order = [F.element_at(rank, F.col("involvement")), F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("id")]
    return top_k(df.drop("_seen", "linked", "named"), ["question_id"], order, k, rank="position")


# --------------------------------------------------------------------------- answers

# What the reader should know about the completeness of each kind of evidence.
NOTICES = {
    "questions": "Parliamentary Questions coverage is still being backfilled, so this answer may not include every historical question.",
    "committees": "Committee records show currently imported and linked committees; historical links may still be improving.",
    "attendance": "Attendance records cover explicit PMG attendance rows linked so far and should not be read as a complete attendance rate yet.",
    "bills": "Bills coverage is PMG-backed and may omit records not yet linked from source backfills.",
    "votes": "Vote data is source-backed where available, but individual vote records remain incomplete.",
    "profile": "This profile answer uses only source-backed identity and activity records currently linked in production.",
    "parties": "Party membership answers use politicians currently linked to party records; historical or not-yet-enriched party links may still be incomplete.",
    "hearings": "Committee hearing answers use imported PMG meeting records; verbatim exchanges are available only where the source record includes them.",
    "politicians": "MP identity records are source-backed, while party and committee links continue to improve through scheduled backfills.",
}


def route(understood: DataFrame, evidence: DataFrame, fallback: DataFrame, k: int = vocab.MAX_SOURCES) -> DataFrame:
    """I-15: evidence of each question's own intent; people questions with fewer than three sources take questions too.

    ``evidence`` is ``(question_id, intent, position, title, date, excerpt)``,
    at most ``k`` rows per question and intent.
    """
    own = understood.select("question_id", "intent").join(evidence, ["question_id", "intent"]).withColumn("part", F.lit(0))
    n = own.groupBy("question_id").agg(F.count("*").alias("n"))
    thin = understood.where("intent = 'politicians'").join(n, "question_id", "left").where("coalesce(n, 0) < 3").select("question_id", "intent")
    extra = thin.join(fallback.drop("intent"), "question_id").withColumn("part", F.lit(1))
    rows = own.unionByName(extra, allowMissingColumns=True)
    return top_k(rows, ["question_id"], [F.col("part"), F.col("position")], k, rank="rank").drop("part", "position")


def faithful_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text.clean_display(c)), "[^a-z0-9]+", " "))


def is_faithful(answer: Column, required: Column) -> Column:
    """I-17: every required term occurs in the answer, punctuation and case aside."""
    return text.let(faithful_form(answer), lambda a: F.forall(required, lambda r: F.contains(a, faithful_form(r))))


def cache_lookup(asked: DataFrame, cache: DataFrame, snapshot: DataFrame) -> DataFrame:
    """I-18: a cached answer counts only for the same wording and the same data snapshot."""
    version = snapshot.select(F.sha2(F.to_json(F.struct(*sorted(snapshot.columns))), 256).alias("snapshot"))
    valid = cache.join(version, "snapshot", "left_semi").select("question_key", F.col("answer").alias("cached_answer"), F.lit(True).alias("_hit"))
    q = asked.withColumn("question_key", question_key(F.col("question")))
    return q.join(valid, "question_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
