"""Identity bootstrap and links between tables (E-11 … E-25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polislake.functions import names, text
from polislake.operators.merge import insert_only
from polislake.operators.resolve import from_index
from polislake.operators.tables import first_by_alternatives, longest_contained
from polislake.session import cut_lineage


def people_hints(attendance: DataFrame, questions: DataFrame) -> DataFrame:
    """E-11: one row per person slug with name, address and the party if all sources agree on it.

    Names are made readable once per distinct spelling, and both unions and
    counts combine before the shuffle.
    """
    att = attendance.groupBy("name_raw").agg(
        F.min("source_url").alias("source_url"), F.min("party_id").alias("p_min"), F.max("party_id").alias("p_max")
    ).withColumn("rank", F.lit(0))
    ask = questions.groupBy(F.col("asked_by_name").alias("name_raw")).agg(
        F.min("source_url").alias("source_url")
    ).withColumn("rank", F.lit(1))
    # Stored, as Catalyst would move the test for a name below the counts, to every row. Blank spellings give no name.
    spelled = cut_lineage(att.unionByName(ask, allowMissingColumns=True))
    named = spelled.withColumn("name", names.attendee_name(F.col("name_raw"))).where("name is not null")
    keyed = named.withColumn("slug", names.slug(F.col("name")))
    g = keyed.groupBy("slug").agg(
        F.min(F.struct("rank", "name_raw", "name", "source_url")).alias("b"), F.min("p_min").alias("_lo"), F.max("p_max").alias("_hi")
    )
    return g.select("slug", F.col("b.name").alias("full_name"), names.display_name(F.col("b.name")).alias("display_name"),
                    F.col("b.source_url").alias("profile_url"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("party_id"))


def committee_hints(documents: DataFrame) -> DataFrame:
    """E-12: committees named by documents, one per slug."""
    raw = documents.where(~text.is_blank(F.col("committee_name"))).groupBy("committee_name").agg(F.min("source_url").alias("source_url"))
    named = raw.withColumn("name", names.committee_name(F.col("committee_name"))).where("name <> ''").withColumn("slug", names.slug(F.col("name")))
    g = named.groupBy("slug").agg(F.min(F.struct("committee_name", "name", "source_url")).alias("b"))
    return g.select("slug", "b.name", "b.source_url")


def enrich_party(people: DataFrame, hints: DataFrame, party: str, unknown: object = None) -> DataFrame:
    """E-13: only the missing or unknown party gives way to an unambiguous one."""
    h = hints.select("slug", F.col("party_id").alias("_explicit"))
    df = people.join(h, "slug", "left")
    open_ = F.col(party).isNull() if unknown is None else (F.col(party).isNull() | (F.col(party) == unknown))
    take = open_ & F.col("_explicit").isNotNull()
    return df.withColumns({"enriched": take, party: F.when(take, F.col("_explicit")).otherwise(F.col(party))}).drop("_explicit")


def _committee_ref(facts: DataFrame, committees: DataFrame, raw: str, out: str) -> DataFrame:
    norm = names.committee_name(F.col(raw))
    return first_by_alternatives(
        facts, [names.slug(norm), F.lower(norm), F.lower(raw)], committees, [F.col("slug"), F.lower("name")], "id", out
    )


def link_meetings(meetings: DataFrame, documents: DataFrame, committees: DataFrame) -> DataFrame:
    """E-14: committee of every unlinked meeting by the first of four strategies that works."""
    todo = meetings.where("committee_id is null").select("id", "title", "committee_name", "source_url", "summary_document_id")
    docs = _committee_ref(documents.where("committee_name is not null").select("id", "source_url", "committee_name"), committees, "committee_name", "ref").where("ref is not null")
    by_doc = docs.groupBy(F.col("id").alias("summary_document_id")).agg(F.min("ref").alias("s1"))
    by_url = docs.groupBy("source_url").agg(F.min("ref").alias("s2"))
    df = todo.join(by_doc, "summary_document_id", "left").join(by_url, "source_url", "left")
    df = _committee_ref(df, committees, "committee_name", "s3")
    head = F.trim(F.substring_index("title", ":", 1))
    df = df.withColumn("_head", F.when(F.contains("title", F.lit(":")) & (F.length(head) >= 4), head))
    df = _committee_ref(df, committees, "_head", "s4")
    open_ = df.where(F.coalesce("s1", "s2", "s3", "s4").isNull()).select("id", "title")
    known = committees.select(F.col("id").alias("s5"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(names.committee_name(F.col("name")))))).alias("n"))
    inside = longest_contained(open_, "id", "title", known, "s5", "n", 6).select("id", "s5")
    df = df.join(inside, "id", "left")
    ref = F.coalesce("s1", "s2", "s3", "s4", "s5")
    strategy = (
        F.when(F.col("s1").isNotNull(), "summary_document").when(F.col("s2").isNotNull(), "same_url").when(F.col("s3").isNotNull(), "stored_name")
        .when(F.col("s4").isNotNull(), "title_prefix").when(F.col("s5").isNotNull(), "title_part")
    )
    return df.select("id", ref.alias("committee_id"), strategy.alias("strategy")).where("committee_id is not null")


def link_attendance(attendance: DataFrame, index: DataFrame) -> DataFrame:
    """E-15: person of every unlinked attendance row; the link lifts the confidence to 0.99."""
    found = from_index(attendance.where("politician_id is null"), index, "name_raw").where("person_id is not null")
    return found.withColumn("confidence", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.99)))


def memberships_from_attendance(attendance: DataFrame, meetings: DataFrame, memberships: DataFrame) -> DataFrame:
    """E-16: plain memberships implied by linked attendance and not stored yet."""
    m = meetings.where("committee_id is not null").select(F.col("id").alias("meeting_id"), "committee_id")
    pairs = attendance.where("politician_id is not null").join(m, "meeting_id").groupBy("politician_id", "committee_id").agg(F.min("source_url").alias("source_url"))
    return insert_only(memberships, pairs.withColumn("role", F.lit("Member")), ["politician_id", "committee_id", "role"])


def link_questions(questions: DataFrame, mentions: DataFrame, index: DataFrame) -> DataFrame:
    """E-17: person of every unlinked question: its only mention, else its asker."""
    todo = questions.where("politician_id is null").select("id", "asked_by_name")
    one = mentions.groupBy(F.col("question_id").alias("id")).agg(F.min("politician_id").alias("_lo"), F.max("politician_id").alias("_hi"))
    single = one.where("_lo = _hi").select("id", F.col("_lo").alias("by_mention"))
    df = from_index(todo, index, "asked_by_name").join(single, "id", "left")
    out = df.withColumn("linked_id", F.coalesce("by_mention", "person_id")).where("linked_id is not null")
    return out.select("id", "linked_id", F.when(F.col("by_mention").isNotNull(), "mention").otherwise("asker").alias("via"))


def link_vote_events(events: DataFrame, meetings: DataFrame, committees: DataFrame) -> DataFrame:
    """J-08 and J-10 in order: committee of a vote by the meeting's address, else by its title."""
    m = meetings.where("committee_id is not null").groupBy("source_url").agg(F.min("committee_id").alias("by_url"))
    todo = events.where("committee_id is null").select("id", "title", "source_url").join(m, "source_url", "left")
    known = committees.select(F.col("id").alias("by_title"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(names.committee_name(F.col("name")))))).alias("n"))
    inside = longest_contained(todo.where("by_url is null").select("id", "title"), "id", "title", known, "by_title", "n", 4).select("id", "by_title")
    out = todo.join(inside, "id", "left").withColumn("linked_id", F.coalesce("by_url", "by_title")).where("linked_id is not null")
    return out.select("id", "linked_id", F.when(F.col("by_url").isNotNull(), "url").otherwise("title").alias("via"))


def hint_count(documents: DataFrame, attendance: DataFrame, questions: DataFrame) -> DataFrame:
    """E-18: distinct identity hints the bootstrap will look at."""
    parts = [(documents, "committee_name"), (attendance, "name_raw"), (questions, "asked_by_name")]
    rows = None
    for df, c in parts:
        one = df.where(F.coalesce(c, F.lit("")) != "").agg(F.count_distinct(c).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.sum("n").alias("hints"))


def parties_from_names(facts: DataFrame, party: str, parties: DataFrame) -> DataFrame:
    """E-21: stored party of an explicit name, or the new party row it calls for."""
    raw = facts.select(party).where(~text.is_blank(F.col(party))).distinct()
    norm = raw.withColumn("_p", names.party(F.col(party))).select(party, F.col("_p.name").alias("name"), F.col("_p.short_name").alias("short_name")).where("short_name <> 'UNKNOWN'")
    out = first_by_alternatives(
        norm, [F.lower("short_name"), F.lower("name"), F.lower(party)], parties, [F.lower("short_name"), F.lower("name")], "id", "party_id"
    )
    return out.withColumn("is_new", F.col("party_id").isNull())


def step_counts(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """E-25: one count row per step."""
    out = None
    for i, (name, df) in enumerate(steps):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("position"), F.lit(name).alias("step"), "n")
        out = row if out is None else out.unionByName(row)
    return out
