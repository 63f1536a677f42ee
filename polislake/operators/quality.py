"""Quality, coverage and readiness reports as metric tables (Q-*, R-*).

A report is one conditional-aggregate pass per table plus one anti join per
presence question; the passes are small tables of ``(metric, value)`` rows by
the time they meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions.text import is_blank
from polislake.operators.tables import as_metric_rows, duplicate_groups, metrics, pct, without_child

SEVERITY = {"pass": 0, "warn": 1, "fail": 2}


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def counter_rows(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """A-02 as ``(metric, value)`` rows."""
    return as_metric_rows(metrics(df, counters))


def count_row(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "value")


def always() -> Column:
    return F.lit(True)


def quality_summary(x: Mapping[str, DataFrame]) -> DataFrame:
    """Q-01: counters over all record tables, one row per metric."""
    pmg = F.startswith("document_type", F.lit("PMG"))
    people, docs, q = x["people"], x["docs"], x["questions"]
    repeated_slugs = count_row(duplicate_groups(people, "slug"), "slugs")
    return union_all([
        count_row(x["aliases"], "total_aliases"), count_row(x["question_mentions"], "total_question_mentions"),
        counter_rows(people, {
            "total_politicians": always(), "active_politicians": F.col("is_active"), "inactive_politicians": ~F.col("is_active"),
            "unknown_status_politicians": F.col("source_status").isNull() | (F.col("source_status") == "UNKNOWN"), "politicians_without_party": F.col("party").isNull(),
        }),
        counter_rows(docs, {
            "total_documents": always(), "total_pmg_documents": pmg, "pmg_documents_without_archive_path": pmg & F.col("archive_path").isNull(),
            "documents_without_archive_path": F.col("archive_path").isNull(),
        }),
        counter_rows(q, {
            "total_parliamentary_questions": always(), "parliamentary_questions_without_politician": F.col("politician_id").isNull(),
            "parliamentary_questions_without_answer": F.col("answer_text").isNull(), "parliamentary_questions_without_archive_path": F.col("archive_path").isNull(),
            "parliamentary_question_pdf_sources": F.col("source_file_type") == "PDF", "parliamentary_question_parse_failed": F.col("parse_status") == "FAILED",
            "parliamentary_question_parse_partial": F.col("parse_status") == "PARTIAL",
        }),
        counter_rows(x["unresolved"], {"total_unresolved_entities": always(), "unresolved_entities_count": always(), **{f"unresolved_entities_{s.lower()}": F.col("status") == s for s in ("OPEN", "RESOLVED", "IGNORED")}}),
        count_row(x["parties"], "total_parties"), count_row(x["committees"], "total_committees"), count_row(x["memberships"], "total_committee_memberships"),
        count_row(x["mentions"], "total_document_mentions"), count_row(x["runs"], "total_ingestion_runs"), count_row(x["run_errors"], "total_ingestion_errors"),
        counter_rows(without_child(people.select("id", "is_active"), x["memberships"], "id", "politician_id"), {"politicians_without_committees": always(), "active_politicians_without_committees": F.col("is_active")}),
        count_row(without_child(x["committees"].select("id"), x["memberships"], "id", "committee_id"), "committees_without_memberships"),
        counter_rows(without_child(docs.select("id", "document_type"), x["mentions"], "id", "document_id"), {"documents_without_mentions": always(), "pmg_documents_without_mentions": pmg}),
        repeated_slugs.withColumn("metric", F.explode(F.array(F.lit("duplicate_politician_slug_count"), F.lit("duplicate_slug_count")))), count_row(duplicate_groups(x["committees"], "slug"), "duplicate_committee_slug_count"),
        count_row(duplicate_groups(x["parties"], "short_name"), "duplicate_party_short_name_count"), count_row(duplicate_groups(docs, "source_url"), "duplicate_source_url_count"),
        count_row(duplicate_groups(x["memberships"], "politician_id", "committee_id", "role"), "duplicate_membership_candidates"),
    ])


def quality_issues(x: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Q-02: every issue list, whole, or its first ``limit`` rows by label."""

    facts = ("source_url", "entity_type", "source_name")

    def listed(issue: str, df: DataFrame, label: str, *order: Column) -> DataFrame:
        first = df if limit is None else df.orderBy(*(order or (F.col(label),)), "id").limit(limit)
        # The address and kind of the record, where its table has them.
        more = [(F.col(c) if c in df.columns and issue.split("_")[0] in ("documents", "unresolved") else F.lit(None)).cast("string").alias(c) for c in facts]
        return first.select(F.lit(issue).alias("issue"), F.col("id").cast("string").alias("item"), F.col(label).alias("label"), *more)

    def repeated(issue: str, df: DataFrame, col: str) -> DataFrame:
        groups = duplicate_groups(df, col)
        if limit is not None:
            groups = groups.orderBy(F.desc("n"), col).limit(limit)
        return groups.select(F.lit(issue).alias("issue"), F.col(col).alias("item"), F.col("n").cast("string").alias("label"))

    people, memb = x["people"], x["memberships"]
    return union_all([
        listed("politicians_without_party", people.where("party is null"), "display_name"),
        listed("active_politicians_without_committees", without_child(people.where("is_active"), memb, "id", "politician_id"), "display_name"),
        listed("committees_without_memberships", without_child(x["committees"], memb, "id", "committee_id"), "name"),
        listed("documents_without_mentions", without_child(x["docs"], x["mentions"], "id", "document_id"), "title"),
        listed("unresolved_entities_open", x["unresolved"].where("status = 'OPEN'"), "raw_value", F.desc("created_at")),
        repeated("duplicate_politician_slugs", people, "slug"), repeated("duplicate_committee_slugs", x["committees"], "slug"), repeated("duplicate_party_short_names", x["parties"], "short_name"),
    ])


def check(category: str, name: str, df: DataFrame, value: Column, warn: Column | None, fail: Column | None) -> DataFrame:
    """One check row from a one-row table; conditions see the value as ``v``."""
    status = F.lit("pass")
    if warn is not None:
        status = F.when(warn, "warn").otherwise(status)
    if fail is not None:
        status = F.when(fail, "fail").otherwise(status)
    return df.select(value.cast("double").alias("v")).select(F.lit(category).alias("category"), F.lit(name).alias("name"), F.col("v").alias("value"), status.alias("status"))


V = "v"


def checks_of(specs: Mapping[str, tuple[DataFrame, Column]], category: str, verdict) -> DataFrame:
    """Check rows of one category, every table scanned once.

    ``specs``: name to table and aggregate; ``verdict(name, value)`` gives the status.
    """
    tables: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, value) in specs.items():
        tables.setdefault(id(df), (df, []))[1].append((name, value))
    parts = []
    for df, values in tables.values():
        one = df.agg(*[value.cast("double").alias(f"v{i}") for i, (_, value) in enumerate(values)])
        rows = [F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), F.col(f"v{i}").alias("value"), verdict(name, F.col(f"v{i}")).alias("status")) for i, (name, _) in enumerate(values)]
        parts.append(one.select(F.inline(F.array(*rows))))
    return union_all(parts)


def unresolved_check(unresolved: DataFrame) -> DataFrame:
    """Q-10: open queue entries, warn above none, fail above fifty."""
    df = unresolved.agg(F.count_if(F.col("status") == "OPEN").alias("n"))
    return check("unresolved_entities", "open unresolved entities", df, F.col("n"), F.col(V) > 0, F.col(V) > vocab.UNRESOLVED_FAIL_ABOVE)


def run_checks(runs: DataFrame, now: str) -> DataFrame:
    """Q-07: failed lately, stuck, and sources without a recent completed run."""
    t = F.lit(now).cast("timestamp_ntz")
    started = F.col("started_at")
    df = runs.agg(
        F.count_if((F.col("status") == "failed") & (started >= t - F.expr(f"interval {vocab.FAILED_RUN_DAYS} days"))).alias("failed"),
        F.count_if((F.col("status") == "running") & (started < t - F.expr(f"interval {vocab.STUCK_HOURS} hours"))).alias("stuck"),
    )
    last = runs.groupBy("source_name").agg(F.max(F.when(F.col("status") == "completed", started)).alias("last"))
    stale = last.agg(F.count_if(F.col("last").isNull() | (F.col("last") < t - F.expr(f"interval {vocab.STALE_DAYS} days"))).alias("n"))
    return union_all([
        check("ingestion_runs", "failed ingestion runs", df, F.col("failed"), F.col(V) > 0, None),
        check("ingestion_runs", "stuck ingestion runs", df, F.col("stuck"), None, F.col(V) > 0),
        check("stale_data", "stale ingestion sources", stale, F.col("n"), F.col(V) > 0, None),
    ])


def orphan_checks(specs: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Q-06: share of rows without a link, warn above 10 %, fail above 50 %."""
    shares = {name: (df, pct(F.count_if(F.col(fk).isNull()), F.count("*"), 2, 0.0)) for name, (df, fk) in specs.items()}
    return checks_of(shares, "orphans", lambda _, v: F.when(v > vocab.ORPHAN_FAIL_PCT, "fail").when(v > vocab.ORPHAN_WARN_PCT, "warn").otherwise("pass"))


def blank_checks(specs: Mapping[str, tuple[DataFrame, str]], warn_only: Sequence[str] = ()) -> DataFrame:
    """Q-08: mandatory values that are missing or blank."""
    blanks = {name: (df, F.count_if(is_blank(F.col(c)))) for name, (df, c) in specs.items()}
    return checks_of(blanks, "mandatory_fields", lambda name, v: F.when(v > 0, "warn" if name in warn_only else "fail").otherwise("pass"))


def domain_checks(specs: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Q-08: values outside their closed domain."""
    outside = {name: (df, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(domain)))) for name, (df, c, domain) in specs.items()}
    return checks_of(outside, "domains", lambda _, v: F.when(v > 0, "warn").otherwise("pass"))


def duplicate_checks(specs: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Q-09: repeated keys, NULLs left out."""
    parts = []
    for name, (df, cols) in specs.items():
        one = duplicate_groups(df, *cols, count_null=False).agg(F.count("*").alias("n"))
        parts.append(check("duplicates", name, one, F.col("n"), None, F.col(V) > 0))
    return union_all(parts)


def missing_table(name: str, like: DataFrame) -> DataFrame:
    """Q-05: a table that is not there fails its check."""
    one = like.agg(F.count("*").alias("n"))
    return one.select(F.lit("availability").alias("category"), F.lit(name).alias("name"), F.lit(None).cast("double").alias("value"), F.lit("fail").alias("status"))


def gate(checks: DataFrame) -> DataFrame:
    """Q-05: number of checks per status and the worst of them."""
    rank = F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv])
    g = checks.agg(
        F.count("*").alias("checks"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in SEVERITY], F.max(F.element_at(rank, F.col("status"))).alias("_w")
    )
    return g.withColumn("overall", F.when(F.col("_w") == 2, "fail").when(F.col("_w") == 1, "warn").otherwise("pass")).drop("_w")


# --------------------------------------------------------------------------- coverage


def wide(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metric rows back to one row with a column per metric."""
    return rows.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).cast("long").alias(n) for n in names])


def recommendations(counts: DataFrame) -> DataFrame:
    """R-02: rule-based next steps from one row of counters."""
    c = F.col
    say = lambda col, msg: F.concat(c(col).cast("string"), F.lit(msg))
    rules = F.array_compact(
        F.array(
            F.when(c("politicians_without_party") > 0, say("politicians_without_party", " politicians have no party")),
            F.when((c("politicians_without_committees") * 2 > c("active_politicians")) & (c("active_politicians") > 0), F.lit("More than 50% of politicians have no committee")),
            F.when((c("pmg_documents_without_mentions") * 2 > c("total_pmg_documents")) & (c("total_pmg_documents") > 0), say("pmg_documents_without_mentions", " documents have no mentions")),
            F.when(c("politicians_without_aliases") > 0, say("politicians_without_aliases", " politicians have no aliases")),
            F.when(c("politicians_without_source_url") > 0, say("politicians_without_source_url", " politicians have no source URL")),
            F.when(c("parliamentary_questions_without_archive_path") > 0, say("parliamentary_questions_without_archive_path", " questions have no archive path")),
            F.when(c("unresolved_entities_open") > vocab.UNRESOLVED_FAIL_ABOVE, say("unresolved_entities_open", " unresolved entities are OPEN")),
            F.when(c("parliamentary_question_parse_failed") > 0, say("parliamentary_question_parse_failed", " question files failed to parse")),
            F.when(c("duplicate_politician_slug_count") > 0, say("duplicate_politician_slug_count", " duplicate politician slugs")),
            F.when(c("duplicate_source_url_count") > 0, say("duplicate_source_url_count", " duplicate document source URLs")),
        )
    )
    all_good = F.array(F.lit("No critical issues. Continue expanding ingestion coverage."))
    return counts.select(F.explode(F.when(F.size(rules) > 0, rules).otherwise(all_good)).alias("recommendation"))


def domain_metric(df: DataFrame, domain: str, source: str, url: str, date: str | None, identity: str | None) -> DataFrame:
    """R-03: size, date range and gaps of one domain."""
    none = F.lit(None)
    return df.agg(
        F.count("*").alias("records"), (F.min(date) if date else none.cast("date")).alias("earliest"), (F.max(date) if date else none.cast("date")).alias("latest"),
        F.count_if(is_blank(F.col(url))).alias("missing_url"), (F.count_if(F.col(date).isNull()) if date else none.cast("long")).alias("missing_date"),
        (F.count("*") if date else none.cast("long")).alias("date_applicable"), (F.count_if(is_blank(F.col(identity))) if identity else none.cast("long")).alias("missing_identity"),
    ).select(F.lit(domain).alias("domain"), F.lit(source).alias("source"), "*")


def combine_sources(domains: DataFrame) -> DataFrame:
    """R-04: domains of a source added up; gaps that do not apply stay NULL."""
    return domains.groupBy("source").agg(
        F.sum("records").alias("records"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
        *[F.sum(c).alias(c) for c in ("missing_url", "missing_date", "date_applicable", "missing_identity")],
    )


def risks(domains: DataFrame, unresolved_open: DataFrame, duplicates: DataFrame) -> DataFrame:
    """R-05: four risk levels. ``unresolved_open`` and ``duplicates`` hold one ``n``."""
    t = domains.agg(F.sum("missing_url").alias("u"), F.coalesce(F.sum("missing_date"), F.lit(0)).alias("d"), F.coalesce(F.sum("date_applicable"), F.lit(0)).alias("a"))
    level = lambda red, yellow: F.when(red, "red").when(yellow, "yellow").otherwise("green")
    row = lambda df, name, value, lv: df.select(F.lit(name).alias("risk"), value.cast("long").alias("value"), lv.alias("level"))
    no = F.lit(False)
    return union_all([
        row(t, "Missing source URLs", F.col("u"), level(F.col("u") > 0, no)),
        row(t, "Missing source dates", F.col("d"), level(F.col("d") * 4 > F.col("a"), F.col("d") > 0)),
        row(unresolved_open, "Open unresolved entities", F.col("n"), level(F.col("n") > vocab.UNRESOLVED_FAIL_ABOVE, F.col("n") > 0)),
        row(duplicates, "Duplicate identifiers", F.col("n"), level(F.col("n") > 0, no)),
    ])


def actions(domains: DataFrame, sources: DataFrame, risk_rows: DataFrame) -> DataFrame:
    """R-06: what to do next: the first empty source, the weakest domain, the open queue, the red risks."""
    empty = sources.where("coalesce(records, 0) = 0").agg(F.min("source").alias("s")).where("s is not null")
    weak = domains.agg(F.max(F.struct("missing_url", "domain")).alias("w")).where("w.missing_url > 0")
    red = risk_rows.agg(F.count_if(F.col("level") == "red").alias("n"), F.max(F.when(F.col("risk") == "Open unresolved entities", F.col("value"))).alias("o"))
    act = lambda df, i, msg: df.select(F.lit(i).alias("position"), msg.alias("action"))
    found = union_all([
        act(empty, 1, F.concat(F.lit("Ingest or validate the next empty source domain: "), "s", F.lit("."))),
        act(weak, 2, F.concat(F.lit("Repair missing source URLs in "), "w.domain", F.lit(" ("), F.col("w.missing_url").cast("string"), F.lit(" records)."))),
        act(red.where("o > 0"), 3, F.concat(F.lit("Review "), F.col("o").cast("string"), F.lit(" open unresolved entities before entity-level coverage claims."))),
        act(red.where("n > 0"), 4, F.lit("Keep public-facing completeness claims qualified until red risks are resolved.")),
    ])
    nothing = found.agg(F.count("*").alias("k")).where("k = 0")
    return found.unionByName(act(nothing, 5, F.lit("No immediate data coverage action is required.")))


def launch_coverage(counts: DataFrame, sweep_totals: DataFrame, fallback: Mapping[str, int]) -> DataFrame:
    """R-11: share of each source that is stored; 80 % passes, less blocks."""
    fb = None
    for label, total in fallback.items():
        fb = F.when(F.col("label") == label, F.lit(total)) if fb is None else fb.when(F.col("label") == label, F.lit(total))
    both = counts.select("label", "n").unionByName(sweep_totals.select("label", F.col("source_total").alias("_s")), allowMissingColumns=True)
    df = both.groupBy("label").agg(F.max("n").alias("n"), F.max("_s").alias("_s")).where("n is not null")
    df = df.withColumn("source_total", F.coalesce(F.nullif("_s", F.lit(0)), fb).cast("long"))
    share = pct(F.col("n"), F.col("source_total"), 2)
    return df.select("label", "n", "source_total", share.alias("coverage_pct")).withColumn("launch_status", F.when(F.col("coverage_pct") >= vocab.LAUNCH_COVERAGE_PCT, "pass").otherwise("blocker"))


def readiness(gates: DataFrame, complete: Column | None = None) -> DataFrame:
    """R-12: red if any gate is red, green only when every gate is green (and ``complete`` holds)."""
    g = gates.agg(F.count_if(F.col("status") == "red").alias("reds"), F.count_if(F.col("status") == "green").alias("greens"), F.count("*").alias("gates"))
    done = F.col("greens") == F.col("gates")
    if complete is not None:
        done = done & complete
    return g.withColumn("overall", F.when(F.col("reds") > 0, "red").when(done, "green").otherwise("amber"))


def link_coverage(specs: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """R-09: linked, total and share for every fact table."""
    parts = []
    for fact, (df, fk) in specs.items():
        g = df.agg(F.count(fk).alias("linked"), F.count("*").alias("total"))
        parts.append(g.select(F.lit(fact).alias("fact"), "linked", "total", pct(F.col("linked"), F.col("total"), 2).alias("linked_pct")))
    return union_all(parts)


def reachability(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """R-10: how many stored values each lookup path fails to reach.

    Both sides are ``(path, key)`` over all paths; a NULL or blank key cannot
    be looked up. Keys are counted before they are joined, so a key that a
    third of all rows hold is one row, and all paths share one join.
    """
    usable = F.when(F.trim("key") != "", F.col("key"))
    counts = wanted.groupBy("path", usable.alias("key")).agg(F.count("*").alias("n"))
    known = found.where(F.trim("key") != "").select("path", "key").distinct().withColumn("_hit", F.lit(True))
    n = counts.join(known, ["path", "key"], "left").groupBy("path").agg(F.sum("n").alias("checked"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("unreachable"))
    status = F.when(F.col("unreachable") == 0, "PASS").when(F.col("unreachable") == F.col("checked"), "FAIL").otherwise("WARN")
    return n.select("path", "checked", "unreachable", status.alias("status"))


# The gates before a release.
GATES = ["people_coverage", "parliamentary_activity", "election_coverage", "ingestion_health", "source_access", "source_inventory"]


def release_gates(facts: DataFrame) -> DataFrame:
    """R-12: ``(part, item, status)``: the six gates, the overall status, blockers and finished capabilities.

    ``facts`` is one row; NULL says that the report a fact comes from is
    missing, which never counts as success: ``universe`` (the expected people
    are known), ``claim_all``, ``people_status``, ``claim_safe``,
    ``election_complete``, ``election_status``, ``brief_status``, ``blocked``,
    ``access_report``, ``inventory``, ``audit``, ``short_domains`` (array).
    """
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    people = F.when(is_true("universe"), F.coalesce("people_status", F.lit("red"))).otherwise("red")
    activity = F.when(is_true("claim_safe"), "green").when(F.col("claim_safe").isNotNull(), "amber").otherwise("red")
    election = F.when(F.col("election_complete").isNull(), "red").when(F.col("election_complete") & (F.col("election_status") == "green"), "green").otherwise("amber")
    health = F.coalesce("brief_status", F.lit("red"))
    access = F.when(~is_true("blocked") & is_true("access_report") & (health == "green"), "green").otherwise("amber")
    inventory = F.when(is_true("inventory") & is_true("audit"), "green").when(is_true("inventory"), "amber").otherwise("red")
    gates = dict(zip(GATES, (people, activity, election, health, access, inventory), strict=True))
    df = facts.select("*", *[v.alias(f"g_{k}") for k, v in gates.items()])
    every = F.array(*[F.col(f"g_{k}") for k in GATES])
    all_green = F.forall(every, lambda g: g == "green") & is_true("election_complete") & is_true("claim_all")
    overall = F.when(F.array_contains(every, "red") | ~is_true("universe") | (F.size("short_domains") > 0), "red").when(all_green, "green").otherwise("amber")
    blockers = [
        (~is_true("universe"), "expected people are not known"), (F.col("people_status").isNull(), "people report is missing"), (F.col("claim_safe").isNull(), "coverage dashboard is missing"),
        (F.col("election_complete").isNull(), "election report is missing"), (F.col("election_complete").isNotNull() & ~is_true("election_complete"), "election records are incomplete"),
        (F.col("brief_status").isNull(), "ingestion brief is missing"), (F.col("brief_status") == "red", "latest ingestion brief is red"), (~is_true("inventory"), "source inventory is missing"), (~is_true("audit"), "source audit is missing"),
    ]
    done = [(F.col("claim_safe").isNotNull(), "coverage dashboard"), (F.col("election_complete").isNotNull(), "election report"), (F.col("people_status").isNotNull(), "people report"), (F.col("brief_status").isNotNull(), "ingestion brief"),
            (is_true("inventory"), "source inventory"), (is_true("audit"), "source audit"), (is_true("blocked"), "source block is visible and isolated")]
    row = lambda part, item, status: F.struct(F.lit(part).alias("part"), item.alias("item"), status.alias("status"))
    listed = lambda part, told: [F.when(when, row(part, F.lit(text), F.lit(part))) for when, text in told]
    rows = [*[row("gate", F.lit(k), F.col(f"g_{k}")) for k in GATES], row("overall", F.lit("release"), overall), *listed("blocker", blockers), *listed("capability", done)]
    short = F.transform("short_domains", lambda d: row("blocker", F.concat(d, F.lit(" coverage is short")), F.lit("blocker")))
    return df.select(F.explode(F.concat(F.array_compact(F.array(*rows)), short)).alias("r")).select("r.*")


def classify_runs(stages: DataFrame, red_errors: int = 10) -> DataFrame:
    """R-13: every run green, yellow or red with its reasons, from its stages.

    Stage columns: ``run_key, mode, failed, errors, advanced, new_records``.
    """
    g = stages.groupBy("run_key").agg(
        F.max("mode").alias("mode"), F.count_if(F.col("failed") > 0).alias("failed_stages"), F.sum("errors").alias("errors"),
        F.count_if("advanced").alias("advanced"), F.count("*").alias("streams"), F.sum(F.greatest("new_records", F.lit(0))).alias("new_records"),
    )
    real = F.col("mode") == "real"
    hard = (F.col("failed_stages") > 0) | (F.col("errors") >= red_errors)
    stalled = real & (F.col("advanced") == 0) & ~hard
    soft_err = (F.col("errors") > 0) & (F.col("errors") < red_errors)
    partial = real & (F.col("advanced") > 0) & (F.col("advanced") < F.col("streams"))
    partial_red = real & (F.col("advanced") == 0) & hard
    idle = real & (F.col("new_records") == 0) & (F.col("advanced") > 0)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("failed_stages") > 0, text(s("failed_stages"), " stage(s) reported failures")),
            F.when(F.col("errors") >= red_errors, text(s("errors"), f" errors (threshold {red_errors})")),
            F.when(soft_err, text(s("errors"), " error(s) recorded below the red threshold")),
            F.when(~real, text("run mode was ", F.col("mode"))), F.when(stalled, F.lit("real run but no sweep stream advanced")),
            F.when(partial | partial_red, text("partial advance: ", s("advanced"), "/", s("streams"), " streams moved forward")),
            F.when(idle, F.lit("sweep advanced but no new records")),
        )
    )
    colour = F.when(hard | stalled, "red").when(soft_err | ~real | partial | idle, "yellow").otherwise("green")
    return g.withColumns({"status": colour, "reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("real run, all streams advanced, no failures or errors")))})


# The steps that follow from a run's facts.
RUN_STEPS = {
    "validation": "This was validation only. Enable real scheduled sweeps.",
    "errors": "Errors occurred: keep the current page cursor (failed streams did not advance) and let the next scheduled run retry the same window.",
    "larger": "Run is green at pages_per_run={p}. Keep this batch size; after two consecutive green runs, increase to pages_per_run={q}.",
    "steady": "pages_per_run={p} is at the recommended steady state.",
    "coverage": "Meeting coverage is {c}%: keep the daily scheduled sweeps running; coverage grows automatically.",
    "no_votes": "vote_records is 0 while vote_events exist: records are never fabricated and appear when sources include explicit counts.",
    "no_attendance": "No attendance rows despite ingested meetings: check whether the attendance source is reachable.",
    "idle": "Check whether the source still publishes new records.",
}
STEADY_PAGES = 6


def next_actions(classified: DataFrame) -> DataFrame:
    """R-18: next steps and attention items per run.

    Rows may carry what was known at the time of the run: ``pages_per_run``,
    ``coverage_pct``, ``vote_events``, ``vote_records``, ``meetings`` and
    ``attendance``; rules on missing columns do not apply.
    """
    has, c = set(classified.columns), F.col
    text = lambda step, **v: F.concat(*[x for part in RUN_STEPS[step].split("{") for x in ([v[part[0]], F.lit(part[2:])] if part[1:2] == "}" else [F.lit(part)])])
    pages = c("pages_per_run").cast("string") if "pages_per_run" in has else F.lit("3")
    number = pages.cast("int")
    rules = [
        F.when(c("mode") != "real", text("validation")), F.when(c("errors") > 0, text("errors")),
        F.when((c("status") == "green") & (number < STEADY_PAGES), text("larger", p=pages, q=F.least(number * 2, F.lit(STEADY_PAGES)).cast("string"))),
        F.when((c("status") == "green") & (number >= STEADY_PAGES), text("steady", p=pages)),
    ]
    if "coverage_pct" in has:
        rules.append(F.when(c("coverage_pct") < 50, text("coverage", c=c("coverage_pct").cast("string"))))
    if {"vote_events", "vote_records"} <= has:
        rules.append(F.when((c("vote_events") > 0) & (c("vote_records") == 0), text("no_votes")))
    if {"meetings", "attendance"} <= has:
        rules.append(F.when((c("meetings") > 0) & (c("attendance") == 0), text("no_attendance")))
    steps = F.array_compact(F.array(*rules, F.when((c("new_records") == 0) & (c("advanced") > 0), text("idle"))))
    none = F.array(F.lit("No action required. Scheduled sweeps continue automatically."))
    return classified.withColumns(
        {"next_actions": F.when(F.size(steps) > 0, steps).otherwise(none), "attention": F.when(F.col("status") == "green", F.array().cast("array<string>")).otherwise(F.col("reasons"))}
    )
