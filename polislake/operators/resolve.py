"""Names to entities, set-based (E-01 … E-09, P-10, P-11).

Every dictionary is reduced to one row per key before it meets the facts, and
the facts are reduced to their distinct names first. A name carried by a third
of all rows therefore costs one lookup, and the join back to the facts has one
row per key on the dictionary side, which AQE may broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import names, text
from polislake.operators.tables import top_k
from polislake.session import cut_lineage

#: Names that are looked up in ``DEALS`` parts; any other fills less than one in ``HOT`` of the facts.
HOT, DEALS = 256, 64


def _spread(people: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that are about to be multiplied, dealt to all shuffle partitions: a small file is read by few tasks."""
    return people.repartition(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def counted(facts: DataFrame, name: str) -> DataFrame:
    """The distinct names of the facts with their number ``_n``, stored: they are looked up, and the most frequent are listed."""
    return cut_lineage(facts.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")))


def with_found(facts: DataFrame, counts: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``facts`` left-joined to ``found``, which has one row per ``name``; ``counts`` is that of ``counted``.

    The most frequent names, a list of ``HOT`` at most, are dealt to ``DEALS``
    parts each, as are facts without a name, so that no task holds all rows of
    one name. Nothing measured in bytes shows them: equal names compress well.
    """
    hot = F.broadcast(counts.orderBy(F.desc("_n"), name).limit(HOT).select(name, F.lit(True).alias("_hot")))
    often = F.col("_hot").isNotNull()
    deal = F.when(often | F.col(name).isNull(), F.pmod(F.xxhash64(*facts.columns), F.lit(DEALS))).otherwise(0).cast("int")
    dealt = facts.join(hot, name, "left").withColumn("_deal", deal).drop("_hot")
    copies = F.when(often, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    known = found.join(hot, name, "left").withColumn("_deal", F.explode(copies)).drop("_hot")
    return dealt.join(known, [name, "_deal"], "left").drop("_deal")


def alias_table(people: DataFrame, id_col: str = "id") -> DataFrame:
    """P-10/E-20: every spelling of every person as ``(person_id, alias, alias_type)``."""
    forms = _spread(people.select(id_col, "full_name", "display_name"), id_col).select(
        F.col(id_col).alias("person_id"), F.explode(names.alias_forms(F.col("full_name"), F.col("display_name"))).alias("f")
    )
    return forms.select("person_id", "f.alias", "f.alias_type")


def _keyed(df: DataFrame, person: str, key: Column, priority: int, confidence: float, reason: Column) -> DataFrame:
    return df.select(
        F.lower(key).alias("key"), F.col(person).alias("person_id"), F.lit(priority).alias("priority"),
        F.lit(confidence).alias("confidence"), reason.alias("reason"),
    ).where(F.col("key").isNotNull() & (F.col("key") != ""))


def _best(rows: DataFrame, out: str) -> DataFrame:
    """One winner per key: priority, then lowest person id."""
    return rows.groupBy("key").agg(F.min(F.struct("priority", "person_id", "confidence", "reason")).alias(out))


def _unique(rows: DataFrame, priority: int, reason: str, keep_blocked: bool) -> DataFrame:
    """Keys that name exactly one person; with ``keep_blocked`` the others stay as a stop sign."""
    g = rows.groupBy("key").agg(F.min("person_id").alias("_p"), F.max("person_id").alias("_q"))
    one = F.col("_p") == F.col("_q")
    out = g if keep_blocked else g.where(one)
    return out.select(
        "key", F.when(one, F.col("_p")).alias("person_id"), F.lit(priority).alias("priority"),
        F.lit(vocab.CONF_SURNAME).alias("confidence"), F.lit(reason).alias("reason"),
    )


def dictionaries(people: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name keys (``strong``/``weak`` winners) and slug keys of all people."""
    strong = _keyed(people, "id", F.col("full_name"), 1, vocab.CONF_FULL_NAME, F.lit("exact_full_name")).unionByName(
        _keyed(people, "id", F.col("display_name"), 2, vocab.CONF_DISPLAY, F.lit("display_name"))
    )
    surname = F.col("alias_type") == "SURNAME_ONLY"
    alias = _keyed(aliases.where(~surname), "person_id", F.col("alias"), 4, vocab.CONF_ALIAS, F.concat(F.lit("alias:"), "alias_type"))
    short = _unique(aliases.where(surname).select(F.lower("alias").alias("key"), "person_id"), 5, "unique_surname_alias", True)
    last = people.where(F.contains(F.trim("display_name"), F.lit(" "))).select(
        F.lower(names.last_word(F.col("display_name"))).alias("key"), F.col("id").alias("person_id")
    ).where(F.length("key") >= 5)
    tail = _unique(last, 6, "unique_surname", False)
    weak = alias.unionByName(short).unionByName(tail)
    # One aggregate with two conditional minima instead of an outer join of two dictionaries.
    row = F.struct("priority", "person_id", "confidence", "reason")
    first = F.col("priority") <= 2
    by_name = strong.unionByName(weak).groupBy("key").agg(F.min(F.when(first, row)).alias("strong"), F.min(F.when(~first, row)).alias("weak"))
    by_slug = _best(_keyed(people, "id", F.col("slug"), 3, vocab.CONF_SLUG, F.lit("slug")), "by_slug")
    return by_name, by_slug


def resolve_distinct(raw_names: DataFrame, people: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """E-01 over the distinct values of ``name``: person, confidence and reason, NULL if unresolved."""
    by_name, by_slug = dictionaries(people, aliases)
    keyed = raw_names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("key", F.lower(text.collapse(F.col(name)))).where("key <> ''")
    joined = keyed.join(by_name, "key", "left")
    slugs = by_slug.withColumnRenamed("key", "_slug")
    joined = joined.withColumn("_slug", names.slug(F.col("key"))).join(slugs, "_slug", "left")
    hit = F.coalesce("strong", "by_slug", "weak")
    out = joined.select(name, hit.alias("h")).select(name, "h.person_id", "h.confidence", "h.reason")
    return out.where("person_id is not null")


def resolve(facts: DataFrame, people: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """E-01/E-06: facts with ``person_id``, ``confidence``, ``reason``; unresolved rows stay."""
    counts = counted(facts, name)
    return with_found(facts, counts, resolve_distinct(counts, people, aliases, name), name)


def resolve_askers(facts: DataFrame, people: DataFrame, aliases: DataFrame, asker: str) -> DataFrame:
    """E-02: the first spelling of the asker that resolves."""
    counts = counted(facts, asker)
    spelled = counts.select(asker, F.posexplode(names.asker_candidates(F.col(asker))).alias("pos", "candidate"))
    found = spelled.join(resolve_distinct(spelled, people, aliases, "candidate"), "candidate")
    best = found.groupBy(asker).agg(F.min(F.struct("pos", "candidate", "person_id", "confidence", "reason")).alias("b"))
    return with_found(facts, counts, best.select(asker, "b.person_id", "b.confidence", "b.reason", F.col("b.candidate").alias("matched_text")), asker)


def candidates(raw_names: DataFrame, people: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """E-03: all people a name may stand for, best score each, by lower-case key.

    A key meets every dictionary row at most once, so the output never
    exceeds the dictionary.
    """
    surname = F.col("alias_type") == "SURNAME_ONLY"
    rows = (
        _keyed(people, "id", F.col("full_name"), 1, vocab.CONF_FULL_NAME, F.lit("exact_full_name"))
        .unionByName(_keyed(people, "id", F.col("display_name"), 2, vocab.CONF_DISPLAY, F.lit("display_name")))
        .unionByName(_keyed(aliases.where(~surname), "person_id", F.col("alias"), 4, vocab.CONF_ALIAS, F.concat(F.lit("alias:"), "alias_type")))
        .unionByName(_keyed(aliases.where(surname), "person_id", F.col("alias"), 5, vocab.CONF_SURNAME, F.lit("alias:SURNAME_ONLY")))
    )
    slugs = _keyed(people, "id", F.col("slug"), 3, vocab.CONF_SLUG, F.lit("slug")).withColumnRenamed("key", "_slug")
    keys = raw_names.select(F.lower(text.collapse(F.col(name))).alias("key")).where("key <> ''").distinct()
    cols = ["key", "person_id", "priority", "confidence", "reason"]
    found = keys.join(rows, "key").select(*cols).unionByName(
        keys.withColumn("_slug", names.slug(F.col("key"))).join(slugs, "_slug").select(*cols)
    )
    best = found.groupBy("key", "person_id").agg(F.min(F.struct("priority", "confidence", "reason")).alias("b")).select("key", "person_id", "b.confidence", "b.reason")
    # The surname fallback applies to single words that found nothing else.
    open_keys = keys.where(~F.contains("key", F.lit(" ")) & (F.length("key") >= 5)).join(found.select("key").distinct(), "key", "left_anti")
    last = people.where(F.contains(F.trim("display_name"), F.lit(" "))).select(F.lower(names.last_word(F.col("display_name"))).alias("key"), F.col("id").alias("person_id"))
    tail = open_keys.join(last, "key")
    n = tail.groupBy("key").agg(F.count("*").alias("n"))
    fallback = tail.join(n, "key").select(
        "key", "person_id", F.lit(vocab.CONF_SURNAME).alias("confidence"), F.when(F.col("n") == 1, "unique_surname").otherwise("surname_ambiguous").alias("reason")
    )
    return best.unionByName(fallback)


def bucket(score: Column, ambiguous: Column) -> Column:
    """E-04: high, medium or low confidence."""
    return (
        F.when(ambiguous | score.isNull(), "low").when(score >= vocab.HIGH_CONFIDENCE, "high")
        .when(score >= vocab.MEDIUM_CONFIDENCE, "medium").otherwise("low")
    )


def assess(unresolved: DataFrame, found: DataFrame, name: str, keep: int = 5) -> DataFrame:
    """E-04: review record per unresolved row: bucket, ambiguity, recommendation, top candidates."""
    tiers = found.groupBy("key", "confidence").agg(F.count("*").alias("n"))
    top = tiers.groupBy("key").agg(F.max("confidence").alias("top_score"))
    near = tiers.join(top, "key").where(F.round(F.col("top_score") - F.col("confidence"), 6) <= vocab.AMBIGUITY_MARGIN)
    per_key = near.groupBy("key").agg(F.max("top_score").alias("top_score"), F.sum("n").alias("near_top"))
    shown = top_k(found, ["key"], [F.desc("confidence"), F.col("person_id")], keep)
    listed = shown.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "person_id"))), lambda x: x["person_id"].cast("string")), ",").alias("candidates"),
        F.min(F.struct((-F.col("confidence")).alias("c"), "person_id", "reason")).alias("b"),
    ).select("key", "candidates", F.col("b.reason").alias("signals"))
    df = unresolved.withColumn("key", F.lower(text.collapse(F.col(name)))).join(per_key, "key", "left").join(listed, "key", "left")
    ambiguous = F.coalesce(F.col("near_top") > 1, F.lit(False))
    df = df.withColumn("ambiguous", ambiguous).withColumn("bucket", bucket(F.col("top_score"), F.col("ambiguous")))
    return df.withColumn("recommended", (F.col("bucket") == "high") & ~F.col("ambiguous")).drop("key", "near_top")


def suggest(unresolved: DataFrame, people: DataFrame, aliases: DataFrame) -> DataFrame:
    """E-06: a suggestion for every open row, ``no_match`` where there is none."""
    out = resolve(unresolved.where("status = 'OPEN'"), people, aliases, "raw_value")
    return out.withColumn("reason", F.coalesce("reason", F.lit("no_match")))


def apply_suggestions(suggestions: DataFrame, aliases: DataFrame, threshold: float = vocab.HIGH_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """E-07: decisions per suggestion and the aliases that follow from the applied ones."""
    known = F.col("person_id").isNotNull()
    decided = suggestions.withColumn(
        "decision", F.when(known & (F.col("confidence") >= threshold), "applied").when(known, "skipped").otherwise("no_match")
    )
    spelled = decided.where("decision = 'applied'").select("person_id", text.collapse(F.col("raw_value")).alias("alias"), "source_url")
    fresh = spelled.groupBy("person_id", "alias").agg(F.min("source_url").alias("source_url"))
    return decided, fresh.join(aliases.select("person_id", "alias"), ["person_id", "alias"], "left_anti").withColumn("alias_type", F.lit("SOURCE_VARIANT"))


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """E-08: manual decisions (``id, decision, person_id``) merged into the queue."""
    d = decisions.select("id", F.col("decision").alias("_d"), F.col("person_id").alias("_p"))
    df = queue.join(d, "id", "left")
    status = F.when(F.col("_d") == "resolve", "RESOLVED").when(F.col("_d") == "ignore", "IGNORED").otherwise(F.col("status"))
    return df.withColumns({"status": status, "resolved_politician_id": F.when(F.col("_d") == "resolve", F.col("_p"))}).drop("_d", "_p")


def name_index(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """E-09: lower-case name forms to people, persons' own forms first, lowest id wins."""
    own = _spread(people.select("id", "full_name", "display_name", "slug")).select(
        F.col("id").alias("person_id"),
        F.explode(F.array_compact(F.array(F.lower("full_name"), F.lower("display_name"), F.lower("slug"), names.slug(names.attendee_name(F.col("full_name")))))).alias("key"),
        F.lit(0).alias("rank"),
    )
    other = aliases.where("alias_type <> 'SURNAME_ONLY'").select("person_id", F.lower("alias").alias("key"), F.lit(1).alias("rank"))
    rows = own.unionByName(other).where("key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("rank", "person_id")).alias("b")).select("key", F.col("b.person_id").alias("person_id"))


def from_index(facts: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """E-09: person of every fact by name, else by slug; distinct names are looked up once."""
    shown = F.coalesce(names.attendee_name(F.col(name)), F.col(name))
    counts = counted(facts, name)
    keys = counts.select(name).withColumn("_v", text.collapse(shown))
    keys = keys.withColumns({"_k": F.lower("_v"), "_s": names.slug(F.col("_v"))})
    a = index.select(F.col("key").alias("_k"), F.col("person_id").alias("_a"))
    b = index.select(F.col("key").alias("_s"), F.col("person_id").alias("_b"))
    found = keys.join(a, "_k", "left").join(b, "_s", "left").select(name, F.coalesce("_a", "_b").alias("person_id")).where("person_id is not null")
    return with_found(facts, counts, found, name)


