"""Table-level building blocks: browse, join, count, deduplicate, rank.

Group-wise work is written so that a key holding a third of all rows is cut
down before it is shuffled: aggregates combine on the map side, top-k filters
let Spark keep only ``k`` rows per group and task before the exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- browse


def browse(df: DataFrame, filters: Mapping[str, object], order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """F-01…F-05: optional equality filters joined by AND, a sort and one page."""
    conds = [F.col(c) == v for c, v in filters.items() if v not in (None, "")]
    out = df.where(reduce(and_, conds)) if conds else df
    out = out.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def ilike_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """F-07: some column holds some term, whatever the case."""
    return reduce(or_, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower())) for t in terms for c in columns])


def search_people(people: DataFrame, aliases: DataFrame, needle: str) -> DataFrame:
    """F-06: people whose names or aliases contain ``needle``; nobody twice."""
    hit = ilike_any(["alias"], [needle.strip()])
    by_alias = aliases.where(hit).select(F.col("person_id").alias("id")).distinct().withColumn("_alias_hit", F.lit(True))
    own = ilike_any(["full_name", "display_name", "slug"], [needle.strip()])
    return people.join(by_alias, "id", "left").where(own | F.col("_alias_hit")).drop("_alias_hit")


# --------------------------------------------------------------------------- joins


def with_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """J-04: parents that have a child."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def without_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """J-05: parents that have none."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def reconcile_names(expected: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """J-06: names found on one side only, compared without case and outer spaces."""
    key = F.lower(F.trim(F.col(name)))
    e = expected.select(key.alias("key")).where("key <> ''").distinct().withColumn("in_expected", F.lit(True))
    p = present.select(key.alias("key")).where("key <> ''").distinct().withColumn("in_present", F.lit(True))
    both = e.join(p, "key", "full_outer")
    side = F.when(F.col("in_present").isNull(), "expected_only").when(F.col("in_expected").isNull(), "present_only")
    return both.select("key", side.alias("side")).where("side is not null")


def first_by_alternatives(facts: DataFrame, fact_keys: Sequence[Column], dim: DataFrame, dim_keys: Sequence[Column], dim_id: str, out: str) -> DataFrame:
    """J-09: match any of several names of a fact to any of several names of a dimension row.

    ``OR`` between the alternatives would force a nested loop. Every
    dimension name becomes one keyed row instead (lowest id wins), and each
    alternative of the fact is one hash join; the first one that hits counts.
    """
    names = dim.select(F.col(dim_id).alias("_id"), F.explode(F.array_distinct(F.array_compact(F.array(*dim_keys)))).alias("_k"))
    keyed = names.where(F.col("_k") != "").groupBy("_k").agg(F.min("_id").alias("_id"))
    df = facts
    for i, k in enumerate(fact_keys):
        df = df.withColumn(f"_k{i}", k).join(keyed.select(F.col("_k").alias(f"_k{i}"), F.col("_id").alias(f"_id{i}")), f"_k{i}", "left")
    ids = [F.col(f"_id{i}") for i in range(len(fact_keys))]
    return df.withColumn(out, F.coalesce(*ids)).select(*facts.columns, out)


def contained(texts: DataFrame, text_id: str, text: str, names: DataFrame, min_length: int) -> DataFrame:
    """All lower-case ``_name`` values occurring inside each short text, as ``(text_id, _name)``.

    No nested loop. The first ``min_length`` letters of a name are its anchor;
    anchors found among the letter grams of a text tell at which places and
    lengths a name could sit, and only those substrings are joined to the names
    by equality. The result is exactly that of testing every name against
    every text. Meant for titles and words; rows carry the window of the
    longest name, not the text.
    """
    anchors = names.groupBy(F.left("_name", F.lit(min_length)).alias("_gram")).agg(F.collect_set(F.length("_name")).alias("_lengths"))
    # One number that describes the dictionary: its longest name.
    width = names.agg(F.max(F.length("_name")).alias("w")).first()["w"] or min_length
    base = texts.select(F.col(text_id).alias("_tid"), F.lower(F.col(text)).alias("_text")).where(F.length("_text") >= min_length)
    places = F.transform(F.sequence(F.lit(1), F.length("_text") - min_length + 1), lambda p: F.substr(F.col("_text"), p, F.lit(width)))
    windows = base.select("_tid", F.explode(places).alias("_w")).withColumn("_gram", F.left("_w", F.lit(min_length)))
    spots = windows.join(anchors, "_gram").select("_tid", "_w", F.explode("_lengths").alias("_len")).where(F.length("_w") >= F.col("_len"))
    cand = spots.select("_tid", F.left("_w", F.col("_len")).alias("_name"))
    return cand.join(names.select("_name"), "_name", "left_semi").withColumnRenamed("_tid", text_id)


def longest_contained(texts: DataFrame, text_id: str, text: str, dictionary: DataFrame, entity: str, name: str, min_length: int) -> DataFrame:
    """J-10/O-05: the longest dictionary name occurring inside each text, as a substring."""
    low = dictionary.select(F.col(entity).alias("_entity"), F.lower(F.col(name)).alias("_name")).where(F.length("_name") >= min_length)
    names = low.groupBy("_name").agg(F.min("_entity").alias("_entity"))
    hits = contained(texts, text_id, text, names, min_length)
    best = hits.groupBy(text_id).agg(F.min(F.struct((-F.length("_name")).alias("l"), F.col("_name").alias("n"))).alias("b")).select(text_id, F.col("b.n").alias("_name"))
    return best.join(names, "_name").select(text_id, F.col("_entity").alias(entity), F.col("_name").alias("matched_name"))


def new_first(urls: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """J-11: a work list, unseen addresses first, each part in order."""
    flagged = urls.select("url").distinct().join(known.select("url").distinct().withColumn("known", F.lit(True)), "url", "left")
    return flagged.withColumn("known", F.coalesce("known", F.lit(False))).orderBy("known", "url").limit(limit)


# --------------------------------------------------------------------------- aggregates


def metrics(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """A-02: many conditional counts in one pass, one row."""
    return df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in counters.items()])


def as_metric_rows(df: DataFrame, section: str | None = None) -> DataFrame:
    """One row per metric from a one-row table of counters."""
    cols = df.columns
    out = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")).select("m.metric", "m.value")
    return out.withColumn("section", F.lit(section)) if section else out


def pct(part: Column, whole: Column, digits: int = 1, empty: float | None = None) -> Column:
    """A-14: percentage, exact decimals so that halves round alike everywhere."""
    ratio = F.round((part.cast("decimal(20,0)") * 100).cast("decimal(38,6)") / whole.cast("decimal(20,0)"), digits)
    return F.when(whole > 0, ratio.cast("double")).otherwise(F.lit(empty).cast("double"))


def counts_by(df: DataFrame, *cols: str, name: str = "n", missing: str = "unknown") -> DataFrame:
    """A-06: group counts, NULL shown as a word, several columns joined by a slash."""
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in cols])
    return df.groupBy(key.alias("key")).agg(F.count("*").alias(name))


def status_pivot(df: DataFrame, by: Sequence[str], status: str, domain: Sequence[str], *more: Column) -> DataFrame:
    """A-03: one counter per status; anything outside the domain counts as unknown."""
    known = [s for s in domain if s != "unknown"]
    folded = F.when(F.col(status).isin(known), F.col(status)).otherwise(F.lit("unknown"))
    return df.groupBy(*by).agg(*[F.count_if(folded == s).alias(s) for s in domain], F.count("*").alias("total"), *more)


# --------------------------------------------------------------------------- duplicates


def duplicate_groups(df: DataFrame, *cols: str, count_null: bool = True) -> DataFrame:
    """D-01…D-04: values held by more than one row; ``count_null`` decides about NULL."""
    src = df if count_null else df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))
    return src.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_texts(df: DataFrame, key: str, col: str) -> DataFrame:
    """D-03 for long values: hashes are counted, the value of one row is fetched for the repeated ones."""
    n = df.groupBy(F.sha2(col, 256).alias("_h")).agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n > 1")
    return n.join(df.select(key, col), key).select(col, "n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """D-07: the first row of every key under a total order (filtered before the shuffle)."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """O-02: the first ``k`` rows of every key."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """X-04: key-wise difference of two snapshots."""
    b = before.select(key, F.col(value).alias("before"))
    a = after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))
