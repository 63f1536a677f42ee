"""URL filter: listed host/path rules first, mined token combinations for the rest.

A URL is a set of tokens: the suffixes of its host, and its path segments by
depth with digits folded to ``0``. FP-growth mines the combinations that go
with a label; rules under the confidence, and those that a shorter rule already
covers at no less confidence, are pruned. Matching is an inverted index: a rule
is filed under its rarest token, a URL looks up its tokens, and the few rules
found are tested for containment, so no URL meets all rules.

The number of mined rules is bounded whatever the input: with at most
``MAX_TOKENS`` tokens a labelled URL and a support of ``s`` there are at most
``2**MAX_TOKENS / s`` frequent sets. The join is left to Catalyst, which sees
the size of the rule table.

Only DataFrame functions and Spark ML are used. The classifier is fitted on a
bounded sample of labelled URLs: equal token sets of a label are counted, and
each gets its share of about ``max_labelled`` rows, fractions by its hash.

Defined cases: a null URL or one without ``://`` has an empty host and path and
no tokens, is fitted by no rule, and is allowed; a URL that no mined rule
matches is allowed; equal confidence goes to higher support, then the longer
rule, then ``block``; repeated rows give repeated results; an empty table, or
one without labelled rows, mines nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.llm.common import bind, lower_ascii, pick, stored

#: Path segments beyond this depth, and host labels beyond it, share tokens: a labelled URL has at most MAX_TOKENS.
DEPTH, MAX_TOKENS = 4, 10


def host(url: Column) -> Column:
    after = F.when(F.instr(url, F.lit("://")) > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.lit(2**31 - 1)))
    return F.coalesce(lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host_col: Column, path_col: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.filter(F.split(host_col, r"\.", -1), lambda x: x != "")
    tail = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda i: F.when(i <= F.size(labels), F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), "."))))
    segments = F.filter(F.split(path_col, "/", -1), lambda x: x != "")
    folded = F.transform(segments, lambda s, i: F.concat(F.lit("path"), F.least(i, F.lit(DEPTH - 1)).cast("string"), F.lit(":"), F.regexp_replace(s, "[0-9]+", "0")))
    return F.array_distinct(F.filter(F.concat(tail, folded), lambda t: t.isNotNull()))


def listed(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest listed rule (host, path, verdict) that fits, as (rule, verdict); else null."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def sampled(labelled: DataFrame, n: int) -> DataFrame:
    """All rows of ``(_tokens, _label)``, or about ``n`` of them: every token set of a label in proportion to its rows."""
    held = stored(labelled.groupBy("_tokens", "_label").agg(F.count("*").alias("n")), "labelled")
    total = held.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") * min(1.0, n / max(total, 1))
    # The fraction left is one row more or none, by a hash of the content in [0, 1).
    extra = (F.xxhash64("_tokens", "_label") / F.lit(2.0**64) + 0.5 < share - F.floor(share)).cast("bigint")
    return held.select("_tokens", "_label", F.explode(F.array_repeat(F.lit(1), (F.floor(share) + extra).cast("int"))).alias("_copy")).drop("_copy")


def mine(labelled: DataFrame, support: float, confidence: float, max_labelled: int) -> DataFrame:
    """``(rule_id, tokens, verdict, confidence, support)`` mined from ``(_tokens, _label)``."""
    sample = sampled(labelled.filter(F.size("_tokens") > 0), max_labelled)
    items = sample.select(F.concat(F.slice("_tokens", 1, MAX_TOKENS), F.array(F.concat(F.lit("label:"), F.col("_label")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    found = found.filter(F.startswith(F.col("consequent")[0], F.lit("label:")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("label:"))))
    rules = stored(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 100).alias("verdict"), "confidence", "support"), "rules")
    # A rule that keeps its verdict with one token less is covered by the shorter one.
    shorter = rules.select("verdict", "tokens", "confidence", F.explode("tokens").alias("less"))
    shorter = shorter.select("verdict", F.col("tokens").alias("long"), F.col("confidence").alias("long_confidence"), F.array_except("tokens", F.array("less")).alias("tokens"))
    covered = shorter.join(rules, ["verdict", "tokens"]).filter("confidence >= long_confidence").select("verdict", F.col("long").alias("tokens"))
    return rules.join(covered, ["verdict", "tokens"], "left_anti").withColumn("rule_id", F.xxhash64("verdict", "tokens"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_tokens, mined)``: the verdict of the best rule for each distinct token set that has one."""
    sets = stored(urls.filter(F.size("_tokens") > 0).select("_tokens").distinct(), "token-sets")
    held = sets.select("_tokens", F.explode("_tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    filed = filed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rules.join(filed, "rule_id").select("token", "tokens", "verdict", "confidence", "support")
    hits = held.join(index, "token").filter(F.size(F.array_except("tokens", "_tokens")) == 0)
    best = F.struct("confidence", "support", F.size("tokens"), "verdict")
    return hits.groupBy("_tokens").agg(F.max_by("verdict", best).alias("mined"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
               support: float = 0.01, confidence: float = 0.9, max_labelled: int = 100_000) -> DataFrame:
    """``(_id, host, path, rule, verdict)`` of every row.

    ``labels``: labelled URLs ``(url, label)`` with label ``allow`` or
    ``block``; without them a URL is labelled by the listed rule that decides
    it, and all others are presumed innocent, so a mined rule must single out
    what the list blocks.
    """
    rows = pick(pages, _id=(id_col, "bigint"), _url=(url_col, "string"))
    rows = bind(rows.select("_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path")), "_listed", listed(F.col("host"), F.col("path"), rules))
    rows = stored(rows.select("_id", "host", "path", "_listed", tokens(F.col("host"), F.col("path")).alias("_tokens")), "urls")
    if labels is None:
        known = rows.select("_tokens", F.coalesce("_listed.verdict", F.lit("allow")).alias("_label"))
    else:
        known = pick(labels, _url=("url", "string"), _label=("label", "string")).filter("_label is not null")
        known = known.select(tokens(host(F.col("_url")), path(F.col("_url"))).alias("_tokens"), "_label")
    mined = match(rows.filter("_listed is null"), mine(known, support, confidence, max_labelled))
    left = rows.filter("_listed is null").join(mined, "_tokens", "left")
    left = left.select("_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit("allow")).alias("verdict"))
    return rows.filter("_listed is not null").select("_id", "host", "path", F.col("_listed.rule").alias("rule"), F.col("_listed.verdict").alias("verdict")).unionByName(left)
