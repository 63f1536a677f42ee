"""Catalogues of public sources: format, readiness, audits and manifests (V-*, P-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake import vocab
from polislake.functions import urls


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def audit_headers(sources: DataFrame) -> DataFrame:
    """P-31/V-09: may a result file be parsed, judged by its header row.

    Input: ``format`` and ``columns array<string>``; other columns pass through.
    """
    clean = F.array_distinct(
        F.transform(
            F.filter(F.coalesce("columns", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")),
            lambda c: F.trim(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")), r"\s+", " ")),
        )
    )
    df = sources.withColumn("_headers", clean)
    votes = F.array_sort(F.array_intersect("_headers", _words(vocab.VOTE_COLUMN_ALIASES)))
    ids_ok = F.arrays_overlap("_headers", _words(vocab.CONTEST_COLUMN_ALIASES)) & F.arrays_overlap(
        "_headers", _words(vocab.ACTOR_COLUMN_ALIASES)
    )
    structured = F.col("format").isin(vocab.STRUCTURED_FORMATS)
    df = df.withColumns({"vote_columns": votes, "identifiers_ok": F.coalesce(ids_ok, F.lit(False)), "_structured": structured})
    has_votes = F.size("vote_columns") > 0
    safe = F.col("_structured") & has_votes & F.col("identifiers_ok")
    rank = F.when(F.col("format") == "csv", 1).when(F.col("format") == "json", 2).when(F.col("format") == "xlsx", 3)
    risks = F.array_compact(
        F.array(
            F.when(~F.col("_structured"), "Format is not a supported structured parser candidate."),
            F.when(F.col("_structured") & (F.size("_headers") == 0), "No header/schema sample is available; vote columns cannot be verified."),
            F.when(F.col("_structured") & ~has_votes, "No explicit vote-total column was detected."),
            F.when(F.col("_structured") & ~F.col("identifiers_ok"), "Required contest and party/candidate source identifiers were not detected."),
        )
    )
    return df.withColumns({"safe": safe, "priority": F.when(safe, rank), "risks": risks}).drop("_headers", "_structured")


# Kinds of election that make an election row.
ELECTORAL_TYPES = ["national", "provincial", "municipal", "by-election"]


def manifests(responses: DataFrame) -> DataFrame:
    """V-06: manifest row per fetched source."""
    ekey = F.when(F.col("election_type").isin(ELECTORAL_TYPES), F.concat_ws("-", "election_type", F.col("election_year").cast("string")))
    fmt = urls.file_format(F.col("source_url"), F.col("content_type"))
    df = responses.withColumns({"election_key": ekey, "format": fmt})
    base = urls.stable(F.col("source_url"))
    return df.select(
        "id", F.when(F.col("election_key").isNotNull(), F.concat_ws("#", base, "election_key")).otherwise(base).alias("manifest_key"), "election_key", "format",
        urls.readiness(F.col("format"), F.col("ok")).alias("readiness"), F.sha2("body", 256).alias("checksum"), F.octet_length("body").alias("byte_size"),
        "source_url", "election_type", "election_year", "geography_level", F.col("ok").alias("reachable"),
    )


def elections(manifest_rows: DataFrame) -> DataFrame:
    """V-06: one election per key, the first source seen describes it."""
    g = manifest_rows.where("election_key is not null").groupBy("election_key").agg(F.min(F.struct("id", "election_type", "election_year", "source_url")).alias("b"))
    return g.select("election_key", "b.election_type", "b.election_year", "b.source_url")


def facets(manifest_rows: DataFrame, columns: list[str]) -> DataFrame:
    """V-07: counts by each facet in one pass, NULL shown as unknown."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key")) for c in columns])
    return manifest_rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.key").agg(F.count("*").alias("n"))


def audit_downloads(responses: DataFrame, domain: str, max_bytes: int, expected: list[str]) -> DataFrame:
    """V-08: risk flags and likely parser of every downloaded source."""
    fmt = urls.file_format(F.col("source_url"), F.col("content_type"))
    size = F.octet_length("body")
    header = F.transform(F.split(F.substring_index("body", "\n", 1), ","), lambda c: F.lower(F.btrim(F.trim(c), F.lit('"'))))
    df = responses.withColumns({"format": fmt, "off_domain": ~urls.on_domain(F.col("source_url"), domain), "sampled": size >= max_bytes, "_family": urls.content_family(F.col("content_type"))})
    flags = F.array_compact(
        F.array(
            F.when(F.col("off_domain"), "redirect_off_official_domain"), F.when(F.col("_family") == "other", "disallowed_or_unknown_content_type"),
            F.when(size > max_bytes, "oversize"), F.when(F.col("sampled"), "body_sampled_not_full"),
            F.when((F.col("format") == "csv") & (F.size(F.array_except(_words(expected), header)) > 0), "csv_header_missing_expected_columns"),
        )
    )
    df = df.withColumn("risk_flags", flags).withColumn("reachable", F.coalesce(F.col("status").between(200, 399), F.lit(False)) & ~F.col("off_domain"))
    profile = F.when(F.col("format").isin("csv", "json", "xlsx") & (F.size("risk_flags") == 0) & F.col("reachable"), "structured-candidate").when(F.col("format").isin("html", "pdf"), "needs-parser-design").otherwise("unknown")
    return df.withColumn("profile", profile).drop("_family")


def audit_members(sources: DataFrame) -> DataFrame:
    """V-10: kind and readiness of member sources, and whether one may serve as baseline."""
    u, ct = F.lower(F.substring_index("source_url", "?", 1)), F.lower(F.coalesce("content_type", F.lit("")))
    kind = (
        F.when(F.endswith(u, F.lit(".csv")), "csv").when(F.endswith(u, F.lit(".pdf")), "pdf").when(F.endswith(u, F.lit(".html")) | F.endswith(u, F.lit(".htm")), "html")
        .when(F.contains(u, F.lit("/api")) | F.startswith(u, F.lit("https://api.")), "api").when(F.contains(ct, F.lit("csv")), "csv").when(F.contains(ct, F.lit("json")), "api")
        .when(F.contains(ct, F.lit("pdf")), "pdf").when(F.contains(ct, F.lit("html")), "html").otherwise("unknown")
    )
    df = sources.withColumn("source_kind", kind)
    ready = F.when(~F.col("ok"), "unreachable").when(F.col("source_kind").isin("csv", "api"), "structured-candidate").when(F.col("source_kind").isin("html", "pdf"), "needs-parser-validation").otherwise("unknown")
    return df.withColumns({"readiness": ready, "baseline": (F.col("officialness") == "official") & (F.col("recommended_use") == "baseline authority")})


def audit_divisions(sources: DataFrame) -> DataFrame:
    """V-11: readiness of vote and division sources."""
    fmt = urls.file_format(F.col("source_url"), F.col("content_type"))
    df = sources.withColumn("format", fmt)
    return df.withColumn("readiness", F.when(F.col("implemented"), "implemented-limited").when(~F.col("ok"), "unreachable").when(F.col("format").isin(STRUCTURED), "structured-candidate").otherwise("needs-parser-design"))


STRUCTURED = ["json", "csv", "xlsx"]


def discovery_report(sources: DataFrame, rejected_hosts: list[str] = ()) -> DataFrame:
    """V-12: format and readiness of any source family; hosts on the reject list are marked."""
    host = F.coalesce(urls.host(F.col("source_url")), F.lit(""))
    rejected = F.lit(False)
    for h in rejected_hosts:
        rejected = rejected | (host == h) | F.endswith(host, F.lit("." + h))
    df = sources.withColumns({"format": urls.file_format(F.col("source_url"), F.col("content_type")), "rejected": rejected})
    return df.withColumn("readiness", F.when(F.col("rejected"), "rejected").otherwise(urls.readiness(F.col("format"), F.col("ok"))))
