"""Reading and writing public-record sources (S-*)."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polislake import vocab
from polislake.functions import dates, text, urls


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S-01: an entity table."""
    return spark.read.parquet(path)


def read_vote_csv(spark: SparkSession, path: str, columns: Sequence[str] = tuple(vocab.VOTE_CSV_COLUMNS)) -> DataFrame:
    """S-02: result files as text columns with file and row number; malformed lines are kept aside.

    Files are read by the names in their own headers, whatever their order.

    Raises on a missing header column. The first data row of a file is row 2.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    firsts = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "id").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
    df = None
    for row in firsts.orderBy("head").collect():  # one row per spelling of the header
        header = next(csv.reader([row["head"].lstrip("\ufeff")]))
        missing = sorted(set(columns) - set(header))
        if missing:
            raise ValueError("MissingColumns: " + ", ".join(missing))
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField("_corrupt", T.StringType())])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        part = reader.csv(row["files"]).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if df is None:
        raise ValueError("MissingColumns: " + ", ".join(sorted(columns)))
    placed = df.withColumns({"_mid": F.monotonically_increasing_id()})
    # Rows keep their order inside a file block, so a row's number is its place
    # in the block plus the rows of the earlier blocks: one small table per file.
    blocks = placed.groupBy("source_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = placed.join(blocks, ["source_file", "_block"])
    return numbered.withColumn("row_number", F.col("_mid") - F.col("_first") + F.col("_before") + 2).drop("_block", "_mid", "_first", "_n", "_before")


LISTING = "struct<results: array<struct<id: bigint, title: string, date: string, code: string, number: int, year: int, status: struct<name: string>, committee: struct<name: string, house: struct<name: string>>, body: string, events: array<struct<type: string, date: string, title: string>>, attendance: array<struct<attendance: string, member: struct<name: string, party: struct<name: string>>>>>>, count: bigint, next: string>"


def parse_listing(payloads: DataFrame, body: str) -> DataFrame:
    """S-03: one row per record of a JSON listing page; page facts stay alongside."""
    df = payloads.withColumn("_j", F.from_json(F.col(body), LISTING))
    return df.select(
        *[c for c in payloads.columns if c != body], F.col("_j.count").alias("total"), F.col("_j.next").alias("next_page"), F.explode("_j.results").alias("r")
    ).where("r.id is not null")


def bills_of(listing: DataFrame, site: str) -> DataFrame:
    """S-03: bill records; drafts without a number carry none."""
    return listing.select(
        F.col("r.id").alias("id"), F.coalesce("r.title", F.lit("Untitled bill")).alias("title"), F.when(F.col("r.number").isNotNull(), F.col("r.code")).alias("bill_number"),
        F.col("r.year").alias("year"), text.keyword_case(F.col("r.status.name"), vocab.BILL_STATUS_KEYWORDS, "unknown").alias("status"),
        F.concat(F.lit(site + "/bill/"), F.col("r.id").cast("string"), F.lit("/")).alias("source_url"),
    )


def bill_events_of(listing: DataFrame, description_length: int | None = None) -> DataFrame:
    """S-04: events of the listed bills; descriptions are cut if ``description_length`` is given."""
    told = F.col("e.title") if description_length is None else F.left("e.title", F.lit(description_length))
    df = listing.select(F.col("r.id").alias("bill_id"), F.explode("r.events").alias("e"))
    return df.select(
        "bill_id", F.coalesce(F.nullif("e.type", F.lit("")), F.lit("unknown")).alias("event_type"), dates.iso_prefix(F.col("e.date")).alias("event_date"),
        F.nullif(told, F.lit("")).alias("description"),
    )


def attendance_of(listing: DataFrame) -> DataFrame:
    """S-04: attendance of the listed meetings; a code not in the map means unknown."""
    df = listing.select(F.col("r.id").alias("meeting_id"), F.explode("r.attendance").alias("a")).where("coalesce(a.member.name, '') <> ''")
    return df.select(
        "meeting_id", F.col("a.member.name").alias("name_raw"), F.col("a.member.party.name").alias("party_name"),
        text.code_map(F.col("a.attendance"), vocab.ATTENDANCE_CODES, "unknown").alias("attendance_status"), F.lit(1.0).alias("confidence"),
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """S-05: addresses of a text file, blanks and comment lines dropped."""
    return url_lines(spark.read.text(path), "value")


def url_lines(lines: DataFrame, col: str) -> DataFrame:
    """S-05 over lines that are already loaded."""
    return lines.select(F.trim(F.col(col)).alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def merged_urls(existing: DataFrame, found: DataFrame) -> DataFrame:
    """S-06: sorted union without repeats."""
    return existing.select("url").union(found.select("url")).distinct().orderBy("url")


def write_url_list(urls_df: DataFrame, path: str) -> None:
    """S-06: the merged list as range-partitioned, sorted text files."""
    urls_df.select(F.col("url").alias("value")).write.mode("overwrite").text(path)


def archive(records: DataFrame, url: str, source: str, path: str | None = None) -> DataFrame:
    """S-07: raw records under a readable, unique key; written partitioned by source when a path is given."""
    keyed = records.withColumn("archive_key", urls.archive_key(F.col(url)))
    if path:
        keyed.write.mode("append").partitionBy(source).parquet(path)
    return keyed


def inspect(tables: dict[str, DataFrame], samples: int = 3, width: int = 120) -> DataFrame:
    """S-10: rows of each table plus a few short sample values of its telling columns."""
    shown = ("id", "title", "name", "full_name", "display_name", "status", "source_url", "url", "slug")
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit("count").alias("field"), F.col("n").cast("string").alias("value"))
        cols = [c for c in shown if c in df.columns]
        pick = df.select(*cols).orderBy(*cols).limit(samples)
        cells = pick.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.left(F.col(c).cast("string"), F.lit(width)).alias("value")) for c in cols])).alias("x"))
        part = n.unionByName(cells.select(F.lit(name).alias("table_name"), "x.field", "x.value"))
        out = part if out is None else out.unionByName(part)
    return out
