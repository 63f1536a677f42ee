"""From raw documents to packed sequences; each stage's Parquet output is the next one's input.

1. ``quality_rules`` drops what the base rules or the line labels reject.
2. ``line_dedup`` takes repeated lines out of all documents but one.
3. ``near_dedup`` keeps one document of each group of near duplicates.
4. ``decontaminate`` drops documents that hold a benchmark item.
5. ``pack`` tokenises what is left and packs it into sequences.

All but the last return the columns of documents; a row without id passes
stages 2 to 4 unless a text rule rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polislake.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from polislake.llm.common import stored, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, model)
    return judged.filter("_kept").select(*[f"`{c}`" for c in docs.columns])


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(docs)
    new = {"text": F.col("_kept"), "n_chars": F.when(F.col("_dropped") > 0, F.char_length("_kept").cast("bigint")).otherwise(F.col("n_chars"))}
    return kept.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_dedup.near_duplicates(docs).filter("not kept").select(F.col("_id").alias("doc_id"))
    return docs.join(dropped, "doc_id", "left_anti")


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("quality_rules", _quality), ("line_dedup", _lines), ("near_dedup", _near), ("decontaminate", _clean), ("pack", _pack)]

#: The line labels, the similarity, the edit distance and the tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
