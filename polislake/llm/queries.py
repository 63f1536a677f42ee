"""Queries of the package: one per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polislake.llm import chat_format, decontaminate, html_extract, line_dedup, packing, pii, prefix_trie, quality_rules, secret_scan, structure_repair, toxicity, url_filter
from polislake.llm.common import table
from polislake.llm.near_dedup import near_duplicates

ORACLE: dict[str, str] = {}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: four-word shingles, similarity of at least 80 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points found in five or more documents stay in the largest id only."""
    judged = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat_format.read_back(chat_format.format_chats(chats.unionByName(probe)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat_format.learned_text(F.col("formatted"), F.col("loss"))
    out = back.select(F.col("_conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), learned.alias("learned"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: Host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the listed rules, and by rules mined from the URLs that those decide."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select(F.col("_id").alias("page_id"), "host", "path", "rule", "verdict")


#: Keys that providers mark, whole values.
PROVIDER_KEYS = r"^((?i:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|[srp]k_(live|test)_[A-Za-z0-9]{16,}|sk-(?=.*[0-9])[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,})$"
#: A key word, then ``=`` or ``:``, then nothing but quotes before the value.
ASSIGNMENT = r"(?i)(passw(or)?d|passwd|pwd|token|secret|api[_-]?key|credential|private[_-]?key|access[_-]?key)[\w-]*[\"'`\])]*\s*[=:][=:>]*\s*[\"'`]*$"
#: Letters and digits mixed in one run, as in keys and digests.
MIXED = r"(?=[A-Za-z0-9+]*[0-9])(?=[A-Za-z0-9+]*[A-Za-z])[A-Za-z0-9+]{16,}"


def known_format() -> Column:
    """Labels of candidates: 1 for provider keys and assigned hex strings of any case, null where the form does not
    tell (other assigned values, mixed letters and digits), 0 for the rest, words and plain numbers."""
    assigned = F.regexp_like(F.concat_ws(" ", "before", F.call_function("substring_index", F.col("word"), F.col("value"), F.lit(1))), F.lit(ASSIGNMENT))
    secret = F.regexp_like("value", F.lit(PROVIDER_KEYS)) | (assigned & F.regexp_like("value", F.lit("(?i)^[0-9a-f]{16,}$")))
    unknown = assigned | F.regexp_like("value", F.lit(MIXED))
    return F.when(secret, 1).when(~unknown, 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the candidates, those the forest removes, and the places of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan_secrets(docs, label=known_format())
    place = F.concat_ws(":", F.col("start"), F.col("start") + F.col("length"))
    each = found.groupBy("_id").agg(F.count("*").alias("n"), F.count_if("secret").alias("s"), F.array_sort(F.collect_list(F.when(F.col("secret"), F.struct("start", place.alias("at"))))).alias("places"))
    out = docs.select("doc_id").distinct().join(each, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", F.coalesce("n", zero).alias("n_candidates"), F.coalesce("s", zero).alias("n_secrets"), F.coalesce(F.array_join("places.at", ","), F.lit("")).alias("places"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4,096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, edits of up to 5 % of its length included."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the line labels for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, model)
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in quality_rules.COUNTS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_content_share").alias("content_share"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("_main_text").alias("text"), F.col("_n_chars").alias("n_chars"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base patterns, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.select("doc_id", *[F.col(f"_n_{k}").alias(f"n_{k}") for k in pii.KINDS], F.col("_base_sha256").alias("base_sha256"), F.col("_spans").alias("spans"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all prefixes of the rebuilt conversations."""
    turns = prefix_trie.turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(prefix_trie.grafted(turns))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation after damage."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = structure_repair.repaired(structure_repair.damaged(structure_repair.rows_of(chats)))
    return fixed.toDF("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and toxic places of every document; the labels of one fifth of the ids are held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out))
    found = toxicity.find_toxic(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_toxic_spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_secret_scan, op3_html_extraction, op4_quality_rules, op5_line_dedup, op6_url_filter, op7_chat_format, op8_pii, op9_best_fit_packing, op10_benchmark_decontamination,
    op11_conversation_prefix_trie, op12_conversation_repair, op13_toxicity)}
ORACLE |= {"op5_line_dedup": line_dedup.ORACLE, "op7_chat_format": chat_format.ORACLE, "op11_conversation_prefix_trie": prefix_trie.ORACLE, "op12_conversation_repair": structure_repair.ORACLE}
