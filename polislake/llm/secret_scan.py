"""Secret scan: long words are candidates, a random forest removes the false ones.

A candidate is a run of at least ``least`` of the characters ``[A-Za-z0-9+/_-]``
inside a word that has room for it. Its features: length, share of digits,
capitals and letters, changes of character class, mean log-likelihood of its
character bigrams under the bigrams of ordinary words, share of its letters
covered by dictionary words (words common in the corpus, counted over all
documents), the path of the document, and the neighbouring words (a key word
nearby, an assignment before it, a quote around it, the neighbours' own
dictionary coverage). The forest of Spark ML is trained on labelled findings,
a bounded sample (``max_labelled``, lowest hashes first).

Only DataFrame functions and Spark ML are used. The dictionary meets the
candidates' parts by an equality join; parts are made distinct first, so a hot
word is one row.

Defined cases: null and empty texts have no candidates; a row without id gets a
row of its own with a null id; repeated rows give repeated results; a null path
is empty; without labelled findings of both kinds nothing is removed; an empty
table gives an empty result; other columns are not read. The value of a secret
never leaves the operator, only its place.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polislake.functions.arrays import starts
from polislake.llm.common import LOWER, UPPER, bind, lowest, pick, slice_starts, start_at, stored

CANDIDATE = r"[A-Za-z0-9+/_-]"
# Words that announce a secret, and path parts of examples and tests.
KEY_WORDS = r"(?i)passw|pwd|secret|token|api_?key|auth|bearer|credential|private|AKIA|ASIA"
EXAMPLE_PATHS = r"(?i)test|example|sample|fixture|mock|doc"
FEATURES = ["length", "digits", "capitals", "letters", "changes", "likelihood", "covered", "depth", "example", "keyed", "assigned", "quoted", "neighbours"]


def candidates(docs: DataFrame, least: int) -> DataFrame:
    """``(_row, _path, start, value, word, before, after)``; ``start`` counts code points."""
    # One white-space character parts two words, so that places can be summed up.
    words = bind(docs.filter(F.regexp_like("_text", F.lit(f"{CANDIDATE}{{{least}}}"))), "_words", F.split("_text", r"[\x20\x09-\x0D]", -1))
    words = bind(words, "_sizes", F.transform("_words", lambda w: F.char_length(w) + F.lit(1).cast("bigint")))
    words = bind(words, "_before", slice_starts(F.col("_sizes")))
    # Only a candidate's own struct is spread out, never the arrays of its text.
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_sizes", i) > least)
    near = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    place = F.transform(at, lambda i: F.struct(near(i).alias("word"), start_at(F.col("_sizes"), F.col("_before"), i).alias("_start"), F.concat_ws(" ", near(i - 2), near(i - 1)).alias("before"), near(i + 1).alias("after")))
    found = words.select("_row", "_path", F.explode(place).alias("_at")).select("_row", "_path", "_at.*").filter(F.regexp_like("word", F.lit(f"{CANDIDATE}{{{least}}}")))
    # A word's parts and what stands before each, in one pass over the word.
    found = bind(found, "_parts", F.regexp_extract_all("word", F.lit(f"{CANDIDATE}{{{least},}}"), F.lit(0)))
    found = bind(found, "_between", F.transform(F.slice(F.split("word", f"{CANDIDATE}{{{least},}}", -1), F.lit(1), F.size("_parts")), lambda x: F.char_length(x).cast("bigint")))
    before = F.zip_with(starts(F.zip_with("_between", "_parts", lambda gap, part: gap + F.char_length(part))), "_between", lambda s, gap: s + gap)
    found = found.select("_row", "_path", "word", "_start", "before", "after", F.explode(F.arrays_zip(F.col("_parts").alias("value"), before.alias("lead"))).alias("_part"))
    return found.select("_row", "_path", "word", "before", "after", F.col("_part.value").alias("value"), (F.col("_start") + F.col("_part.lead")).alias("start"))


def bigram_table(words: DataFrame) -> list[float]:
    """Log-likelihood of the second of two characters given the first, 40 x 40, from ``(word, n)``."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    pairs = pairs.groupBy(_code(F.substring("pair", 1, 1)).alias("a"), _code(F.substring("pair", 2, 1)).alias("b")).agg(F.sum("n").alias("n"))
    counts = [1.0] * 1600
    for r in pairs.collect():  # 1,600 rows at most
        counts[r["a"] * 40 + r["b"]] += r["n"]
    from math import log

    return [log(counts[i] / sum(counts[i // 40 * 40 : i // 40 * 40 + 40])) for i in range(1600)]


def _code(ch: Column) -> Column:
    """Letters 1-26 whatever their case, digits 27-36, others 0."""
    return F.instr(F.lit(LOWER + "0123456789"), F.lower(ch)).cast("int")


def dictionary(docs: DataFrame, share: float) -> DataFrame:
    """Words of three or more letters a-z found in at least that share of all documents, with their number."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^a-z]+", -1))).alias("word")).filter(F.char_length("word") >= 3)
    total = docs.count()
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2.0, share * total))


def _classes(c: Column) -> Column:
    return F.translate(c, LOWER + UPPER + "0123456789+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "....")


def features(found: DataFrame, known: DataFrame, likely: list[float]) -> DataFrame:
    """``found`` with the columns FEATURES."""
    size = F.char_length("value")
    kinds = bind(found, "_kinds", _classes(F.col("value")))
    count = lambda ch: F.char_length(F.regexp_replace("_kinds", f"[^{ch}]", "")) / F.char_length("_kinds")
    changes = F.char_length(F.regexp_replace("_kinds", r"(.)\1+", "$1")) - 1
    codes = bind(kinds, "_codes", F.transform(F.split("value", "(?!^)", -1), _code))
    table = bind(codes, "_likely", F.array(*[F.lit(x) for x in likely]))
    steps = F.aggregate(F.sequence(F.lit(0), F.size("_codes") - 2), F.lit(0.0), lambda a, i: a + F.get("_likely", F.get("_codes", i) * 40 + F.get("_codes", i + 1)))
    rows = table.select(
        "_row", "start", "value", "word", "before", "after",
        size.cast("double").alias("length"), count("0").alias("digits"), count("A").alias("capitals"), count("aA").alias("letters"), (changes / size).alias("changes"), (steps / size).alias("likelihood"),
        F.size(F.split("_path", "/", -1)).cast("double").alias("depth"), F.regexp_like("_path", F.lit(EXAMPLE_PATHS)).cast("double").alias("example"),
        F.regexp_like(F.concat_ws(" ", "before", "word"), F.lit(KEY_WORDS)).cast("double").alias("keyed"),
        F.regexp_like(F.concat_ws(" ", "before", "word"), F.lit(r"[=:]")).cast("double").alias("assigned"), F.regexp_like("word", F.lit("[\"'`]")).cast("double").alias("quoted"),
    )
    rows = stored(rows.withColumn("_key", F.xxhash64("_row", "start")), "candidates")
    own = rows.select("_key", F.lit(0).alias("side"), F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    near = rows.select("_key", F.lit(1).alias("side"), F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    parts = own.unionByName(near)
    used = parts.select("word").distinct().join(known.select("word"), "word")
    hit = parts.join(used, "word").groupBy("_key").agg(F.sum(F.when(F.col("side") == 0, F.char_length("word"))).alias("own"), F.sum(F.when(F.col("side") == 1, F.char_length("word"))).alias("near"))
    zero = F.lit(0.0)
    around = F.greatest(F.char_length("before") + F.char_length("after"), F.lit(1))
    return rows.join(hit, "_key", "left").withColumns({"covered": F.coalesce(F.col("own") / F.col("length"), zero), "neighbours": F.coalesce(F.col("near") / around, zero)}).drop("own", "near")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least: int = 16, share: float = 0.0005,
                 label: Column | None = None, max_labelled: int = 20_000, seed: int = 7) -> DataFrame:
    """``(_id, start, length, kind_score, secret)``: every candidate with the forest's verdict.

    ``findings``: labelled findings ``(id, start, label)``, label 1 for a secret and 0 for a
    false positive. Without them ``label``, a column over (value, word,
    before), labels the candidates of the sample; null leaves one out.
    """
    docs = pick(docs, _id=(id_col, "bigint"), _text=(text_col, "string"), _path=(path_col, "string")).withColumn("_path", F.coalesce("_path", F.lit("")))
    docs = docs.withColumn("_row", F.struct("_id", F.xxhash64("_text").alias("mark")))
    known = stored(dictionary(docs, share), "dictionary")
    rows = stored(features(candidates(docs.select("_row", "_path", "_text"), least), known, bigram_table(known)), "features")
    if findings is None:
        labelled = rows.withColumn("_label", label.cast("double"))
    else:
        given = pick(findings, _fid=(id_col, "bigint"), _at=("start", "bigint"), _label=("label", "double"))
        labelled = rows.join(given, (rows["_row"]["_id"] == given["_fid"]) & (rows["start"] == given["_at"]))
    sample = lowest(labelled.filter("_label is not null").select(*FEATURES, "_label", "_key"), max_labelled, "_key")
    sample = stored(sample.coalesce(1), "labelled")
    kinds = {r[0] for r in sample.select("_label").distinct().limit(3).collect()}
    rows = rows.select("_key", F.col("_row._id").alias("_id"), "start", F.col("length").cast("bigint").alias("length"), *[c for c in FEATURES if c != "length"], F.col("length").alias("_length"))
    if not {0.0, 1.0} <= kinds:
        return rows.select("_id", "start", "length", F.lit(1.0).alias("score"), F.lit(True).alias("secret"))
    vector = VectorAssembler(inputCols=["_length" if c == "length" else c for c in FEATURES], outputCol="_vector")
    forest = RandomForestClassifier(featuresCol="_vector", labelCol="_label", numTrees=30, maxDepth=8, seed=seed, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_said")
    model = forest.fit(vector.transform(sample.withColumnRenamed("length", "_length")))
    judged = model.transform(vector.transform(rows)).withColumn("score", vector_to_array("_p")[1])
    return judged.select("_id", "start", "length", "score", (F.col("score") >= 0.5).alias("secret"))
