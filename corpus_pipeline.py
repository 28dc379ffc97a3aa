"""From raw documents to token ids, in five stages. Each stage is written as Parquet before the next one reads it.

Every stage but the last returns the columns of ``documents`` (doc_id, text, lang, source, n_chars) and ignores others. Rows
are documents of their own, whether or not their doc_id is null or repeated; a stage on an empty table gives an empty one.
Null texts have no letter, so the first stage drops them; alone, the other stages keep them (the second as documents without
words, the third uncut, the fourth as often as a draw says, the last without ids). Ties go to the least doc_id, null last, then
to the least key of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import jaccard_join, language_id, mixing, sentence_pieces, suffix_dedup
from terrane.llm.common import staged
from terrane.operators.shared import row_numbers

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE = 0.5  # least score of a language


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is less likely than not, go; a missing label is filled."""
    found = language_id.identify(docs, language_id.train(docs))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row, a key of each row: doc_id where no two rows share one, else a hash of the row and its number among equals.

    Equal rows stand for each other, so any numbers do, and a group of them is spread over tasks.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    docs = docs.withColumn("hash", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS)))
    docs = staged(docs.withColumn("place", F.monotonically_increasing_id()), "keyed")
    numbers = row_numbers(docs.select("hash", "place"), ["hash"], ["place"])
    numbers = staged(numbers.select("place", F.xxhash64("hash", "n").alias("row")), "numbers")
    return staged(docs.join(numbers, "place").select(*COLUMNS, "row"), "rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the least doc_id stays, null as the last."""
    docs = keyed(docs.select(COLUMNS))
    found = jaccard_join.jaccard_components(docs.withColumn("doc_id", F.col("row")))
    found = staged(found.select(F.col("doc_id").alias("row"), "component_id"), "near")
    own = docs.select("row", "doc_id").join(found.withColumnRenamed("row", "found"), F.col("row").eqNullSafe(F.col("found")))
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"))
    return docs.join(first.select("stays"), F.col("row").eqNullSafe(F.col("stays")), "left_semi").select(COLUMNS)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that strings of 200 bytes found elsewhere cover are cut out, with what they leave of a character at their ends;
    documents of which only white space is left go."""
    found = suffix_dedup.remove_repeats(docs.select(COLUMNS), whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    found = found.withColumn("text", text).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0 to 3 times."""
    docs = keyed(docs.select(COLUMNS))
    mix = mixing.mix_sources(docs.select(F.col("row").alias("doc_id"), "source", mixing.n_words(F.col("text")).alias("size")))
    mix = mix.where("copies > 0").select(F.col("doc_id").alias("taken"), "copies")
    taken = docs.join(mix, docs.row.eqNullSafe(mix.taken))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    found = sentence_pieces.encode(docs.select(COLUMNS), sentence_pieces.default_model())
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("source_mixing", mixing_stage),
    ("sentence_pieces", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
