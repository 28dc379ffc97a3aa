"""License scans by diagonal voting, by DataFrame functions only.

Templates are base phrases, notices of common licenses and whole texts of short ones (a fixed, small table). Every window of K
words of every text is joined by its rolling hash (a hash of its words' hashes) with the windows of the templates. A match at
word i of the text and word j of a template votes for the diagonal i - j: a template that stands at one place gives all its
votes to one diagonal, whatever else matches by chance. Insertions and deletions move votes to diagonals near by, so
neighbouring diagonals are merged. A merged diagonal's span is verified by the share of the template's windows that it
covers, each counted once; windows that meet by their hashes are compared word by word, so votes are exact.

A base phrase stands where one diagonal has all of its windows.

Only matches are shuffled, with one row for each document. Edge cases: null text counts as empty and gives no words; fewer
words than a window match nothing; repeated rows are counted and given back as often; labels of the input and other columns
are ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import documents
from terrane.llm.license_texts import BASE, NOTICES, TEXTS

K = 3
NEAR = 4  # words by which diagonals of one span may differ
COVER = 0.6  # share of a template's windows for its label
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def words(text: F.Column) -> F.Column:
    """Words of a text with A-Z folded, as an array."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, SPLIT), lambda w: w != "")


def listed(base: dict[str, str], notices: dict[str, str], whole: dict[str, str]) -> list[tuple[int, str, bool, list[str]]]:
    """Number, label, whether it is a base phrase, and words of each template."""
    rows = [*((p, label, True) for p, label in base.items()), *((t, label, False) for label, t in (*notices.items(), *whole.items()))]
    return [(n, label, is_base, [w for w in re.split(SPLIT, text.lower()) if w]) for n, (text, label, is_base) in enumerate(rows)]


def gram(w: str, i: F.Column) -> F.Column:
    """The words of the window of K words from i on."""
    return F.concat_ws(" ", *(F.get(w, i + n) for n in range(K)))


def rolled(h: str, i: F.Column) -> F.Column:
    """The rolling hash of the window from i on, from a column of the words' hashes."""
    return F.xxhash64(*(F.get(h, i + n) for n in range(K)))


def templates(spark, base: dict[str, str], notices: dict[str, str], whole: dict[str, str]) -> DataFrame:
    """template, label, is_base, size (windows), j, key, template_gram: bounded by the constants given."""
    rows = [(n, label, is_base, len(w) - K + 1, w) for n, label, is_base, w in listed(base, notices, whole)]
    known = spark.createDataFrame(rows, "template int, label string, is_base boolean, size int, w array<string>")
    known = known.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return known.select("template", "label", "is_base", "size", "j", rolled("h", F.col("j")).alias("key"), gram("w", F.col("j")).alias("template_gram"))


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, cover (the best of any diagonal) and spans for each row of docs(doc_id, text).

    spans: array of (label, is_base, first, last, cover) in words; base spans are exact places, the others are merged
    diagonals whose cover of the template is at least COVER.
    """
    known = templates(docs.sparkSession, *(own if given is None else given for given, own in ((base, BASE), (notices, NOTICES), (whole, TEXTS))))
    keys = sorted({r["key"] for r in known.select("key").collect()})  # of the templates: a fixed number
    # Columns, not nested expressions, as a lambda's body is evaluated whole for each element.
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    places = F.filter(F.transform("h", lambda _, i: i), lambda i: rolled("h", i).isin(keys))  # a hash set's look-up for each window
    window = lambda i: F.struct(i.alias("i"), rolled("h", i).alias("key"), gram("w", i).alias("gram"))
    # The first element stands for the document itself and matches nothing, so that each row has one that stays.
    none = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("gram"))
    grams = texts.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(none), F.transform(places, window))).alias("x"))
    grams = grams.select("doc_id", "mark", "n_words", "x.i", "x.key", "x.gram")
    same = (grams["key"] == known["key"]) & (grams["gram"] == known["template_gram"])
    hits = grams.join(F.broadcast(known), same, "left").where("template is not null or i < 0")  # broadcast: a fixed size
    row, span = ["doc_id", "mark"], ["template", "label", "is_base", "size"]
    votes = hits.groupBy(*row, *span, (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("i") < 0).alias("rows"), F.collect_set("j").alias("seen"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    along = Window.partitionBy(*row, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    fresh = F.col("is_base") | F.coalesce(gap > NEAR, F.lit(True))
    votes = votes.withColumn("run", F.sum(fresh.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy(*row, *span, "run").agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.col("size")).alias("cover"),
    )
    good = F.col("cover") >= F.when(F.col("is_base"), 1.0).otherwise(COVER)
    found = F.when(good, F.struct("first", (F.col("last") + K - 1).alias("last"), "label", "is_base", "cover"))
    whole = merged.groupBy(*row).agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("cover"), F.array_sort(F.collect_list(found)).alias("spans")
    )
    return whole.select("doc_id", "n_words", "cover", "spans", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    places = F.filter("spans", lambda s: s["is_base"])
    starts = F.transform(places, lambda s: s["first"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(places).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.col("cover").alias("score"),
    )


QUERIES = {"op10_license_scan": op10_license_scan}
