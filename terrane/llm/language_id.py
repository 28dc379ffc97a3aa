"""Language identification by words first, then ever shorter character n-grams.

Training counts words and character n-grams (orders 4 to 1, with word edges marked) of a bounded sample of labelled rows:
at most ``per_language`` whole texts of each label, chosen by a hash of doc_id. All that the sample teaches is kept, for
every label there is, as 64-bit keys and counts: a sparse table that the sample's size bounds is shipped to every task. A
known word adds its smoothed log frequency in each language; for a word that no language knows, the longest order at which
any of its n-grams is known speaks instead.

A word is a run of letters (Unicode's categories L; digits, fractions and other numerals part words).

Edge cases: null text or text without a letter gives ``und`` with score 0; so does every text where nothing was learned;
very long texts are read whole; ties go to the first language in code-point order; columns lang_pred and score of the
input are replaced, other columns pass; repeated rows get equal results.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import U64, documents, mix, prefix_hash, runs, span_hash, trim, utf8



def _numerals() -> str:
    """Ranges of the characters that are alphanumeric but neither letters nor decimal digits, as a regular expression's class."""
    odd = [i for i in range(sys.maxunicode + 1) if (c := chr(i)).isalnum() and not c.isalpha() and not c.isdecimal()]
    runs_of = ([i for _, i in g] for _, g in groupby(enumerate(odd), lambda x: x[1] - x[0]))
    return "".join(f"{chr(g[0])}-{chr(g[-1])}" for g in runs_of)


WORD = re.compile(rf"[^\W\d_{_numerals()}]+")
ORDERS = (4, 3, 2, 1)
BLOCK = 2 << 20
SCORES = 8 << 20  # scores of words (a word in a language) that a task keeps or adds at once
CHUNK = 2_000  # words looked up together


def keys(words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words (kind 0) or of their n-grams (kind n), and for each key the place of its word."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    prefix = prefix_hash(np.arange(len(codes)), mix(codes.astype(U64) * U64(0x9E3779B97F4A7C15)))
    size = np.fromiter(map(len, words), np.int64, len(words))
    count = np.ones_like(size) if kind == 0 else size if kind == 1 else np.maximum(size + 3 - kind, 0)
    owner = np.repeat(np.arange(len(words)), count)
    first = np.cumsum(size + 2) - size - 2 + (kind < 2)  # orders over 1 take in the word's edges
    start = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    return span_hash(prefix, start, start + (kind or size[owner])), owner


def _counted(column: dict[str, int]):
    """kind (0: words, n: n-grams of order n), lang, key, n: counts of the sample."""

    def run(batches):
        for b in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, c in counts.items():
                words, times = list(c), np.fromiter(c.values(), np.int64, len(c))
                for i in range(0, len(words), CHUNK):
                    for kind in (0, *ORDERS):
                        found, owner = keys(words[i : i + CHUNK], kind)
                        items, at = np.unique(found, return_inverse=True)
                        n = np.zeros(len(items), np.int64)
                        np.add.at(n, at, times[i : i + CHUNK][owner])
                        same = [np.full(len(items), kind, np.int8), np.full(len(items), column[lang], np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, items.view(np.int64), n)], ["kind", "lang", "key", "n"])

    return run


class Model:
    """Log frequencies of known items: for each kind the sorted keys, and of each key the languages that know it, with counts.

    An entry (a key in a language) takes 10 bytes, a key 16 more; rows over all languages are made when they are asked for.
    """

    def __init__(self, languages: list[str], kind: np.ndarray, lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.languages, self.kinds = languages, []
        order = np.lexsort((lang, key, kind))
        ends = np.searchsorted(kind[order], np.arange(ORDERS[0] + 2))
        for k in (0, *ORDERS):
            rows = order[ends[k] : ends[k + 1]]
            items, starts = np.unique(key[rows], return_index=True)
            total = np.zeros(len(languages))
            np.add.at(total, lang[rows], n[rows])
            self.kinds.append((items, np.append(starts, len(rows)), lang[rows].astype(np.int16 if len(languages) < 1 << 15 else np.int32), n[rows], total + 0.5 * (len(items) + 1)))

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, a column for each language."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for kind, (items, starts, lang, n, total) in zip((0, *ORDERS), self.kinds):
            if not len(left) or not len(items):
                continue
            asked, owner = keys([words[i] for i in left.tolist()], kind)
            at = np.searchsorted(items, asked).clip(0, len(items) - 1)
            known = items[at] == asked
            at, owner = at[known], left[owner[known]]
            logs = np.full((len(at), len(self.languages)), 0.5)
            size = starts[at + 1] - starts[at]
            entry = np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            logs[np.repeat(np.arange(len(at)), size), lang[entry]] += n[entry]
            np.add.at(out, owner, np.log(logs / total))
            some = np.bincount(owner, minlength=len(words))
            out[some > 0] /= some[some > 0, None]
            left = left[some[left] == 0]
        return out


def train(labelled: DataFrame, per_language: int = 1500) -> Model:
    """Fit on labelled(doc_id, text, lang): all that at most per_language texts of a language teach.

    The driver holds a row for each label and the sample's counts.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not totals:
        return Model([], *(np.empty(0, t) for t in (np.int8, np.int32, U64, np.int64)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))
    # A little more than asked for, then cut exactly.
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, int(min(1.0, 1.2 * per_language / n) * (1 << 30)))))
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
    best = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    sample = drawn.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_language)
    sample = sample.select("lang", "text").repartition(16)
    languages = sorted(totals)
    counts = sample.mapInArrow(_counted({x: i for i, x in enumerate(languages)}), "kind byte, lang int, key long, n long")
    counts = counts.groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow()  # 21 bytes an entry; the sample bounds them
    kind, lang, key, n = (counts.column(c).to_numpy() for c in ("kind", "lang", "key", "n"))
    return Model(languages, kind, lang, key.view(U64), n)


class _Words(dict):
    """word -> row of a growing matrix of scores, forgotten when it has SCORES of them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.empty((1024, len(model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of the words, a group of at most SCORES of them; unknown ones are learned."""
        new = [w for w in words if w not in self]
        if (len(self) + len(new)) * self.rows.shape[1] > SCORES:
            self.clear()
            new = words
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            first, last = len(self), len(self) + len(part)
            if last > len(self.rows):
                self.rows = np.concatenate((self.rows, np.empty((max(len(self.rows), len(part)), self.rows.shape[1]))))
            self.rows[first:last] = self.model.words(part)
            self.update(zip(part, range(first, last)))
        return self.rows[[self[w] for w in words]]


def _summed(cache: _Words, counts: list[Counter], sums: np.ndarray) -> None:
    """Adds to each text's row of sums its words' scores, as often as they occur; distinct words are looked up once."""
    number: dict[str, int] = {}
    word = np.array([number.setdefault(w, len(number)) for c in counts for w in c], np.int64)
    if not len(word):
        return
    times = np.array([n for c in counts for n in c.values()], np.float64)
    text = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    most, names = max(1, SCORES // sums.shape[1]), list(number)
    order = np.argsort(word // most, kind="stable")  # groups of words; texts stay in order inside them
    ends = np.searchsorted(word[order] // most, np.arange(-(-len(names) // most) + 1))
    for g in range(len(ends) - 1):
        rows = cache.of(names[g * most : (g + 1) * most])
        for i in range(ends[g], ends[g + 1], most):
            part = order[i : min(i + most, ends[g + 1])]
            starts = np.flatnonzero(np.concatenate(([True], text[part][1:] != text[part][:-1])))
            sums[text[part][starts]] += np.add.reduceat(rows[word[part] - g * most] * times[part, None], starts, axis=0)


def _identified(shipped, names: list[str], text: str):
    def run(batches):
        model = shipped.value
        cache, names_of = _Words(model), np.array([*model.languages, "und"], object)
        for b in batches:
            pred, score = [], []
            for i, j in runs(utf8(b.column(text))[1], BLOCK):
                counts = [Counter(WORD.findall(t.lower()) if t and model.languages else ()) for t in b.column(text).slice(i, j - i).to_pylist()]
                some = np.array([len(c) > 0 for c in counts])
                sums = np.zeros((j - i, max(1, len(model.languages))))
                _summed(cache, counts, sums)
                best = np.where(some, sums.argmax(1), len(model.languages))
                sure = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                pred += names_of[best].tolist()
                score += np.where(some, sure, 0.0).tolist()
            trim()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the posterior of the predicted language under equal priors, 0 to 1."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema.fields)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return docs.select(names).mapInArrow(_identified(shipped, names, text), f"{schema}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs.where(remainder != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
