import math
from collections import Counter

import pytest
from helpers import awkward, table
from pyspark.sql import functions as F

from terrane.llm.language_id import WORD, identify, op1_language_id, train

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op1_language_id(spark, SMALL).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    judged = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    assert judged and sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))


def test_labels_decide(spark):
    rows = [(i, t, lang, "", 0, "", 0) for i, (t, lang) in enumerate([("the cat and the dog", "xx"), ("le chat et le chien", "yy"), ("und der hund", None)] * 5)]
    docs = table(spark, rows)
    got = {r.text: r.lang_pred for r in identify(docs, train(docs)).collect()}
    assert got["the cat and the dog"] == "xx" and got["le chat et le chien"] == "yy"
    unseen = identify(table(spark, [(1, "chienne chatte", None, "", 0, "", 0), (2, "catty doggy", None, "", 0, "", 0)]), train(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in unseen} == {1: "yy", 2: "xx"}


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    got = identify(docs, train(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score"] and got.count() == len(awkward())
    assert got.where("text is null or text in ('', ' ')").where("lang_pred <> 'und' or score <> 0").isEmpty()
    nothing = identify(docs, train(docs.where(F.lit(False))))
    assert {tuple(r) for r in nothing.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    assert identify(table(spark, []), train(docs)).collect() == []


@pytest.mark.parametrize("bound", [1, 3])
def test_bound(spark, bound):
    assert train(table(spark, awkward()), per_language=bound).languages == ["de", "en"]


def test_letters(spark):
    """Numerals of other kinds are no letters, whatever alphanumeric means; they part words."""
    asked = ["²", "½ ① Ⅷ", "x²y", "abc", "٣", "ª", "一", "é", "_", "a_b"]
    assert [WORD.findall(t) for t in asked] == [[], [], ["x", "y"], ["abc"], [], ["ª"], ["一"], ["é"], [], ["a", "b"]]
    docs = table(spark, [(i, "x y abc", "xx", "", 0, "", 0) for i in range(3)])
    got = identify(table(spark, [(i, t, None, "", 0, "", 0) for i, t in enumerate(asked)]), train(docs)).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in got} == {i: not any(c.isalpha() for c in t) for i, t in enumerate(asked)}


def test_many_languages_and_ties(spark, monkeypatch):
    """Each of 300 labels can be predicted; equal evidence goes to the first label; clashing columns are replaced."""
    rows = [(i, f"common {''.join(chr(97 + int(d)) for d in str(1000 + i))}", f"l{i:03}", "", 0, "", 0) for i in range(300)]
    docs = table(spark, rows)
    model = train(docs)
    assert len(model.languages) == 300
    for scores in (8 << 20, 900):
        monkeypatch.setattr("terrane.llm.language_id.SCORES", scores)
        got = identify(docs.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x")), model)
        assert got.columns == [*docs.columns, "lang_pred", "score"] and got.where("lang <> lang_pred").isEmpty()
    (tie,) = identify(table(spark, [(1, "common", None, "", 0, "", 0)]), model).collect()
    assert tie.lang_pred == "l000" and tie.score == pytest.approx(1 / 300)


def brute(rows, text):
    """Scores by language of a text, by the definition: all words and n-grams of the labelled rows count."""

    def grams(w, n):
        return [w] if n == 0 else list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]

    known = {k: {} for k in (0, 4, 3, 2, 1)}
    for _, t, lang, *_ in rows:
        for k, of in known.items():
            of.setdefault(lang, Counter()).update(g for w in WORD.findall(t.lower()) for g in grams(w, k))
    logs = {k: (set().union(*of.values()), {x: sum(c.values()) for x, c in of.items()}) for k, of in known.items()}
    out = dict.fromkeys(sorted(known[0]), 0.0)
    for w in WORD.findall(text.lower()):
        for k, of in known.items():
            if found := [g for g in grams(w, k) if g in logs[k][0]]:
                for x in out:
                    out[x] += sum(math.log((of[x][g] + 0.5) / (logs[k][1][x] + 0.5 * (len(logs[k][0]) + 1))) for g in found) / len(found)
                break
    return out


def test_all_that_the_sample_teaches_counts(spark):
    """30,000 words of one language, each once: the last in order is as well known as the first."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "aei"][:30_000]
    rows = [(i, " ".join(words[i::20]), "xx", "", 0, "", 0) for i in range(20)]
    rows += [(100 + i, t, "yy", "", 0, "", 0) for i, t in enumerate(["zzzi le chat", "é😀 été chat le le", "zz z"])]
    asked = ["rzca", "zyza zyzb", "chat zzzi", "zzzzz", "qxqx ö", "été", "z", "aaaa le"]
    got = identify(table(spark, [(i, t, None, "", 0, "", 0) for i, t in enumerate(asked)]), train(table(spark, rows))).collect()
    assert len(got) == len(asked)
    for r in got:
        want = brute(rows, r.text)
        best = max(want, key=want.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - want[best]) for v in want.values()))
