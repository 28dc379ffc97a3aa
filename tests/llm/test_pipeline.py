import itertools

import corpus_pipeline as P
import pytest
import sentencepiece
from helpers import awkward, table
from test_jaccard_join import brute as near_brute
from test_suffix_dedup import brute as repeats_brute

from terrane.llm import sentence_pieces
from terrane.llm.language_id import WORD, identify, train


@pytest.fixture
def rows():
    return [r for r in awkward(7) if r[0] is not None]


def cut(text, others):
    """Bytes of text that a string of 200 bytes found elsewhere covers, by definition."""
    t = text.encode()
    seen = {}
    for o in others:
        o = o.encode()
        for i in range(len(o) - 199):
            seen[o[i : i + 200]] = seen.get(o[i : i + 200], 0) + 1
    gone = bytearray(len(t))
    for i in range(len(t) - 199):
        if seen[t[i : i + 200]] > 1:
            gone[i : i + 200] = b"\1" * 200
    return "".join(c for c, at in zip(text, itertools.accumulate([0, *(len(c.encode()) for c in text)])) if not any(gone[at : at + len(c.encode())]))


def test_stages_by_brute_force(spark, rows, tmp_path):
    docs = table(spark, rows).select(P.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    as_rows = lambda df: [tuple(r) for r in df.collect()]
    one = as_rows(P.language_stage(spark, docs, ""))
    scores = {r.text: r for r in identify(docs, train(docs)).collect()}
    assert sorted(r[0] for r in one) == sorted(r[0] for r in rows if WORD.search(r[1] or "") and scores[r[1]].score >= P.SURE)
    assert all(r[2] is not None for r in one)

    frame = spark.createDataFrame(one, docs.schema)
    two = as_rows(P.near_duplicate_stage(spark, frame, ""))
    assert sorted(r[0] for r in two) == sorted({d for d, _, c in near_brute(one) if d == c})

    three = as_rows(P.repeat_stage(spark, spark.createDataFrame(two, docs.schema), ""))
    removed = {d: n for d, _, n, _, _ in repeats_brute(two)}
    want = {r[0]: (cut(r[1], [x[1] for x in two]) if removed[r[0]] else r[1]) for r in two}
    assert {r[0]: r[1] for r in three} == {d: t for d, t in want.items() if t.strip() or not removed[d]}
    assert all(r[4] == len(r[1]) for r in three)

    four = as_rows(P.mixing_stage(spark, spark.createDataFrame(three, docs.schema), ""))
    assert set(four) <= set(three) and all(four.count(r) <= 3 for r in set(four))

    five = P.token_stage(spark, spark.createDataFrame(four, docs.schema), "").collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    assert sorted((r.doc_id, r.ids) for r in five) == sorted((r[0], sp.encode(r[1])) for r in four)
    whole = P.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in whole) == sorted((r.doc_id, r.ids) for r in five)


def test_empty(spark):
    docs = table(spark, []).select(P.COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        docs = table(spark, []).select(P.COLUMNS)


def test_null_and_repeated_ids(spark):
    """Documents of one id, or of none, are told apart: only near copies go, and no copy is multiplied by the join."""
    rows = [r for r in awkward(9) if WORD.search(r[1] or "")]
    some = [(None if i % 3 == 0 else 5 if i % 3 == 1 else 1000 + i, *r[1:5]) for i, r in enumerate(rows)]
    docs = table(spark, [(*r, None, None) for r in some]).select(P.COLUMNS)
    numbers = {i: c for i, _, c in near_brute([(i, *r[1:]) for i, r in enumerate(some)])}
    groups = {}
    for i, c in numbers.items():
        groups.setdefault(c, []).append(some[i])
    two = [tuple(r) for r in P.near_duplicate_stage(spark, docs, "").collect()]
    assert len(two) == len(groups)
    for r in two:
        (group,) = [g for g in groups.values() if r in g]
        assert r[0] == min((x[0] for x in group if x[0] is not None), default=None)

    mixed = [tuple(r) for r in P.mixing_stage(spark, docs, "").collect()]
    assert mixed and all(mixed.count(r) <= 3 * some.count(r) for r in set(mixed)) and set(mixed) <= set(some)


def test_cuts_inside_characters(spark):
    """What a cut leaves of a character goes; a document's own U+FFFD stay, and so does text beside the cut."""
    passage = "é" * 150
    rows = [(1, "\ufffd own " + "ü" + passage + " \ufffd tail", "de", "a"), (2, "other ö" + passage[:-1] + "x", "de", "b"), (3, "\ufffd \ufffd alone", "de", "a")]
    docs = table(spark, [(*r, 0, None, None) for r in rows]).select(P.COLUMNS)
    got = {r.doc_id: r.text for r in P.repeat_stage(spark, docs, "").collect()}
    assert got[3] == rows[2][1] and got[1].startswith("\ufffd own ") and got[1].endswith(" \ufffd tail")
    # The second byte of "ü" and of "ö" differ, their first is that of "é": the repeat begins inside a character.
    assert got == {1: "\ufffd own " + cut_whole(rows[0][1], rows) + " \ufffd tail", 2: "other " + cut_whole(rows[1][1], rows) + "x", 3: rows[2][1]}


def cut_whole(text, rows):
    """Characters of text's middle of which no byte is covered by a string of 200 bytes found elsewhere."""
    texts = [r[1].encode() for r in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    t = text.encode()
    gone = set()
    for i in range(len(t) - 199):
        if seen[t[i : i + 200]] > 1:
            gone |= set(range(i, i + 200))
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if c in "éüö" and not gone & set(range(at, at + n)):
            out.append(c)
        at += n
    return "".join(out)


def test_many_equal_rows(spark):
    """Repeated rows have keys of their own: the near-duplicate stage keeps one, the mix takes each for itself."""
    docs = table(spark, [(None, "one two three four five six", None, None, 0, None, None)] * 30 + [(1, "seven eight", None, "a", 0, None, None)]).select(P.COLUMNS)
    keys = [r.row for r in P.keyed(docs).collect()]
    assert len(set(keys)) == 31 and sorted(keys) == sorted(r.row for r in P.keyed(docs.repartition(2)).collect())
    assert P.near_duplicate_stage(spark, docs, "").count() == 2
