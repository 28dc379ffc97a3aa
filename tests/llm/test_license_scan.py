import re

from helpers import awkward, table
from pyspark.sql import functions as F

from terrane.llm.license_scan import op10_license_scan, scan
from terrane.llm.license_texts import BASE, NOTICES, TEXTS


def base(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(at)


def texts():
    mit, apache = NOTICES["mit"].split(), NOTICES["apache-2"]
    return [
        "Released under the MIT License. Under THE mit-license, under the mit  licenses",
        "x CC BY-NC 4.0 and cc_by_nc; cc by nc cc by nc",
        "Apache License, Version 2.0 apache license version 22 under the mit",
        "the K elvin K ﬀ İ under the mit license",
        " ".join(mit),
        "foo " * 40 + " ".join(mit[:9] + ["gladly"] + mit[9:15] + mit[16:]) + " bar" * 30,
        " ".join(mit[:5]),
        "Licensed under the Apache License, Version 2.0 (the “License”); " + apache.upper(),
        "under the mit license " * 300,
    ]


def test_base_places_and_repeated_rows(spark):
    rows = awkward(1) + [(900 + i, t, None, None, 0, None, None) for i, t in enumerate(texts())]
    rows += rows[-3:] * 2
    clash = table(spark, rows)
    for c in ("mark", "key", "template", "label", "size", "place", "w"):
        clash = clash.withColumn(c, F.lit(1))
    got = scan(clash).collect()
    want = sorted((str(r[0]), *base(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, sorted((s.first, s.label) for s in r.spans if s.is_base)) for r in got) == want


def test_notices(spark):
    got = {r.doc_id: r for r in scan(table(spark, [(i, t, None, None, 0, None, None) for i, t in enumerate(texts())])).collect()}
    labels = {k: {s.label for s in r.spans if not s.is_base} for k, r in got.items()}
    assert labels == {**dict.fromkeys(range(9), set()), 4: {"mit"}, 5: {"mit"}, 7: {"apache-2"}}
    assert [(s.first, s.last) for s in got[5].spans] == [(40, 40 + len(NOTICES["mit"].split()) - 1)]
    assert got[4].cover == 1 and 0 < got[6].cover < 0.3


def test_whole_texts(spark):
    """A license's whole text has its label, alone, wrapped otherwise, with words changed, or in the middle of another text."""
    rows = []
    for k, (label, text) in enumerate(TEXTS.items()):
        w = text.split()
        some = [x if i % 23 else "thing" for i, x in enumerate(w)]
        rows += [(10 * k, text), (10 * k + 1, "\n * ".join(w)), (10 * k + 2, " ".join(some)), (10 * k + 3, "lorem ipsum " * 50 + text.upper() + " dolor" * 70)]
    got = {r.doc_id: r for r in scan(table(spark, [(i, t, None, None, 0, None, None) for i, t in rows])).collect()}
    for k, label in enumerate(TEXTS):
        for i in range(4):
            assert label in {s.label for s in got[10 * k + i].spans}, (label, i)
        assert got[10 * k].cover == 1 and (100, True) in {(s.first, s.cover > 0.9) for s in got[10 * k + 3].spans}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op10_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        n, at = base(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= {"", *r.labels.split(",")}


def test_empty(spark):
    assert scan(table(spark, [])).collect() == []
