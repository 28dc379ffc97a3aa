"""Small tables with awkward rows, shared by the tests of the operators."""

import random

WORDS = "river stone amber cloud lantern orchard pebble thunder meadow copper violet harbor saddle timber walnut ember".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, node long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(rng.randrange(30))]) for _ in range(n))


def awkward(seed=0, n=60):
    """Rows with copies, near copies, nulls, empty and long texts, repeated rows, and columns whose names may clash."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 3, 7, 12, 20, 40, 90, 300])) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(n):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
        if i % 6 == 0:
            texts.append(f"{prose(rng, 30)}\n{passage} {prose(rng, 20)}")
    texts += [None, "", " ", "\n\t ", "a", "a a a a a a a a", "x" * 700, "ab" * 400, "é" * 300, "Straße 你好 мир 😀 ok", prose(rng, 8000), texts[0], texts[0].upper(), "\x00 nul", "tab\tand  spaces  "]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(t or ""), "s", 7) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5], None, None, 0, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
