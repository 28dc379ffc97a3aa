import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, table

from terrane.llm import token_counts as C


def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(C.default_ranks(), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [1 << 18, 64, 3, 1])
def test_counts(spark, block):
    rows = [r for r in awkward(2) if block > 3 or len(r[1] or "") < 400]
    blocks, order = C.write_token_files(table(spark, rows), C.default_ranks(), public_tokenizers.PATTERN, block=block)
    got = order.join(C.count_tokens(blocks), ["shard", "number"]).select("doc_id", "n_tokens").collect()
    enc = coder()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in rows)


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for f in range(4):
        sizes = rng.integers(0, 40, 30).tolist() + [0, 0, 700, 0]
        ids = np.concatenate([np.append(rng.integers(0, 1000, n), C.END) for n in sizes])
        ids = ids[:-1] if f == 3 else np.append(ids, [5, 6, 7]) if f == 2 else ids
        sizes = [*sizes[:-1]] if f == 3 else [*sizes, 3] if f == 2 else sizes  # an empty open document is none
        ids.astype("<u2").tofile(tmp_path / f"{f}.bin")
        want += [(f, k, n) for k, n in enumerate(sizes)]
    for block in (1 << 10, 16, 5):
        assert sorted(map(tuple, C.count_tokens(C.read_token_files(spark, str(tmp_path), block)).collect())) == want


def test_empty(spark):
    blocks, order = C.write_token_files(table(spark, []), C.default_ranks(), public_tokenizers.PATTERN)
    assert order.join(C.count_tokens(blocks), ["shard", "number"]).collect() == []
