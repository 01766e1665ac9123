import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dashframe.llm import bpe
from tests.llm.helpers import docs, odd_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


def test_encoding_equals_the_library(library):
    coder = bpe.codec(PATH, PATTERN)
    rng = random.Random(1)
    signs = "ab 's't \n\t  \xa0　\x1c\x85é中文12٣!?.,<|🙂'\r "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "x" * 3000, "né" * 500, " " * 99 + "a", "a" + "\n" * 70]
    ids, ends = coder.encode_all(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(t)
        assert coder.decode(ids[a:b].tolist()) == t.encode()


def test_one_tree_and_many_trees_agree():
    ranks = bpe.read_ranks(PATH)
    coder = bpe.codec(PATH, PATTERN)
    rng = random.Random(2)
    pieces = {bytes(rng.choice(b"aehnorst ") for _ in range(rng.randint(1, 64))) for _ in range(500)}
    assert coder.merge_all(list(pieces)) == {p: bpe.merge(p, ranks) for p in pieces}


def test_chunks_are_the_bytes_of_their_ids(library):
    chunks = ["one", " river's", " x1234é", "\n\n", " qqzxv" * 30, ""]
    got = bpe.codec(PATH, PATTERN).encode_chunks(chunks)
    assert got == [np.array(library.encode_ordinary(c), np.int32).tobytes() for c in chunks]


def test_rows_and_digests(spark, library):
    rows = odd_rows()
    got = bpe.round_trip(docs(spark, rows), PATH, PATTERN).collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_rows(spark):
    assert bpe.round_trip(docs(spark, []), PATH, PATTERN).collect() == []
