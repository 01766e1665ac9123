import zlib

import numpy as np
import public_tokenizers
import pytest

from dashframe.llm import token_files
from tests.llm.helpers import docs, odd_rows, row

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n // 8) * bits
        assert (token_files.unpack(data, n, bits) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50257, 3 * token_files.BLOCK + 17).astype(np.int32)
    lengths = [1, 5000, 0, len(ids) - 5001]
    path = str(tmp_path / "a.ids")
    token_files.write_shard(path, [3, 4, None, 9], lengths, ids, 16)
    shard = token_files.Shard(path)
    assert shard.n_ids == len(ids) and shard.starts.tolist() == [0, 1, 5001, 5001, len(ids)]
    for a, n in [(0, 1), (0, len(ids)), (4095, 2), (8192, 4096), (len(ids) - 1, 1), (5, 0)]:
        assert (shard.ids(a, n) == ids[a:a + n]).all()
    shard.close()


def test_files_hold_every_document(spark, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    rows = odd_rows() + [row(50 + i, "more text %d " % i * i) for i in range(30)]
    manifest = token_files.write(docs(spark, rows), PATH)
    got = token_files.read(manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for r in order:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_no_rows(spark):
    assert token_files.read(token_files.write(docs(spark, []), PATH)).collect() == []


def test_known_words_are_not_encoded_again(monkeypatch):
    import pyarrow as pa
    texts = pa.array([f"stone{i} river{i % 7} été 東京 x{i % 3}" for i in range(300)])
    fresh = token_files._Encoder(PATH)
    ids, offsets = fresh.texts(texts)
    called = []
    monkeypatch.setattr(fresh, "batch", lambda names, _f=fresh.batch, **kw: (called.extend(names), _f(names, **kw))[1])
    again, _ = fresh.texts(texts)
    assert (again == ids).all()
    assert not any("river" in n or "東京" in n for n in called)   # first words of texts are no part of this
    # Too many to keep: those of the last slice stay, and nothing changes.
    monkeypatch.setattr(token_files, "KNOWN", 400)
    small = token_files._Encoder(PATH)
    for k in (40, 3, 300, 5):
        got, at = small.texts(texts.slice(0, k))
        assert (got == ids[:offsets[k]]).all() and (at == offsets[:k + 1]).all()
        assert small.known[0].nbytes <= 400 and len(small.known[2]) == len(small.known[0])
        assert small.known[2].sum() == len(small.known[1])
