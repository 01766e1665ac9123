"""Token-id files with fixed-width bit packing (operator 7).

A shard file holds the ids of consecutive documents in ascending id order, each
id in as many bits as the vocabulary needs::

    8 bytes   magic "DFPACK01"
    u32       bits per id
    u32       ids per block (a multiple of 8)
    u64       ids
    u64       documents
    u64 each  byte offset of every block, from the start of the file
    i64 each  document id (the least value stands for NULL)
    u64 each  first id of every document within the shard
    ...       blocks: ids packed most significant bit first

All numbers but the packed ids are little-endian.  A block is unpacked by numpy
without a loop over its ids, and any run of ids needs only its own blocks.

Tasks write their shards under names of their own in the shared folder, and
only shards that a successful task reports are read, so lost executors and
repeated attempts leave no trace in the result.

Defined cases: NULL text is the empty text, whose only id is the end id;
documents without an id come first; rows of equal id follow each other by text
and are told apart by their start; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dashframe.llm.common import slices, stored
from dashframe.llm.pretoken import WHITE, pieces
from dashframe.session import shared_dir

MAGIC = b"DFPACK01"
_HEAD = struct.Struct("<8sIIQQ")
BLOCK = 4096
SHARD_IDS = 4 << 20     # a task starts a new shard beyond so many ids
_NO_ID = -(1 << 63)
END = 0
SLICE = 16 << 20        # bytes of text that are reduced to distinct words at once
_RUN = 64               # words encoded in one call
KNOWN = 20 << 20        # bytes of words whose ids a worker keeps, offsets included


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids make ``bits`` bytes; the last group is filled with zeros."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for j in range(8):
        first, last = j * bits, (j + 1) * bits - 1
        for byte in range(first // 8, last // 8 + 1):
            shift = last - (8 * byte + 7)      # of the id against this byte's lowest bit
            x = groups[:, j] >> np.uint64(shift) if shift >= 0 else groups[:, j] << np.uint64(-shift)
            out[:, byte] |= (x & np.uint64(0xFF)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    windows = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    at = np.arange(count, dtype=np.int64) * bits
    x = windows[at >> 3].astype(np.uint64) >> (64 - bits - (at & 7)).astype(np.uint64)
    return (x & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path)
    return fs, p


def write_shard(path: str, doc_ids: list, lengths: list, ids: np.ndarray, bits: int) -> None:
    blocks = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    n = len(doc_ids)
    body = _HEAD.size + 8 * len(blocks) + 16 * n
    offsets = body + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1]
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    fs, p = _open(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(_HEAD.pack(MAGIC, bits, BLOCK, len(ids), n))
        f.write(offsets.astype("<u8").tobytes())
        f.write(np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes())
        f.write(starts.astype("<u8").tobytes())
        for b in blocks:
            f.write(b)


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str):
        fs, p = _open(path)
        self.file = fs.open_input_file(p)
        magic, self.bits, self.block, self.n_ids, self.n_docs = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a packed token file")
        n_blocks = -(-self.n_ids // self.block)
        rest = self.file.read(8 * n_blocks + 16 * self.n_docs)
        self.offsets = np.frombuffer(rest, "<u8", n_blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(rest, "<i8", self.n_docs, 8 * n_blocks)
        self.starts = np.append(np.frombuffer(rest, "<u8", self.n_docs, 8 * (n_blocks + self.n_docs)),
                                self.n_ids).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the ``start``-th on: reads only their blocks."""
        if count <= 0:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (start + count - 1) // self.block
        size = -(-self.block // 8) * self.bits
        self.file.seek(int(self.offsets[a]))
        raw = self.file.read(int(self.offsets[b] - self.offsets[a]) + size)
        # Full blocks are whole groups of eight ids, so they follow each other
        # without a gap and the run unpacks at once.
        return unpack(raw, start - a * self.block + count, self.bits)[start - a * self.block:]

    def close(self) -> None:
        self.file.close()


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``codes`` of ``ids``, which holds runs of ``sizes``, flat."""
    starts = np.cumsum(sizes) - sizes
    taken = sizes[codes]
    shift = np.repeat(starts[codes] - (np.cumsum(taken) - taken), taken)
    return ids[shift + np.arange(len(shift))]


class _Encoder:
    """Ids of whole texts: each Arrow slice is reduced to its distinct words,
    those that are not known from slices before are encoded in runs, and the
    texts gather their words' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        self.batch = getattr(t, "encode_batch_fast", t.encode_batch)
        self.size = t.get_vocab_size()
        # Ids whose token begins with a space.
        self.spaced = np.zeros(self.size, bool)
        for token, i in t.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")
        # Known words, their ids, flat, and how many each has.
        self.known = pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64)

    def some(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all names, flat; how many each has)"""
        found = [np.array(e.ids, np.int32) for i in range(0, len(names), 1 << 14)
                 for e in self.batch(names[i:i + (1 << 14)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.empty(0, np.int32), *found]), sizes

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``some`` of ``" " + word`` for distinct words without white space.
        Known ones are looked up; when they are too many, those of this call
        take their place."""
        known, ids, sizes = self.known
        found = pc.index_in(words, value_set=known)
        new = words.filter(pc.is_null(found))
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[pc.is_null(found).to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
        more = self.runs(new)
        ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
        own = _gathered(ids, sizes, at)
        if known.nbytes + new.nbytes <= KNOWN:
            self.known = pa.concat_arrays([known, new]), ids, sizes
        elif words.nbytes <= KNOWN:
            self.known = words, own, sizes[at]
        return own, sizes[at]

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``words``, but all are encoded.  They are run together, as a call
        costs more than a word: every word's first id, and no other, is a spaced
        one."""
        n = len(words)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        cuts = pa.array(np.append(np.arange(0, n, _RUN), n), pa.int32())
        runs = pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").to_pylist()
        ids, _ = self.some([" " + r for r in runs])
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != n:
            return self.some([" " + w for w in words.to_pylist()])
        return ids, np.diff(np.append(at, len(ids)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, flat; offsets by text); NULL is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        flat, offsets = pieces(texts)
        heads = offsets[:-1]
        tail = flat.dictionary_encode()
        head = flat.take(pa.array(heads)).dictionary_encode()
        plain = pc.invert(pc.match_substring_regex(tail.dictionary, "^$|" + WHITE))
        odd = pc.invert(plain)
        ids, sizes = zip(self.words(tail.dictionary.filter(plain)),
                         self.some([" " + t for t in tail.dictionary.filter(odd).to_pylist()]),
                         self.some(head.dictionary.to_pylist()))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        # Distinct pieces in the order in which they were encoded.
        place = np.empty(len(tail.dictionary), np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        place[np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])] = np.arange(len(place))
        codes = place[tail.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        codes[heads] = head.indices.to_numpy(zero_copy_only=False) + len(place)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return _gathered(ids, sizes, codes), ends[offsets]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write every text's ids to shards in the shared folder; the manifest
    ``part, seq, path, n_docs, n_ids, base`` (``base``: ids in shards before)."""
    folder = shared_dir(docs.sparkSession, "token-files")

    def run(batches):
        from pyspark import TaskContext
        encoder = _encoder(tokenizer_path)
        bits = max(1, (encoder.size - 1).bit_length())
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, lengths, held = [], [], []

        def flush():
            path = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            ids = np.concatenate(held)
            write_shard(path, doc_ids, lengths, ids, bits)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for b in slices(batches, chars=SLICE):
            ids, offsets = encoder.texts(b.column("text"))
            counts = np.diff(offsets) + 1
            whole = np.full(int(counts.sum()), END, np.int32)
            ends = np.cumsum(counts)
            inside = np.ones(len(whole), bool)
            inside[ends - 1] = False
            whole[inside] = ids
            doc_ids += b.column("doc_id").to_pylist()
            lengths += counts.tolist()
            held.append(whole)
            if sum(map(len, held)) >= SHARD_IDS:
                yield flush()
                doc_ids, lengths, held, seq = [], [], [], seq + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    shards = stored(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
                    .mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"),
                    "op7-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                shard = Shard(path)
                crcs = []
                step = max(1, 1 << 10)
                for d in range(0, shard.n_docs, step):
                    s = shard.starts[d:d + step + 1]
                    ids = shard.ids(int(s[0]), int(s[-1] - s[0])).astype("<u4")
                    crcs += [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(s - s[0], s[1:] - s[0])]
                shard.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == _NO_ID),
                     pa.array(shard.starts[:-1] + base), pa.array(np.diff(shard.starts)),
                     pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A given number of partitions is not merged: tasks grow with the shards.
    n = manifest.count()
    return manifest.select("path", "base").repartition(max(1, min(n, 64 + n // 8)), "path").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
