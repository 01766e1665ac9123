"""Byte-level BPE encoding and decoding (operator 2).

Method: each match of the split pattern is encoded by itself.  A segment tree
over its byte positions holds, for every live part, the rank of the pair it
forms with the next part; the root is the leftmost pair of minimum rank.  A
merge changes three leaves (the part, its left neighbour, the part that goes),
each a logarithmic update, so a match of n bytes costs O(n log n) however long
it is.  As the tiktoken library does, a match that is itself in the ranks is
one token.  The matches of a batch are merged together: one numpy matrix holds
the trees of all short matches and each step makes the next merge of every
tree; longer matches have a tree of their own.

Defined cases: NULL text is the empty text; empty text has no tokens and
decodes to no bytes; NULL doc_id stays NULL; repeated rows give repeated rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import slices
from dashframe.llm.pretoken import Memo, encode_texts

_NEVER = 1 << 62
_WIDTHS = (8, 16, 32, 64)   # bytes of the matches whose trees share a matrix


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, (n - 2)).bit_length()
    after = list(range(1, n + 2))      # where the part that starts here ends
    before = list(range(-1, n))        # where the part to the left starts
    tree = [_NEVER] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, key: int) -> None:
        i += size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    def pair_key(i: int) -> int:
        mid = after[i]
        if mid >= n:
            return _NEVER
        r = get(piece[i:after[mid]])
        return _NEVER if r is None else r * n + i

    while tree[1] < _NEVER:
        i = tree[1] % n
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        if gone < size:
            put(gone, _NEVER)
        put(i, pair_key(i))
        left = before[i]
        if left >= 0:
            put(left, pair_key(left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class PairRanks:
    """Rank of two adjacent tokens (= id of their concatenation), vectorised."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ids = np.append(np.array(ids, np.int64)[order], -1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the pair is in no rank."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], -1)


def merge_together(pieces: list[bytes], width: int, byte_ids: np.ndarray,
                   pair: PairRanks) -> list[bytes]:
    """:func:`merge` of many matches of 2 to ``width`` bytes at once, each as
    the bytes of 32-bit ids: row r of ``tree`` is the segment tree of match r."""
    m = len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
    ids = byte_ids[raw].reshape(m, width)
    column = np.arange(width)
    after = np.tile(column + 1, (m, 1))
    before = np.tile(column - 1, (m, 1))
    alive = column < n[:, None]

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, rank * width + at, _NEVER)

    tree = np.full((m, 2 * width), _NEVER, np.int64)
    firsts = leaf(pair(ids[:, :-1], ids[:, 1:]), column[:-1])
    tree[:, width:2 * width - 1] = np.where(column[1:] < n[:, None], firsts, _NEVER)
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def put(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = keys
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < _NEVER)
    while rows.size:
        best = tree[rows, 1]
        i = best % width
        gone = after[rows, i]
        end = after[rows, gone]
        ids[rows, i] = best // width
        alive[rows, gone] = False
        after[rows, i] = end
        more = end < n[rows]
        before[rows[more], end[more]] = i[more]
        put(rows, gone, np.full(rows.size, _NEVER))
        own = np.full(rows.size, _NEVER)
        own[more] = leaf(pair(ids[rows[more], i[more]], ids[rows[more], end[more]]), i[more])
        put(rows, i, own)
        left = before[rows, i]
        has = left >= 0
        r, at = rows[has], left[has]
        put(r, at, leaf(pair(ids[r, at], ids[r, i[has]]), at))
        rows = rows[tree[rows, 1] < _NEVER]
    flat = ids[alive].astype(np.int32).tobytes()
    ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0] + ends, ends)]


class Codec:
    """Encoder and decoder over one rank file; lives once per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        self.ranks = read_ranks(ranks_path)
        self.find = regex.compile(pattern).findall
        self.pair = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.memo = Memo(200_000)

    def merge_all(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each of some distinct matches."""
        return {p: np.frombuffer(ids, np.int32).tolist() for p, ids in self.merged(pieces).items()}

    def merged(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """:meth:`merge_all` as the bytes of 32-bit ids, which are joined as they are."""
        out, rest = {}, {w: [] for w in _WIDTHS}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, sys.byteorder)
            elif len(p) > _WIDTHS[-1]:
                out[p] = np.array(merge(p, self.ranks), np.int32).tobytes()
            else:
                rest[next(w for w in _WIDTHS if len(p) <= w)].append(p)
        for width, group in rest.items():
            for k in range(0, len(group), 1 << 15):
                part = group[k:k + (1 << 15)]
                out.update(zip(part, merge_together(part, width, self.byte_ids, self.pair)))
        return out

    def encode_chunks(self, names: list[str]) -> list[bytes]:
        cut = [[p.encode() for p in self.find(c)] for c in names]
        ids = self.merged(list({p for pieces in cut for p in pieces}))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces]) for pieces in cut]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return encode_texts(texts, self.encode_chunks, self.memo)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, tokens array<int>`` of every row's whole text."""

    def run(batches):
        coder = codec(ranks_path, pattern)
        for b in slices(batches):
            ids, offsets = coder.encode_all(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                       pa.array(ids, pa.int32()))],
                names=["doc_id", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, tokens array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, tokens, decoded binary`` of rows that :func:`encode` gave."""

    def run(batches):
        coder = codec(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                tokens = b.column(1)
                flat = tokens.flatten().to_numpy(zero_copy_only=False)
                ends = (tokens.offsets.to_numpy() - tokens.offsets[0].as_py()).tolist()
                decoded = [coder.decode(flat[i:j].tolist()) for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), tokens, pa.array(decoded, pa.binary())],
                                                 names=["doc_id", "tokens", "decoded"])

    return df.select("doc_id", "tokens").mapInArrow(
        run, "doc_id long, tokens array<int>, decoded binary")


def digests():
    """SHA-256 of the decimal ids joined by commas, and of the decoded bytes."""
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return [F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids, and give the digests of both."""
    both = decode(encode(df, ranks_path, pattern), ranks_path, pattern)
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), *digests())
