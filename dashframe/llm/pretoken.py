"""Cutting texts into chunks that byte-level BPE encodes independently.

The split pattern of byte-level tokenizers never matches across a single space
that stands between two non-space characters: the space opens the next match.
So a text may be cut before each such space, every chunk encoded by itself and
the results joined.  Chunks repeat as words do: each Arrow batch is reduced to
its distinct chunks, and a bounded memo holds answers across batches.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Every character that a Unicode-aware \s may match, in RE2's syntax.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
MEMO_KEY_CHARS = 64


class Memo(dict):
    """chunk -> answer (about 200 bytes each), emptied when full so that its
    memory is bounded."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries = entries

    def keep(self, key: str, value) -> None:
        if len(key) <= MEMO_KEY_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces between lone spaces, flat, and each text's offsets into them."""
    odd = pc.match_substring_regex(texts, WHITE + "{2}").to_numpy(zero_copy_only=False)
    if not odd.any():
        cut = pc.split_pattern(texts, pattern=" ")
        return cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    lists = [_LONE_SPACE.split(t) if o else t.split(" ")
             for t, o in zip(texts.to_pylist(), odd.tolist())]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.array(chain.from_iterable(lists), pa.string()), offsets


def distinct_chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, each chunk's index among them, offsets by text).
    NULL counts as the empty text; a text has at least one chunk."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    flat, offsets = pieces(texts)
    if len(texts) == 0:
        return [], np.empty(0, np.int64), offsets
    heads = offsets[:-1]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tails = coded.dictionary.to_pylist()
    first = flat.take(pa.array(heads)).dictionary_encode()
    codes[heads] = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(tails)
    return [" " + t for t in tails] + first.dictionary.to_pylist(), codes, offsets


def encode_texts(texts: pa.Array, encode_chunks, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, flat int32; offsets by text).  ``encode_chunks`` gives
    a sequence of ids, or the bytes of 32-bit ids, for each of a list of chunks;
    answers are kept as such bytes."""
    names, codes, offsets = distinct_chunks(texts)
    used = np.zeros(len(names), bool)
    used[codes] = True
    answers = [memo.get(n) if u else b"" for n, u in zip(names, used.tolist())]
    missing = [i for i, a in enumerate(answers) if a is None]
    for i, ids in zip(missing, encode_chunks([names[i] for i in missing])):
        answers[i] = ids if isinstance(ids, bytes) else np.array(ids, np.int32).tobytes()
        memo.keep(names[i], answers[i])
    sizes = np.fromiter(map(len, answers), np.int64, len(answers)) // 4
    flat = np.frombuffer(b"".join(answers), np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(taken)])
    shift = np.repeat(starts[codes] - ends[:-1], taken)
    return flat[shift + np.arange(len(shift))], ends[offsets]
