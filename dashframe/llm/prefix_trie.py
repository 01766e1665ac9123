"""Prefix trie of conversations by van Emde Boas recursion (operator 13).

A sequence of turns is cut at half depth, the cut prefix gets a name, and the
trie of the upper halves and the forest of the lower ones (a tree a cut name)
are built alike; then the totals of the lower trees are grafted upward.  With
depths cut at powers of two, the block of turns ``(d - 2^l, d]``, where 2^l is
the lowest bit of d, is what stands above the cut at d in its recursion:

* **blocks**: the digest of a block of 2^(l+1) turns comes from its two halves,
  one level a round, every block of a level at once;
* **names**: from the deepest recursion's outermost cut inward, the prefix of
  depth d is named by the name of the cut at ``d - 2^l`` and the digest of the
  block between, all cuts of a level at once.  Equal prefixes get equal names
  in all conversations, whatever their lengths;
* **totals**: from the innermost blocks outward, a node whose depth has lowest
  bit 2^l is the root of a lower tree; its subtree's totals, complete by then,
  go to its 2^l ancestors in the upper block, all lower trees of a level at once.

So a trie of depth M takes log2(M) rounds each way, and a conversation is never
gathered: turns, blocks and prefixes are rows keyed by (conversation, place),
and a conversation of any length spreads over all tasks.  Rows for equal names
are summed before they are shuffled; children find their parent's id by
``join_by_key``, which spreads the children of a parent with many.  Every round
is written to the shared folder.

The ids that end at a node are hashed in one pass over them in sorted order:
tasks of a range partitioning make pieces of joined ids, and the pieces of a
node run through one SHA-256, piece after piece (the hash can't be split; its
memory is one piece).

Defined cases: turns without conv_id belong to no conversation and are left
out; NULL role or text is the empty string; turns of equal number (repeated
rows too) follow each other by the digest of role and text, so their order does
not depend on the input's; c - c % 5 is the multiple of five at or below c, for
negative ids too; an empty table gives an empty result (no root, as no
conversation starts there); extra columns are not read.  Turns and prefixes are
told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dashframe.llm.common import join_by_key, ship_package, stored
from dashframe.operators.order import with_position

GROUP = 5
HEADS = 9             # remainders of the id's crc32: the borrowed turns
PIECE = 1 << 16       # characters of joined ids handed on at once
ROOT = b"\0" * 16
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(data: Column) -> Column:
    return F.unhex(F.md5(data))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 0), key, bytes, and the conversation's n turns,
    base, h; one sort deals the places."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                    _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
                            .cast("binary")).alias("key"),
                    F.octet_length(text).cast("long").alias("bytes")))
    placed = stored(with_position(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("key")],
                                  "place").drop("turn"), "turn-places")
    return placed


def rebuild(conversations: DataFrame, group: int = GROUP, heads: int = HEADS):
    """(turns, conversations) after rebuilding: ``conv_id, j, key, bytes`` of
    every turn and ``conv_id, length`` of every conversation."""
    placed = _turns(conversations)
    own = stored(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                 .withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group)))
                 .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads),
                 "conversations")
    convs = stored(own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")),
                            "base", "left")
                   .select("conv_id", "first", "base", "h",
                           F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), "n")
                   .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
                   "conversations")
    turns = stored(placed.join(convs.select("conv_id", "first", "h", "taken"), "conv_id")
                   .select("conv_id", (F.col("place") - F.col("first")).alias("i"), "key", "bytes",
                           "h", "taken"), "turns")
    kept = (turns.where(F.col("i") >= F.col("h"))
            .select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("j"), "key", "bytes"))
    heads_of = turns.where(F.col("i") < heads - 1).select(
        F.col("conv_id").alias("base"), F.col("i").alias("j"), "key", "bytes")
    borrowed = (convs.select("conv_id", "base", "taken").join(heads_of, "base")
                .where(F.col("j") < F.col("taken")).select("conv_id", "j", "key", "bytes"))
    return stored(kept.unionAll(borrowed), "rebuilt-turns"), convs.select("conv_id", "length")


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level l the blocks of 2^l turns: conv_id, k, digest, and the last
    turn's bytes."""
    level = turns.select("conv_id", F.col("j").alias("k"), F.col("key").alias("digest"), "bytes")
    out = [level]
    odd = F.col("k") % 2 == 1
    for _ in range(levels):
        level = stored(level.groupBy("conv_id", F.shiftright("k", 1).alias("k"))
                       .agg(F.max(F.when(~odd, F.col("digest"))).alias("a"),
                            F.max(F.when(odd, F.col("digest"))).alias("b"),
                            F.max(F.when(odd, F.col("bytes"))).alias("bytes"))
                       .where(F.col("a").isNotNull() & F.col("b").isNotNull())
                       .select("conv_id", "k", _digest(F.concat("a", "b")).alias("digest"), "bytes"),
                       "turn-blocks")
        out.append(level)
    return out


def prefixes(turns: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """``conv_id, depth, name, bytes`` of every prefix, the root included."""
    names = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"),
                         F.lit(0).cast("long").alias("bytes"))
    blocks = _blocks(turns, levels)
    for l in range(levels, -1, -1):
        cut = blocks[l].where(F.col("k") % 2 == 0)
        depth = F.shiftleft(F.col("k") + 1, l).alias("depth")
        outer = cut.where("k = 0").select("conv_id", depth, F.lit(ROOT).alias("above"), "digest", "bytes")
        above = names.where(F.col("depth") > 0).select(
            "conv_id", F.shiftright("depth", l).alias("k"), F.col("name").alias("above"),
            F.col("depth").alias("at")).where(F.shiftleft("k", l) == F.col("at")).drop("at")
        inner = (cut.where("k > 0").join(above, ["conv_id", "k"])
                 .select("conv_id", depth, "above", "digest", "bytes"))
        level = stored(outer.unionAll(inner).select(
            "conv_id", "depth", _digest(F.concat("above", "digest")).alias("name"), "bytes"), "prefixes")
        names = names.unionAll(level)
    return names


def _graft(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """``name, leaves, saved``: what each node's subtree adds to its own."""
    grafts = nodes.select("name", "depth", F.col("leaf").alias("leaves"), "saved").limit(0)
    for l in range(levels + 1):
        lowest = F.col("depth").bitwiseAND(F.lit((2 << l) - 1)) == (1 << l)
        below = grafts.where(lowest).groupBy("name").agg(
            F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        roots = (nodes.where(lowest).join(below, "name", "left")
                 .select("conv_id", (F.shiftright("depth", l) - 1).alias("upper"),
                         (F.col("leaf") + F.coalesce("more", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        upper = paths.select("conv_id", F.shiftright("depth", l).alias("upper"), "name", "depth")
        grafts = grafts.unionAll(stored(
            roots.join(upper, ["conv_id", "upper"]).groupBy("name", "depth")
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "grafts"))
    return grafts.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))


def _pieces(batches):
    """Joined ids of a run of equal names, at most about ``PIECE`` characters."""
    name, first, ids, size = None, None, [], 0
    schema = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.binary()), pa.array([first], pa.int64()),
             pa.array([",".join(ids)], pa.string())], schema=schema)

    held, count = [], 0
    for b in batches:
        for n, c in zip(b.column("name").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (n != name or size >= PIECE):
                held.append(out())
                count += size
                ids, size = [], 0
                if count >= PIECE or len(held) >= 4096:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, count = [], 0
            if not ids:
                name, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        held.append(out())
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hashes(batches):
    """One SHA-256 over the pieces of a name, which arrive in order."""
    schema = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
    name, state = None, None
    for b in batches:
        names, done = [], []
        for n, piece in zip(b.column("name").to_pylist(), b.column("piece").to_pylist()):
            if n == name:
                state.update(b"," + piece.encode())
                continue
            if name is not None:
                names.append(name)
                done.append(state.hexdigest())
            name, state = n, hashlib.sha256(piece.encode())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(done)], schema=schema)
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])],
                                         schema=schema)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of every name of ``ends`` (``name``, ``conv_id``)."""
    pieces = (ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
              .mapInArrow(_pieces, "name binary, first long, piece string"))
    return (pieces.repartition("name").sortWithinPartitions("name", "first")
            .mapInArrow(_hashes, "name binary, ends_sha256 string"))


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations: ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    ship_package(conversations.sparkSession)
    turns, convs = rebuild(conversations, group, heads)
    longest = convs.agg(F.max("length")).first()[0] or 0
    levels = max(0, int(longest).bit_length() - 1)
    paths = prefixes(turns, convs, levels)
    grouped = stored(paths.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    over = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    linked = stored(grouped.join(over, ["conv_id", "depth"], "left"), "trie-nodes")
    children = linked.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(linked.join(children.withColumnRenamed("parent", "name"), "name", "left")
                   .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                   .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    ends = end_hashes(stored(paths.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
                             .select("name", "conv_id"), "trie-ends"))
    totals = stored(nodes.join(_graft(nodes, paths, levels), "name", "left").join(ends, "name", "left"),
                    "trie-totals")
    parents = stored(nodes.where("n_children > 0").select(
        F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("n")).unionAll(
        nodes.where("depth = 0").select(F.col("parent"), F.lit(None).cast("long"), F.lit(1).cast("long"))),
        "trie-parents")
    return join_by_key(totals, parents, "parent", "n").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),"
        " lambda s: CAST(ascii(s) AS BIGINT))), lambda r, b: list_reduce(list_prepend(xor(r, b),"
        " CAST(range(8) AS BIGINT[])), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT)"
        " ELSE y >> 1 END))")

SQL = f"""
WITH placed AS MATERIALIZED (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY 1),
convs AS MATERIALIZED (
    SELECT conv_id, n, conv_id - ((conv_id % {GROUP}) + {GROUP}) % {GROUP} AS base,
           xor({_CRC}, 4294967295::BIGINT) % {HEADS} AS h FROM own),
rebuilt AS (
    SELECT c.conv_id, c.n, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS taken
    FROM convs c LEFT JOIN own b ON c.base = b.conv_id),
seq AS MATERIALIZED (
    SELECT r.conv_id, p.i AS j, p.role, p.text FROM rebuilt r JOIN placed p ON p.conv_id = r.base AND p.i < r.taken
    UNION ALL
    SELECT r.conv_id, r.taken + p.i - r.h, p.role, p.text
    FROM rebuilt r JOIN placed p ON p.conv_id = r.conv_id AND p.i >= r.h),
path AS MATERIALIZED (
    SELECT conv_id, j + 1 AS depth, octet_length(encode(text)) AS bytes,
           string_agg(sha256(length(role) || ':' || role || text), ',') OVER (
               PARTITION BY conv_id ORDER BY j) AS name FROM seq
    UNION ALL SELECT conv_id, 0, 0, '' FROM own),
node AS MATERIALIZED (
    SELECT name, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes,
           count(*) AS n_convs FROM path GROUP BY name),
linked AS MATERIALIZED (
    SELECT n.*, p.name AS parent FROM node n LEFT JOIN path p
    ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY 1),
total AS (
    SELECT a.name, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
           sum((n.n_convs - 1) * n.bytes) AS saved_tokens
    FROM node n LEFT JOIN kids k ON k.parent = n.name
    JOIN path a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1),
ends AS (
    SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, name, depth, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM path)
    WHERE depth = deepest GROUP BY 1)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, l.n_convs,
       coalesce(k.n_children, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM linked l LEFT JOIN node u ON u.name = l.parent LEFT JOIN kids k ON k.parent = l.name
JOIN total t ON t.name = l.name LEFT JOIN ends e ON e.name = l.name"""
