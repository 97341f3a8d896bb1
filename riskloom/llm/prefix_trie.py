"""The trie of conversation prefixes, from sorted matrices of turn ids.

A turn is known by a 128-bit digest of its role and text, a conversation by its digests in
order. Conversations are dealt to shards by ranges of that order, ties by conv_id, so a
node's members lie side by side: in one shard, or at the end of one and the start of the
next. Inside a shard digests become numbers that keep their order, and conversations rows of
a matrix padded with 0, WIDTH turns at a time:

1. ``numpy.lexsort`` over the columns orders the rows.
2. A row starts a new node at every depth from the first column on in which it differs from
   the row above: the change masks of the columns, OR-accumulated from left to right.
3. Depth by depth from the deepest, ``reduceat`` over the starts gives every node's members,
   children, leaves and saved tokens.

Nodes on the path of a shard's first or last row may go on in another shard. Their sums are
kept apart, keyed by a digest of the prefix, and added over the shards; each such boundary
node then takes in the boundary nodes below it.

Defined cases: a null role or text is empty, null turns come first, turns of equal number
stand in the order of their digests, repeated rows are repeated turns; rows with a null
conv_id belong to no conversation; an empty table has no nodes, not even a root; a text of
any length counts as one digest and its number of code points; other columns are not read.

Scale: the texts are read once and leave their task as 24 bytes a turn. A conversation's
turns, as those bytes, have to fit a task, as does a shard, of which there are more with
more turns. Thousands of equal conversations spread over shards; only the digest of a list
of ids cannot be split, it is streamed over packed ids in order, holding one piece of the
list. Boundary nodes, at most two paths a shard, are joined up in one task: they grow with
the shards, not with the conversations in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import partitions, written

WIDTH = 64  # columns of a matrix at a time
SHARD = 250_000  # turns
PIECE = 4096  # ids of a list that travel in one row
NOTHING = hashlib.sha256(b"").hexdigest()
_SCHEMA = ("shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
           "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long, piece int, ends binary")
_ARROW = pa.schema([
    ("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("chars", pa.int64()), ("piece", pa.int32()), ("ends", pa.binary())])
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(conversations: DataFrame, family: Column) -> DataFrame:
    """family, conv_id and the array ``turns`` (turn, key, chars) of every conversation.

    Rows are shuffled once, by ``family`` (a function of conv_id): what later joins the
    conversations of a family finds them together."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id is not null").select(
        family.alias("family"), "conv_id", F.struct("turn", F.unhex(key).alias("key"), F.length(text).alias("chars")).alias("t"))
    turns = turns.repartition(partitions(conversations.sparkSession), "family")
    return turns.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 on of 16-byte keys (rows of two big-endian words), in their order."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1)][: len(keys)]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _matrix(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """Columns ``first`` and on, WIDTH at most, of rows of ids, padded with 0."""
    width = int(min(WIDTH, lengths.max() - first))
    column = np.arange(first, first + width)
    inside = column < lengths[:, None]
    return np.where(inside, ids[np.where(inside, begins[:, None] + column, 0)], 0)


def row_order(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows of ids, ties by ``last``."""
    rank = np.zeros(len(lengths), np.int64)
    for first in range(0, int(lengths.max()), WIDTH):
        rows = np.flatnonzero(lengths > first)
        matrix = _matrix(ids, begins[rows], lengths[rows], first)
        order = np.lexsort([*matrix.T[::-1], rank[rows]])
        m, r = matrix[order], rank[rows[order]]
        below = np.zeros(len(lengths), np.int64)  # rows that have ended come before those that go on
        below[rows[order]] = np.cumsum(np.r_[True, (m[1:] != m[:-1]).any(axis=1) | (r[1:] != r[:-1])])
        order = np.lexsort((below, rank))
        b, r = below[order], rank[order]
        rank[order] = np.cumsum(np.r_[False, (b[1:] != b[:-1]) | (r[1:] != r[:-1])])
    return np.lexsort((last, rank))


def node_starts(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of ordered rows, for every WIDTH columns: the first column, the rows that reach it, and
    the mask of the columns whose node starts at the row."""
    out, changed = [], np.zeros(len(lengths), bool)
    for first in range(0, int(lengths.max()), WIDTH):
        rows = np.flatnonzero(lengths > first)
        matrix = _matrix(ids, begins[rows], lengths[rows], first)
        change = np.ones(matrix.shape, bool)
        change[1:] = (matrix[1:] != matrix[:-1]) | (rows[1:] != rows[:-1] + 1)[:, None]
        mask = np.logical_or.accumulate(change, axis=1) | changed[rows, None]
        changed[rows] = mask[:, -1]
        out.append((first, rows, mask))
    return out


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _prefixes(keys: np.ndarray) -> list[bytes]:
    """A digest of every prefix of a row of 16-byte keys, the empty one first."""
    running = hashlib.blake2b(digest_size=16)
    out = [running.digest()]
    for key in keys:
        running.update(key.tobytes())
        out.append(running.digest())
    return out


def shard_nodes(shard: int, conv: np.ndarray, keys: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's conversations. ``keys`` (rows of two big-endian words) and
    ``chars`` of all turns lie one conversation behind the other."""
    begins = np.cumsum(lengths) - lengths
    ids = _numbers(keys) if len(keys) else np.zeros(1, np.int64)
    order = row_order(ids, begins, lengths, conv)
    conv, begins, lengths = conv[order], begins[order], lengths[order]
    n = len(conv)
    first_path, last_path = (_prefixes(keys[begins[i]: begins[i] + lengths[i]]) for i in (0, n - 1))
    columns = [(first + k + 1, rows, mask[:, k]) for first, rows, mask in node_starts(ids, begins, lengths) for k in range(mask.shape[1])]
    columns.insert(0, (0, np.arange(n), np.r_[True, np.zeros(n - 1, bool)]))
    child, leaf, saved = np.zeros((3, n), np.int64)  # at the row where a node starts that ends in this shard
    below = None  # the nodes one deeper, which wait for their parents
    for depth, rows, mask in reversed(columns):
        reach = lengths[rows] >= depth
        r, m = rows[reach], mask[reach]
        start = np.flatnonzero(m)
        count = np.diff(np.r_[start, len(r)])
        at = r[start]
        members = np.minimum.reduceat(conv[r], start)
        n_children = np.add.reduceat(child[r], start)
        ended = np.add.reduceat((lengths[r] == depth).astype(np.int64), start)
        boundary = (at == 0) | (r[start + count - 1] == n - 1)
        whole = at[~boundary]
        text = chars[begins[at] + depth - 1] if depth else np.zeros(1, np.int64)
        leaf[whole] += n_children[~boundary] == 0
        saved[whole] += ((count - 1) * text)[~boundary]
        path = lambda d: [None if not b else (first_path if a == 0 else last_path)[d] for a, b in zip(at.tolist(), boundary.tolist())]
        key = path(depth)
        digests = [(NOTHING if not e else _digest(conv[a: a + e])) if not b else None
                   for a, e, b in zip(at.tolist(), ended.tolist(), boundary.tolist())]
        if below is not None:  # this depth's nodes are the parents of those found before
            node_of = np.repeat(np.arange(len(start)), count)
            place = np.zeros(n, np.int64)
            place[r] = node_of
            up = place[below["at"]]
            yield _batch(shard, below, parent_key=[key[i] for i in up], parent=[None if boundary[i] else int(members[i]) for i in up])
        below = {"at": at, "key": key, "conv_id": members, "depth": np.full(len(at), depth), "n_convs": count, "n_children": n_children,
                 "n_leaves": np.add.reduceat(leaf[r], start), "saved_tokens": np.add.reduceat(saved[r], start), "ends_sha256": digests, "chars": text}
        for a, e, k, b in zip(at.tolist(), ended.tolist(), key, boundary.tolist()):
            if b and e:
                yield _ends(shard, k, conv[a: a + e])
        child[:] = 0
        child[whole] = 1
    yield _batch(shard, below, parent_key=[None], parent=[None])


def _table(columns: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _batch(shard: int, nodes: dict, parent_key: list, parent: list) -> pa.RecordBatch:
    n = len(nodes["at"])
    return _table({**nodes, "shard": [shard] * n, "parent_key": parent_key, "parent_conv_id": parent}, n)


def _ends(shard: int, key: bytes, ids: np.ndarray) -> pa.RecordBatch:
    pieces = [ids[i: i + PIECE].tobytes() for i in range(0, len(ids), PIECE)]
    n = len(pieces)
    return _table({"shard": [shard] * n, "key": [key] * n, "piece": list(range(n)), "ends": pieces}, n)


def _shards(sequences: DataFrame, n_shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        conv, paths, chars = (pa.chunked_array([b[c] for b in held]) for c in ("conv_id", "path", "chars"))
        keys = np.frombuffer(b"".join(p.as_py() for p in paths), ">u8").reshape(-1, 2).astype(np.uint64)
        lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chars.chunks])
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chars.chunks]).astype(np.int64)
        yield from shard_nodes(TaskContext.get().partitionId(), conv.to_numpy(), keys, flat, lengths.astype(np.int64))

    return sequences.repartitionByRange(n_shards, "path", "conv_id").mapInArrow(run, _SCHEMA)


def _joined_up(t: pa.Table) -> pa.Table:
    """Boundary nodes with the sums of the boundary nodes below them."""
    key, depth = t["key"].to_pylist(), t["depth"].to_numpy()
    place = {k: i for i, k in enumerate(key)}
    parent = np.array([-1 if p is None else place[p] for p in t["parent_key"].to_pylist()], np.int64)
    take = lambda c: t[c].to_numpy().astype(np.int64).copy()
    conv, n, children = (take(c) for c in ("conv_id", "n_convs", "n_children"))
    np.add.at(children, parent[parent >= 0], 1)
    # The shards' sums hold all nodes below but the boundary nodes, which are added here.
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * take("chars")
    order = np.argsort(-depth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        rows = rows[parent[rows] >= 0]
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    above = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
    return pa.table({"key": t["key"], "conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": n,
                     "n_children": children, "n_leaves": leaves + take("n_leaves"), "saved_tokens": saved + take("saved_tokens")})


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every key's ids, whose pieces come in order."""
    now, running = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])
    for batch in batches:
        for key, ends in zip(batch["key"].to_pylist(), batch["ends"]):
            more = key == now
            if not more:
                if now is not None:
                    yield out()
                now, running = key, hashlib.sha256()
            running.update((("," if more else "") + ",".join(map(str, np.frombuffer(ends.as_buffer(), np.int64).tolist()))).encode())
    if now is not None:
        yield out()


def trie(sequences: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """A row per node. ``sequences``: one row per conversation, conv_id and the array ``turns``
    of structs with key (16 bytes) and chars, as ``turn_lists`` gives them."""
    spark = sequences.sparkSession
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    flat = written(sequences.select("conv_id", F.unhex(hexes).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "turns")
    total = flat.agg(F.sum(F.greatest(F.size("chars"), F.lit(1)))).first()[0] or 0
    parts = written(_shards(flat, int(max(partitions(spark), total // shard))), "nodes")
    partial = parts.filter("key is not null and n_convs is not null")
    summed = partial.groupBy("key", "depth").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    tree = written(summed.withColumn("tree", F.lit(0)).groupBy("tree").applyInArrow(
        _joined_up, "key binary, " + ", ".join(f"{c} long" for c in NODE[:-1])), "boundary")
    ends = parts.filter("ends is not null").select("key", "shard", "piece", "ends") \
        .repartition(partitions(spark), "key").sortWithinPartitions("key", "shard", "piece").mapInArrow(_streamed, "key binary, ends_sha256 string")
    shared = tree.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # A node whose parent is a boundary node finds it by its own shard, so no parent is a hot key.
    homes = partial.select("shard", F.col("key").alias("parent_key")).join(
        tree.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")), "parent_key")
    own = parts.filter("key is null").join(homes, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return own.select(*NODE).unionByName(shared.select(*NODE))
