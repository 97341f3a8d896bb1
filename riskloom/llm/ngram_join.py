"""N-gram Jaccard join: documents whose sets of five-word shingles are 80 percent alike.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; its set holds its
distinct shingles of five words, or its whole word sequence if that is shorter. Sets are
held as sorted 64-bit hashes; equal sets are one node, known by a 64-bit hash of the set.

Candidates come from index lists. Shingles are ordered from rare to common, by a count
sketch of fixed size (one pass over all documents) and then by hash. Two sets that are alike
share a fifth of the shorter set at least among the first two fifths of each, so a set that
shares less of its own with all others is out, whatever passages it shares behind them. They
also share one of their first n - ceil(0.8 n) + 1 shingles, so of the others only these are
listed. Every list
sends its members to the group of its first member, and sets travel once for each group they
are in, not once for each pair.

In a group the answers follow from set relations. Members stand in order of size, and an
index list holds positions in that order, so one search skips the block of members that are
too short and another the block of those too long for a set. The first set's overlaps are
counted from its lists; those of a set that is alike are derived from the computed ones, by
taking away the lists of the shingles it lacks and adding those it has more. ``link_counts`` does so
for every set and gives the number of links of each document. ``classes`` needs components
only: once all members without own answers are in one component, no answer of theirs can add
a link between components, and the group is done.

Defined cases: null, empty and word-less texts have empty sets and are linked with nothing;
rows that share a doc_id are answered each by its own text; a null doc_id is counted but never linked (null
component); an empty table gives an empty result; other columns are not read.

Scale: nothing is collected but the sketch (65,536 counts) and a filter of 1 MB, both of
fixed size. Shingles in sketch cells above ``hot`` and twice the mean are not listed in one place: their least
member is found by a partial aggregate and joined back by Spark, which splits skewed keys.
Groups above ``members`` sets or ``shingles`` hashes are cut into blocks that share a few
bridging sets; what then lies outside a group's largest component is compared, in blocks,
with all of the group, so the result is exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Buckets, components, id_filter, may_hold, mix, partitions, powers, small_side, unpacked, written

SIZE = 5
CELLS = 1 << 16
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER + np.uint64(1)) * np.uint64(BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLACE = mix(np.arange(1, SIZE + 1, dtype=np.uint64)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
    return _POWERS["up"], _POWERS["down"]


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all texts at once in array operations."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data]].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        starts = np.cumsum(lengths) - lengths
        at = np.searchsorted(begin, np.r_[starts, len(data)])
        grams = np.zeros(max(len(words) - SIZE + 1, 0), np.uint64)
        for i in range(SIZE):
            grams += words[i : i + len(grams)] * _PLACE[i]
        grams = mix(grams)
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= SIZE:
                out.append(np.unique(grams[a : b - SIZE + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sets of the texts, in order, computed for about CHUNK bytes at a time."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield from _sets(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield from _sets(held)


def set_key(s: np.ndarray) -> int:
    """A hash of a set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ np.uint64(BASE)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch["text"].cast(pa.binary()).to_pylist()]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, n, node of every row, and in further rows cell and count of the sketch."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, node = [], []
            for s in shingle_sets(_texts(batch)):
                n.append(len(s))
                node.append(set_key(s))
                cells += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=CELLS) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(cells, (s >> np.uint64(48)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), none.cast(pa.int32()), none], names)
        at = np.flatnonzero(cells)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none.cast(id_type[0]) if id_type else none, none, none, pa.array(at, pa.int32()), pa.array(cells[at])], names)

    names = ["doc_id", "n", "node", "cell", "count"]
    id_type = [pa.int32()] if kind == "int" else []
    return written(documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, node long, cell int, count long"), "sets")


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(48)).astype(np.int64)


def _rarest(s: np.ndarray, sketch: np.ndarray, size: int) -> np.ndarray:
    return s[np.lexsort((s, sketch[_cells(s)]))[:size]]


def _probed(n: int) -> int:
    """Rarest shingles that are listed: sets that are alike share one of them."""
    return n - (4 * n + 4) // 5 + 1


def _weighed(n: int) -> int:
    """Rarest shingles that are looked at before, two fifths. A set of m shingles shares all
    of them but m - ceil(0.8 m) with one that is alike, up to the end of the shorter two
    fifths: m / 5 at least, and m is four fifths of n at least."""
    return (2 * n + 4) // 5


def _needed(n):
    return F.floor((F.floor((4 * n + 4) / 5) + 4) / 5)


def _promising(documents: DataFrame, size: DataFrame, sketch: np.ndarray, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """node: the sets that share enough of their rarest two fifths with any others.

    Hot shingles count as shared without being looked at."""

    def entries(batches):
        out, seen = Buckets(n_buckets, ["shingle", "node"], runs="node"), set()
        for batch in batches:
            for s in shingle_sets(_texts(batch)):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                p = _rarest(s, sketch, _weighed(len(s)))
                own = ~hot[_cells(p)]
                # A hot shingle stands as two entries of a bucket of its own.
                bucket = np.where(own, (p >> np.uint64(32)) % np.uint64(n_buckets), np.uint64(key % n_buckets))
                out.add(bucket.astype(np.int32), np.where(own, p.astype(np.uint32), np.uint32(0)), np.full(len(p), key, np.int64))
                yield from out.flush(out.limit)
            if len(seen) > 2_000_000:  # only saves repeated entries
                seen.clear()
        yield from out.flush()

    def count(t: pa.Table) -> pa.Table:
        shingle = unpacked(t["shingle"], np.uint32)
        node = np.repeat(unpacked(t["node"], np.int64), unpacked(t["node_runs"], np.uint32))
        order = np.lexsort((node, shingle))
        shingle, node = shingle[order], node[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]) | (shingle[1:] == 0)]
        shingle, node = shingle[new], node[new]
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        times = np.repeat(np.diff(np.r_[first, len(shingle)]), np.diff(np.r_[first, len(shingle)]))
        found, counts = np.unique(node[(times > 1) | (shingle == 0)], return_counts=True)
        out = Buckets(n_buckets, ["node", "shared"])
        out.add((mix(found.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), found, counts.astype(np.int64))
        return pa.Table.from_batches(list(out.flush()), pa.schema([("bucket", pa.int32()), ("node", pa.binary()), ("shared", pa.binary())]))

    def total(t: pa.Table) -> pa.Table:
        found, at = np.unique(unpacked(t["node"], np.int64), return_inverse=True)
        return pa.table({"node": found, "shared": np.bincount(at, unpacked(t["shared"], np.int64), len(found)).astype(np.int64)})

    counted = documents.select("text").mapInArrow(entries, "bucket int, shingle binary, node binary, node_runs binary").groupBy(
        "bucket").applyInArrow(count, "bucket int, node binary, shared binary")
    shared = counted.groupBy("bucket").applyInArrow(total, "node long, shared long")
    return shared.join(size, "node").filter(F.col("shared") >= _needed(F.col("n"))).select("node")


def _listed(documents: DataFrame, wanted: np.ndarray, sketch: np.ndarray, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """node, group: the groups that each promising set is sent to, if it shares a list at all."""

    def probes(batches, of_hot: bool):
        seen = set()
        for batch in batches:
            for s in shingle_sets(_texts(batch)):
                if not len(s) or (key := set_key(s)) in seen or not may_hold(wanted, np.array([key]))[0]:
                    continue
                seen.add(key)
                p = _rarest(s, sketch, _probed(len(s)))
                p = p[hot[_cells(p)] == of_hot]
                yield p, np.full(len(p), key, np.int64)
            if len(seen) > 2_000_000:
                seen.clear()

    def entries(batches):
        out = Buckets(n_buckets, ["shingle", "node"])
        for p, key in probes(batches, False):
            out.add(((p >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32), p, key)
            yield from out.flush(out.limit)
        yield from out.flush()

    def lists(t: pa.Table) -> pa.Table:
        shingle, node = unpacked(t["shingle"], np.uint64), unpacked(t["node"], np.int64)
        order = np.lexsort((node, shingle))
        shingle, node = shingle[order], node[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])]
        shingle, node = shingle[new], node[new]
        first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        size = np.diff(np.r_[first, len(shingle)])
        group = np.repeat(node[first], size)
        pairs = np.unique(np.stack([node, group], 1)[np.repeat(size, size) > 1], axis=0)
        return pa.table({"node": pairs[:, 0], "group": pairs[:, 1]})

    found = documents.select("text").mapInArrow(entries, "bucket int, shingle binary, node binary").groupBy("bucket").applyInArrow(
        lists, "node long, group long")
    if hot.any():

        def hot_entries(batches):
            for p, key in probes(batches, True):
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(key)], ["shingle", "node"])

        rows = documents.select("text").mapInArrow(hot_entries, "shingle long, node long").distinct()
        # Written, so that the join has two plain shuffles, whose skewed keys Spark splits.
        least = written(rows.groupBy("shingle").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "hot")
        found = found.unionByName(rows.join(least, "shingle").select("node", "group"))
    return found.distinct()


def _overlaps(lists_of, ids: np.ndarray, m: int) -> np.ndarray:
    found = lists_of(ids)
    return np.bincount(found, minlength=m) if len(found) else np.zeros(m, np.int64)


class Group:
    """Sets of one block in order of size, with an index list of positions per shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        every, local = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum(self.n)[:-1]
        self.sets = np.split(local, cuts)
        member = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(local, kind="stable")
        self.positions = member[order]
        self.first = np.searchsorted(local[order], np.arange(len(every) + 1))

    def found(self, ids: np.ndarray) -> np.ndarray:
        """Positions in the index lists of these shingles, one list behind the other."""
        a, size = self.first[ids], self.first[ids + 1] - self.first[ids]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        return self.positions[at]

    def alike(self, x: int, overlap: np.ndarray) -> np.ndarray:
        """Positions of the sets that are alike; those too short or long are skipped in blocks."""
        n = self.n[x]
        lo = np.searchsorted(self.n, -(-4 * n // 5))
        hi = np.searchsorted(self.n, 5 * n // 4, "right")
        o = overlap[lo:hi]
        return lo + np.flatnonzero(100 * o >= 80 * (n + self.n[lo:hi] - o))

    def answers(self, wanted=None):
        """(x, positions alike, first positions of the components that these join to that of
        x) in a useful order, until nothing can be added. With ``wanted``, of just these
        sets, all of them."""
        m = len(self.n)
        root, computed, rows = np.arange(m), np.zeros(m, bool), {}
        x = 0
        while True:
            if wanted is None:
                left = np.flatnonzero(~computed)
                if not len(left):
                    return
                labels, counts = np.unique(root[left], return_counts=True)
                if len(labels) == 1 and len(rows):
                    return
                if len(rows):  # outside the largest component, so that the answer may add a link
                    x = left[root[left] != labels[counts.argmax()]][0]
            else:
                if not len(wanted):
                    return
                x, wanted = wanted[0], wanted[1:]
            base = max(rows, key=lambda z: rows[z][x], default=None)
            if base is not None and 3 * rows[base][x] > 2 * self.n[x]:
                less = np.setdiff1d(self.sets[base], self.sets[x], assume_unique=True)
                more = np.setdiff1d(self.sets[x], self.sets[base], assume_unique=True)
                overlap = rows[base] - _overlaps(self.found, less, m) + _overlaps(self.found, more, m)
            else:
                overlap = _overlaps(self.found, self.sets[x], m)
            computed[x] = True
            if len(rows) >= 64:  # answers to derive others from
                rows.pop(next(iter(rows)))
            rows[x] = overlap
            near = self.alike(x, overlap)
            joined = np.unique(root[near])
            yield x, near, joined[joined != root[x]]
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Rows of one block after the other, from batches sorted by the block's keys."""
    held, now = [], None
    for batch in batches:
        at = list(zip(*(batch[k].to_pylist() for k in keys)))
        cuts = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]]
        for i, j in zip(cuts, [*cuts[1:], len(at)]):
            if at[i] != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = at[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _members(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes and sets in order of size, each once, with the rows they come from."""
    node = table["node"].to_numpy()
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table["shingles"]]
    _, once = np.unique(node, return_index=True)
    order = sorted(once, key=lambda i: (len(sets[i]), node[i]))
    return node[order], [sets[i] for i in order], np.array(order, np.int64)


def _joins(node: np.ndarray, answers) -> pa.RecordBatch:
    """Links that make one component of several: fewer than there are sets."""
    pairs = [(node[x], node[to]) for x, _, joins in answers for to in joins]
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(batches):
    for block in _blocks(batches, ["group", "block"]):
        node, sets, _ = _members(block)
        if len(sets) > 1:
            yield _joins(node, Group(sets).answers())


def _asked_links(batches):
    for block in _blocks(batches, ["group", "block", "part"]):
        node, sets, rows = _members(block)
        asked = np.unique(block["node"].to_numpy()[block["asked"].to_numpy(zero_copy_only=False)])
        wanted = np.flatnonzero(np.isin(node, asked))
        if len(wanted) and len(sets) > 1:
            yield _joins(node, Group(sets).answers(list(wanted)))


def grouped(documents: DataFrame, sets: DataFrame, *, hot: int, members: int, shingles: int) -> tuple[DataFrame, DataFrame]:
    """node, group, blocks: the groups of each set and the blocks these are cut into; and
    node, shingles of the sets that are in any."""
    spark = documents.sparkSession
    counts = sets.filter("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toArrow()
    sketch = np.zeros(CELLS, np.int64)
    sketch[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    n_buckets = int(max(partitions(spark), sketch.sum() // 4_000_000))
    too_many = sketch > hot + 2 * sketch.mean()
    size = sets.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    promising = written(_promising(documents, size, sketch, too_many, n_buckets), "promising")
    to_list = promising.join(size, "node").agg(F.sum("n")).first()[0] or 0
    listed = written(_listed(documents, id_filter(promising, "node"), sketch, too_many, int(to_list // 1_000_000 + 1)), "listed")
    wanted = id_filter(listed, "node")

    def ship(batches):
        seen = set()
        for batch in batches:
            keys, blobs = [], []
            for s in shingle_sets(_texts(batch)):
                key = set_key(s)
                if len(s) and key not in seen and may_hold(wanted, np.array([key]))[0]:
                    seen.add(key)
                    keys.append(key)
                    blobs.append(s.tobytes())
            if len(seen) > 2_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])

    shipped = documents.select("text").mapInArrow(ship, "node long, shingles binary")
    groups = listed.join(size, "node").groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / members, F.col("total") / shingles)).cast("int")
    groups = groups.select("group", blocks.alias("blocks"))
    return listed.join(groups, "group"), shipped


def linked(documents: DataFrame, sets: DataFrame, *, hot: int, members: int, shingles: int) -> DataFrame:
    """node, label: components of the sets that have links."""
    placed, shipped = grouped(documents, sets, hot=hot, members=members, shingles=shingles)
    # A few members are in all blocks of a group and join what belongs together.
    large = placed.filter("blocks > 1")
    turn = Window.partitionBy("group").orderBy("node")
    bridges = large.withColumn("k", F.row_number().over(turn)).filter("k <= 32").select(
        "node", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = placed.select("node", "group", F.pmod(F.hash("node"), F.col("blocks")).alias("block"))
    to = own.unionByName(bridges).distinct()
    met = to.join(shipped, "node").repartition("group", "block").sortWithinPartitions("group", "block")
    links = written(met.mapInArrow(_links, "a long, b long"), "links")
    labels = components(links)
    # Exactness of large groups: members outside the largest component meet all others.
    state = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = state.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("group").agg(F.max(F.struct("size", "label"))["label"].alias("most"))
    outside = written(state.join(most, "group").filter("label <> most").select("group", "node", "blocks"), "outside")
    if outside.isEmpty():
        return labels
    asked = outside.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(
        "group", "node", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asked"))
    parts = asked.select("group", "part").distinct()
    others = large.join(parts, "group").select("group", "node", "part", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), F.lit(False).alias("asked"))
    met = asked.unionByName(others.select(*asked.columns)).join(shipped, "node").repartition("group", "block", "part").sortWithinPartitions("group", "block", "part")
    more = met.mapInArrow(_asked_links, "a long, b long")
    return components(written(links.unionByName(more), "links"))


def _link_counts(batches):
    """node, links: alike documents that a set finds among the others of a cell."""
    for block in _blocks(batches, ["group", "part", "block"]):
        node, sets, rows = _members(block)
        if len(sets) < 2:
            continue
        asked, other = (block[c].to_numpy()[rows] for c in ("asked", "other"))
        copies = block["copies"].to_numpy()[rows]
        group = block["group"][0].as_py()
        known = block["groups"].to_pylist()
        # A pair that meets in several groups counts in the first of them.
        earlier = Group([np.array([g for g in known[i] if g < group], np.int64) for i in rows])
        links = np.zeros(len(node), np.int64)
        for x, near, _ in Group(sets).answers(list(np.flatnonzero(asked))):
            near = near[other[near] & (near != x)]
            links[x] = copies[np.setdiff1d(near, earlier.found(earlier.sets[x]))].sum()
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some])], ["node", "links"])


def link_counts(documents: DataFrame, *, hot: int = 1 << 20, members: int = 2000, shingles: int = 2_000_000) -> DataFrame:
    """A row per row of documents: doc_id, n_shingles, links (the other rows with a doc_id
    that are linked with it directly; null if its doc_id is).

    Every set's answer is computed, derived from that of the nearest computed set where there
    is one, and summed in its task. A group of b blocks has b * b cells, the sets of one block
    asking those of another, so each set travels 2 b - 1 times."""
    sets = measured(documents)
    rows = sets.filter("cell is null")
    placed, shipped = grouped(documents, sets, hot=hot, members=members, shingles=shingles)
    copies = rows.filter("n > 0").groupBy("node").agg(F.count("doc_id").alias("copies"))
    # A set is in fewer groups than it has shingles.
    about = placed.groupBy("node").agg(F.collect_list("group").alias("groups")).join(copies, "node")
    own = placed.withColumn("own", F.pmod(F.hash("node"), F.col("blocks"))).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = own.select("node", "group", F.col("own").alias("part"), F.col("k").alias("block"), F.lit(True).alias("asked"), (F.col("k") == F.col("own")).alias("other"))
    told = own.filter("k <> own").select("node", "group", F.col("k").alias("part"), F.col("own").alias("block"), F.lit(False).alias("asked"), F.lit(True).alias("other"))
    cells = asks.unionByName(told).join(about, "node").join(shipped, "node")
    met = cells.repartition("group", "part", "block").sortWithinPartitions("group", "part", "block")
    links = met.mapInArrow(_link_counts, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    found = rows.join(links, "node", "left").join(copies, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(
        F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)).alias("links"))


def classes(documents: DataFrame, *, hot: int = 1 << 20, members: int = 2000, shingles: int = 2_000_000) -> DataFrame:
    """A row per row of documents: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach, its own included)."""
    sets = measured(documents)
    rows = sets.filter("cell is null")
    labels = linked(documents, sets, hot=hot, members=members, shingles=shingles)
    named = rows.join(labels, "node", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    known = named.filter("doc_id is not null and label is not null")
    least = known.groupBy("label").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out


def first_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents without those that links tie to a smaller doc_id; columns unchanged."""
    later = small_side(classes(documents, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("later_id")).distinct(), "later")
    return documents.join(later, documents["doc_id"] == later["later_id"], "left_anti")
