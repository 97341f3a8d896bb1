"""Exact substring removal: later copies of any 50 bytes go, the first stays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller doc_id. A longest-previous-factor array answers that: if suffixes stand in
lexicographic order, the longest match of a suffix with an earlier document is found at the
nearest suffix before or behind it that belongs to an earlier document (previous and next
smaller value), and its length is the least common prefix on the way. Where it reaches
LENGTH, the suffix starts a removed string.

One suffix array of a corpus fits no task, so suffixes are first dealt to groups that can be
ordered apart. Every string of LENGTH bytes owns an anchor: the 20 bytes in it with the
least hash (the leftmost of equals). Equal strings own equal anchors at the same place, so
only strings of one anchor have to be ordered together, and a string whose anchor no other
text has is not repeated at all.

1. Texts are measured: length, a 128-bit hash of the text, a sketch of anchor counts (fixed
   size). Of equal texts only the first is looked at; the later ones go as a whole.
2. Anchors, as few packed bytes each, are dealt to buckets; those that two different texts
   have are reported back by number.
3. Texts with such anchors send each anchor's surroundings (80 bytes) to the anchor's
   bucket. Equal surroundings answer at once: all but the first are repeated. For the rest,
   the suffixes of the strings are ordered and the factor array is computed.
4. The marked strings come back to their texts, which are cut.

Defined cases: null text is empty; texts shorter than LENGTH bytes keep everything; matches
never cross documents, and repeats inside one document stay; rows that repeat a doc_id count
as one document and keep what its own text keeps; rows with a null doc_id are first in order;
an empty table gives an empty result; other columns are not read.

Scale: what a task holds is a bucket, and their number grows with the input. Anchors in
sketch cells above ``hot`` and twice the mean do not meet in a bucket: their strings are hashed (128 bits), the
least doc_id of each is a partial aggregate, and it is joined back by Spark, which splits
skewed keys. Texts travel compressed and only if they can be affected. The driver sees the
sketch and a filter of 1 MB, both of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import FILTER_WORDS, Buckets, id_filter, may_hold, mix, partitions, unpacked, written

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # a string starts at most so far before its anchor
AROUND = REACH + LENGTH
PARTS = 64  # of the texts, at least: what buckets find goes to the texts in so many rows
PART = 4_000_000  # entries that a part may come to hold
CELLS = 1 << 16
CHUNK = 1 << 18
HEAVY = 50_000  # strings at most that every task knows the first rank of
SEGMENT = 1 << 19  # of a long text; positions have to fit 20 bits
PLACES = np.uint64((1 << 20) - 1)
FIRST = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = {s: np.uint64(pow(BASE, s, 1 << 64)) for s in (1, 2, 4, 8)}


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes from every position: 16 by doubling, then 4."""
    with np.errstate(over="ignore"):
        h = _VALUE[data]
        h = h[:-1] * _STEP[1] + h[1:]
        four = h[:-2] * _STEP[2] + h[2:]
        h = four[:-4] * _STEP[4] + four[4:]
        h = h[:-8] * _STEP[8] + h[8:]
        n = len(data) - GRAM + 1
        return mix(h[:n] * _STEP[4] + four[16 : 16 + n])


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about CHUNK bytes; the segments of a long text
    overlap so that every string of LENGTH bytes lies in one."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(len(t) - LENGTH + 1, 0), SEGMENT):
            part = t[s : s + SEGMENT + LENGTH - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, s, part))
            size += len(part)
    if held:
        yield held


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of text number, position, gram hash, and how far before it the first and the
    last string start that own the anchor."""
    for segments in _segments(texts):
        data = np.frombuffer(b"".join(s for _, _, s in segments), np.uint8)
        grams = _grams(data)
        # Hash and place in one number: the least is the leftmost of the least hashes.
        least = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= REACH + 1:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        rest = REACH + 1 - size
        least = np.minimum(least[:-rest], least[rest:]) if rest else least
        lengths = np.array([len(s) for _, _, s in segments])
        begins = np.cumsum(lengths) - lengths
        segment = np.repeat(np.arange(len(segments)), lengths)[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + LENGTH <= (begins + lengths)[segment])
        owner = (least[start] & PLACES).astype(np.int64)
        new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]
        at = np.flatnonzero(new)
        first, last, place = start[at], start[np.r_[at[1:], len(start)] - 1], owner[at]
        of = segment[first]
        shift = np.array([o for _, o, _ in segments])[of] - begins[of]
        yield np.array([i for i, _, _ in segments])[of], place + shift, grams[place], place - first, place - last


def longest_previous(order: np.ndarray, common: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest-previous-factor array of suffixes in lexicographic order.

    ``order``: rank of each suffix's document, ``common``: its common prefix with the suffix
    before it (0 for the first). For every suffix the longest common prefix with one of a
    smaller rank; values below ``least`` may come out smaller than they are."""

    def nearest(order, common):
        at, match = np.arange(len(order)) - 1, common.copy()
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            open_ = open_[(order[at[open_]] >= order[open_]) & (match[open_] >= least)]
            to = at[open_]
            match[open_], at[open_] = np.minimum(match[open_], match[to]), at[to]
            match[open_[at[open_] < 0]] = 0
            open_ = open_[at[open_] >= 0]
        return np.where((at >= 0) & (order[np.maximum(at, 0)] < order), match, 0)

    before = nearest(order, common)
    behind = nearest(order[::-1], np.r_[0, common[:0:-1]])[::-1]
    return np.maximum(before, behind)


def _suffix_order(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of equally long byte rows, and common prefixes of neighbours."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    wide[:, : strings.shape[1]] = strings
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    ordered = strings[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return order, np.r_[0, common]


def marked(around: np.ndarray, rank: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Bit o of an entry's number: its string that starts o bytes before its anchor also
    starts in a document of smaller rank. ``far`` and ``near`` bound o."""
    n = len(around)
    out = np.zeros(n, np.uint32)
    if not n:
        return out
    every = ((np.uint64(2) << far.astype(np.uint64)) - (np.uint64(1) << near.astype(np.uint64))).astype(np.uint32)
    with np.errstate(over="ignore"):
        weight = mix(np.arange(1, AROUND + 1, dtype=np.uint64)) | np.uint64(1)
        gram, whole = np.zeros(n, np.uint64), mix((far * 64 + near).astype(np.uint64))
        for j in range(AROUND):
            v = _VALUE[around[:, j]] * weight[j]
            whole += v
            if REACH <= j < REACH + GRAM:
                gram += v
        gram, whole = mix(gram), mix(whole)
    order = np.lexsort((rank, whole, gram))
    g, w = gram[order], whole[order]
    head = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    same = (around[order] == around[first]).all(axis=1) & (far[order] == far[first]) & (near[order] == near[first])
    # Equal surroundings in an earlier document: all strings are repeated.
    out[order] = np.where(same & (rank[first] < rank[order]), every[order], 0)
    lead = order[head | ~same]
    g = gram[lead]
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[cut, len(g)])
    several = np.repeat(size, size) > 1
    lead, turn = lead[several], np.repeat(np.cumsum(np.r_[0, size[:-1]]) // 10_000, size)[several]
    view = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)
    for k in np.unique(turn):
        rows = lead[turn == k]
        count = far[rows] - near[rows] + 1
        row = np.repeat(rows, count)
        o = np.repeat(far[rows], count) - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        suffixes, common = _suffix_order(view[row, REACH - o])
        hit = longest_previous(rank[row[suffixes]], common, LENGTH) >= LENGTH
        np.bitwise_or.at(out, row[suffixes[hit]], (np.uint32(1) << o[suffixes[hit]].astype(np.uint32)))
    # The same surroundings again in the first document: marked like the first ones.
    again = ~head & same & (rank[first] == rank[order])
    out[order[again]] = out[first[again]]
    return out


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch["text"].cast(pa.binary()).to_pylist()]


def _node(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _cells(grams: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so their upper bits are small numbers, and a cell of those
    would hold very many rare anchors; the lower bits, by which none is chosen, are even."""
    return (grams & np.uint64(CELLS - 1)).astype(np.int64)


def measured(documents: DataFrame) -> DataFrame:
    """rank, node, size, check (rest of the text's hash) of every row, and the sketch's cells."""

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        names = ["rank", "node", "size", "check", "cell", "count"]
        for batch in batches:
            texts = _bytes(batch)
            for _, _, grams, _, _ in anchors(texts):
                cells += np.bincount(_cells(grams), minlength=CELLS)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch["rank"], pa.array([_node(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64()), none, none], names)
        at = np.flatnonzero(cells)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(at), pa.array(cells[at])], names)

    return written(documents.mapInArrow(run, "rank long, node long, size long, check long, cell long, count long"), "texts")


def _part(nodes: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the texts that a text belongs to."""
    return (mix(nodes.view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)


def _parts(entries: int) -> int:
    return int(max(PARTS, entries // PART))


def _packed(part: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """A row per part of the texts, arrays packed: however many texts a bucket meets, it
    gives no more rows than there are parts."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(part)]
    pack = zstandard.ZstdCompressor(level=1).compress
    columns = {k: pa.array([pack(a[order[i:j]].tobytes()) for i, j in zip(cut, ends)], pa.binary()) for k, a in arrays.items()}
    return pa.table({"part": pa.array(part[cut], pa.int32()), **columns})


def _by_text(rows: DataFrame, kinds: dict[str, type], keys: list[str], blob: str) -> DataFrame:
    """Rows of :func:`_packed` as a row per text: its keys, and its other values side by side
    as little-endian 32-bit numbers in the column ``blob``."""

    def collect(t: pa.Table) -> pa.Table:
        arrays = {k: unpacked(t[k], kind, packed=True) for k, kind in kinds.items()}
        order = np.lexsort([arrays[k] for k in keys])
        arrays = {k: a[order] for k, a in arrays.items()}
        n = len(order)
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= arrays[k][1:] != arrays[k][:-1]
        cut = np.flatnonzero(new)
        ends = np.r_[cut[1:], n]
        values = np.stack([arrays[k] for k in kinds if k not in keys], 1)
        return pa.table({**{k: arrays[k][cut] for k in keys}, blob: pa.array([values[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())})

    return rows.groupBy("part").applyInArrow(collect, ", ".join(f"{k} long" for k in keys) + f", {blob} binary")


def _shared(documents: DataFrame, hot: np.ndarray, n_buckets: int, n_parts: int) -> DataFrame:
    """node, grams (32-bit hashes): the anchors that another text has as well, a row a text."""

    def entries(batches):
        out = Buckets(n_buckets, ["gram", "node"], runs="node")
        for batch in batches:
            texts = _bytes(batch)
            nodes = np.array([_node(t) for t in texts], np.int64)
            for text, _, grams, _, _ in anchors(texts):
                keep = ~hot[_cells(grams)]
                grams = grams[keep]
                out.add(((grams >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32), grams.astype(np.uint32), nodes[text[keep]])
                yield from out.flush(out.limit)
        yield from out.flush()

    def meet(t: pa.Table) -> pa.Table:
        gram = unpacked(t["gram"], np.uint32)
        node = np.repeat(unpacked(t["node"], np.int64), unpacked(t["node_runs"], np.uint32))
        order = np.lexsort((node, gram))
        g, v = gram[order], node[order]
        first = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        g, v = g[first], v[first]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[cut, len(g)])
        g, v = g[np.repeat(size, size) > 1], v[np.repeat(size, size) > 1]
        return _packed(_part(v, n_parts), node=v, gram=g)

    found = documents.select("text").mapInArrow(entries, "bucket int, gram binary, node binary, node_runs binary")
    met = found.groupBy("bucket").applyInArrow(meet, "part int, node binary, gram binary")
    return _by_text(met, {"node": np.int64, "gram": np.uint32}, ["node"], "grams")


def _compressed(documents: DataFrame, wanted: np.ndarray, digest: bool = False) -> DataFrame:
    """rank, node and the compressed text of rows that may be wanted; with ``digest`` all
    rows, those without the text with its sha256, and other columns as they are."""
    others = [c for c in documents.columns if c != "text"] if digest else ["rank"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = _bytes(batch)
            nodes = np.array([_node(t) for t in texts], np.int64)
            may = may_hold(wanted, nodes) if len(nodes) else np.zeros(0, bool)
            packed = pa.array([pack.compress(t) if m else None for t, m in zip(texts, may)], pa.binary())
            columns = [*(batch[c] for c in others), pa.array(nodes), packed]
            names = [*others, "node", "packed"]
            if digest:
                columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64()),
                            pa.array([None if m else hashlib.sha256(t).hexdigest() for t, m in zip(texts, may)], pa.string())]
                names += ["n_bytes", "check", "whole"]
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if digest else out.filter(pa.array(may))

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in others)
    return documents.mapInArrow(run, f"{kinds}, node long, packed binary" + (", n_bytes long, check long, whole string" if digest else ""))


def _text(packed) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _surroundings(texts: list[bytes], grams: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the anchors whose hashes are wanted: text number, position, far, near, around."""
    for text, place, gram, far, near in anchors(texts):
        keep = np.zeros(len(text), bool)
        for i in np.unique(text):
            own = text == i
            keep[own] = np.isin(gram[own].astype(np.uint32), grams[i])
        if keep.any():
            text, place, far, near = text[keep], place[keep], far[keep], near[keep]
            around = np.zeros((len(text), AROUND), np.uint8)
            for i in np.unique(text):
                own = np.flatnonzero(text == i)
                data = np.zeros(len(texts[i]) + REACH + LENGTH, np.uint8)
                data[REACH : REACH + len(texts[i])] = np.frombuffer(texts[i], np.uint8)
                around[own] = np.lib.stride_tricks.sliding_window_view(data, AROUND)[place[own]]
            yield text, place, far, near, around


def _ordered(first: DataFrame, n_buckets: int, n_parts: int) -> DataFrame:
    """rank, node, marks (position and string bits, 32 bits each), a row a text. ``first``:
    rank, node, packed and wanted grams of texts."""

    def send(batches):
        out = Buckets(n_buckets, ["around", "rank", "node", "place", "far", "near"], limit=200_000, packed=True)
        for batch in batches:
            for r, v, p, grams in zip(batch["rank"].to_pylist(), batch["node"].to_pylist(), batch["packed"].to_pylist(), batch["grams"].to_pylist()):
                for _, place, far, near, around in _surroundings([_text(p)], [np.frombuffer(grams, np.uint32)]):
                    key = np.zeros(len(place), np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(REACH, REACH + GRAM):
                            key = key * np.uint64(BASE) + _VALUE[around[:, j]]
                    out.add((mix(key) % np.uint64(n_buckets)).astype(np.int32), around, np.full(len(place), r, np.int64),
                            np.full(len(place), v, np.int64), place.astype(np.uint32), far.astype(np.uint8), near.astype(np.uint8))
                    yield from out.flush(out.limit)
        yield from out.flush()

    def order(t: pa.Table) -> pa.Table:
        take = lambda c, kind: unpacked(t[c], kind, packed=True)
        around, rank, node = take("around", np.uint8).reshape(-1, AROUND), take("rank", np.int64), take("node", np.int64)
        place, far, near = take("place", np.uint32), take("far", np.uint8).astype(np.int64), take("near", np.uint8).astype(np.int64)
        bits = marked(around, rank, far, near)
        hit = np.flatnonzero(bits)
        return _packed(_part(node[hit], n_parts), rank=rank[hit], node=node[hit], place=place[hit], bits=bits[hit])

    columns = "bucket int, around binary, rank binary, node binary, place binary, far binary, near binary"
    found = first.mapInArrow(send, columns).groupBy("bucket").applyInArrow(order, "part int, rank binary, node binary, place binary, bits binary")
    return _by_text(found, {"rank": np.int64, "node": np.int64, "place": np.uint32, "bits": np.uint32}, ["rank", "node"], "marks")


def _hot_strings(texts: list[bytes], hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the strings whose anchors are in hot cells: text number, position of the anchor, how
    far before it the string starts, and a 128-bit hash in two numbers."""
    weight = [mix(np.arange(k, k + LENGTH, dtype=np.uint64)) | np.uint64(1) for k in (1, 1000)]
    for text, place, gram, far, near in anchors(texts):
        keep = np.flatnonzero(hot[_cells(gram)])
        if not len(keep):
            continue
        text, place, far, near = text[keep], place[keep], far[keep], near[keep]
        ids, at = np.unique(text, return_index=True)
        low = np.maximum(np.minimum.reduceat(place, at) - REACH, 0)
        parts = [texts[i][a:b] for i, a, b in zip(ids, low, np.maximum.reduceat(place, at) + LENGTH)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        begin = np.repeat(np.cumsum(size) - size - low, np.diff(np.r_[at, len(text)]))
        count = far - near + 1
        row = np.repeat(np.arange(len(text)), count)
        o = np.repeat(far, count) - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        start = (begin + place)[row] - o
        h = [np.zeros(len(row), np.uint64) for _ in weight]
        with np.errstate(over="ignore"):
            for j in range(LENGTH):
                value = _VALUE[data[start + j]]
                for k in range(2):
                    h[k] += value * weight[k][j]
        yield text[row], place[row], o, *(mix(x).view(np.int64) for x in h)


def _hot_marks(documents: DataFrame, hot: np.ndarray) -> DataFrame:
    """As ``_ordered``, for strings whose anchors are in hot cells, by their hashes.

    The strings are counted first, added up in the tasks. Those that are most of the rows, HEAVY
    at most, are then answered where they are found; only the other repeated ones travel, a
    row each, and none of them is frequent."""

    def counted(batches):
        for batch in batches:
            texts, rank = _bytes(batch), batch["rank"].to_numpy()
            for text, _, _, h1, h2 in _hot_strings(texts, hot):
                r = rank[text]
                order = np.lexsort((r, h2, h1))
                h1, h2, r = h1[order], h2[order], r[order]
                cut = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
                ends = np.r_[cut[1:], len(r)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[cut], h2[cut], r[cut], r[ends - 1], ends - cut)], ["h1", "h2", "least", "most", "n"])

    rows = documents.select("rank", "text")
    counts = rows.mapInArrow(counted, "h1 long, h2 long, least long, most long, n long").groupBy("h1", "h2").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    least = written(counts.filter("least < most").select("h1", "h2", "least", "n"), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    heavy = least.filter(F.col("n") > total // HEAVY).select("h1", "h2", "least").toArrow().sort_by("h1")
    heavy1, heavy2, heavy_least = (heavy[c].to_numpy() for c in ("h1", "h2", "least"))
    repeated = id_filter(least, "h1")

    def answered(batches):
        names = ["rank", "node", "place", "bit", "h1", "h2", "marks"]
        for batch in batches:
            texts, rank = _bytes(batch), batch["rank"].to_numpy()
            for text, place, o, h1, h2 in _hot_strings(texts, hot):
                keep = may_hold(repeated, h1)
                text, place, o, h1, h2 = (x[keep] for x in (text, place, o, h1, h2))
                if not len(text):
                    continue
                ids, turn = np.unique(text, return_inverse=True)
                nodes = np.array([_node(texts[i]) for i in ids], np.int64)
                at = np.minimum(np.searchsorted(heavy1, h1), max(len(heavy1) - 1, 0))
                known = (heavy1[at] == h1) & (heavy2[at] == h2) if len(heavy1) else np.zeros(len(h1), bool)
                rest = np.flatnonzero(~known)
                if len(rest):
                    columns = [rank[text[rest]], nodes[turn[rest]], place[rest], np.int64(1) << o[rest], h1[rest], h2[rest]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(rest), pa.binary())], names)
                late = np.flatnonzero(known)
                late = late[heavy_least[at[late]] < rank[text[late]]]
                if not len(late):
                    continue
                # In order of text and position, as the strings are.
                t, p = turn[late], place[late]
                cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
                bits = np.bitwise_or.reduceat(np.uint32(1) << o[late].astype(np.uint32), cut)
                marks = np.stack([p[cut].astype(np.uint32), bits], 1)
                first = np.flatnonzero(np.r_[True, t[cut][1:] != t[cut][:-1]])
                packed = [marks[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(marks)])]
                own, none = t[cut][first], pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rank[ids[own]]), pa.array(nodes[own]), none, none, none, none, pa.array(packed, pa.binary())], names)

    def packed(batches):
        for b in batches:
            marks = np.stack([b["place"].to_numpy().astype(np.uint32), b["bits"].to_numpy().astype(np.uint32)], 1)
            yield pa.RecordBatch.from_arrays([b["rank"], b["node"], pa.array([m.tobytes() for m in marks], pa.binary())], ["rank", "node", "marks"])

    found = written(rows.mapInArrow(answered, "rank long, node long, place long, bit long, h1 long, h2 long, marks binary"), "hot")
    late = found.filter("marks is null").drop("marks").join(least, ["h1", "h2"]).filter("rank > least")
    late = late.groupBy("rank", "node", "place").agg(F.bit_or("bit").alias("bits")).mapInArrow(packed, "rank long, node long, marks binary")
    return found.filter("marks is not null").select("rank", "node", "marks").unionByName(late)


def _cut(text: bytes, marks: list[bytes]) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and runs removed."""
    both = np.frombuffer(b"".join(marks), np.uint32).reshape(-1, 2).astype(np.int64)
    step = np.zeros(len(text) + 1, np.int64)
    for o in range(REACH + 1):
        start = both[(both[:, 1] >> o) & 1 == 1, 0] - o
        np.add.at(step, start, 1)
        np.add.at(step, start + LENGTH, -1)
    gone = np.cumsum(step)[:-1] > 0
    runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicate(documents: DataFrame, *, hot: int = 1 << 17, with_text: bool = False) -> DataFrame:
    """A row per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, kept (binary: a cut may fall inside a character)."""
    spark = documents.sparkSession
    ranked = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("rank"), "doc_id", "text")
    texts = measured(ranked.select("rank", "text"))
    counts = texts.filter("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toArrow()
    sketch = np.zeros(CELLS, np.int64)
    sketch[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    too_many = sketch > hot + 2 * sketch.mean()
    shared = written(_shared(ranked, too_many, int(max(partitions(spark), sketch.sum() // 2_000_000)), _parts(sketch.sum())), "shared")
    rows = texts.filter("cell is null")
    # "first" is the smallest doc_id that has the text.
    first = rows.groupBy("node", "check", "size").agg(F.min("rank").alias("first"))
    total = shared.agg(F.sum(F.octet_length("grams") / 4)).first()[0] or 0
    asked = shared.join(first, "node").select("node", F.col("first").alias("rank"), "grams")
    sent = _compressed(ranked.select("rank", "text"), id_filter(shared, "node")).join(asked, ["node", "rank"])
    marks = _ordered(sent.select("rank", "node", "packed", "grams"), int(max(partitions(spark), total // 200_000)), _parts(total))
    if too_many.any():
        marks = marks.unionByName(_hot_marks(ranked, too_many))
    marks = written(marks, "marks")
    own = marks.groupBy("rank", "node").agg(F.collect_list("marks").alias("marks"))
    # The text itself is needed of all rows if it is asked for.
    needed = np.full(FILTER_WORDS, ~np.uint64(0)) if with_text else id_filter(marks, "node")
    source = _compressed(ranked, needed, digest=True)
    # A text and its marks meet where it meets its first rank, so texts are shuffled once; the
    # marks are those of the first rank.
    known = first.join(own.withColumnRenamed("rank", "first"), ["first", "node"], "left").select(
        F.col("node").alias("_node"), F.col("check").alias("_check"), "size", "first", "marks")
    joined = source.join(known, (source["node"] == known["_node"]) & (source["check"] == known["_check"]) & (source["n_bytes"] == known["size"]), "left") \
        .withColumn("marks", F.when(F.col("rank") == F.col("first"), F.col("marks")))
    nothing = hashlib.sha256(b"").hexdigest()

    def finish(batches):
        for batch in batches:
            out = []
            for r, n, f, packed, whole, m in zip(*(batch[c].to_pylist() for c in ("rank", "n_bytes", "first", "packed", "whole", "marks"))):
                if f is not None and r > f and n >= LENGTH:
                    out.append((n, 1, nothing, b""))
                elif m and packed is not None:
                    kept, gone, runs = _cut(_text(packed), m)
                    out.append((gone, runs, hashlib.sha256(kept).hexdigest(), kept))
                else:
                    text = b"" if packed is None else _text(packed)
                    out.append((0, 0, whole or hashlib.sha256(text).hexdigest(), text))
            gone, runs, digest, kept = zip(*out) if out else ((), (), (), ())
            columns = [batch["doc_id"], batch["n_bytes"], pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = joined.select("doc_id", "rank", "n_bytes", "first", "packed", "whole", "marks")
    return columns.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
