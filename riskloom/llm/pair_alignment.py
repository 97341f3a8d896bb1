"""Which tokens of two tokenizers stand for the same text, and how common each pair is.

A text is encoded by A (byte-level BPE) and B (pieces). Byte offsets where a token of A and
one of B both end cut the tokens into groups; every token of A is linked to every token of B
in its group. A pair's count is the number of documents that hold it linked.

1. Documents are encoded in blocks of about BLOCK characters. A block writes its ids and, for
   every shard (a hash of A's id), its distinct pairs with their number of documents.
2. Every shard's distinct pairs get a minimal perfect hash: levels of bits, in which a key
   owns the first bit that no other key of the level wants; its number is the count of set
   bits before. The keys lie in an array by number, against which lookups are verified.
3. Leaves of a shard's blocks add their counts up in dense vectors by number, and a tree of
   sums with FAN branches at a node gives the shard's counts, and which pairs reach their
   token of A's highest count.
4. The pairs of a block are looked up in the shards, and a second pass aligns the block's ids
   again and adds up what they found.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte
by byte (a text that holds U+2581, say), have no tokens; special tokens do not exist, their
strings are ordinary text; repeated rows, and rows of equal or null ids, are documents of
their own; an empty table gives an empty result; other columns are not read. A text is
encoded whole; in a group of very many tokens pairs of ids are counted, not links listed.

Scale: no table is broadcast and the driver sees a number per shard. A task holds a block, or
a shard's keys (at most as many as B has ids for each of its ids of A) and one leaf.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import mix, partitions, unpacked, written
from riskloom.llm.packing import _byte_of, encoder

BLOCK = 2_000_000  # characters
LEAF = 1_000_000  # entries of a shard that one leaf adds up
FAN = 8
WIDE = 1 << 14  # links of a group, beyond which its pairs are counted by distinct ids
OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        self.a = encoder(a_path, True)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = lambda text: b.encode(text, num_threads=1)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids have to fit 16 bits")
        self.a_length, self.b_length = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text; none where the tokens are not the text."""
        none = np.zeros(0, np.uint16)
        if not text:
            return none, none
        a, b, data = self.a(" " + text), self.b(text), b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return none, none
        return np.array(a, np.uint16), np.array(b, np.uint16)


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Alignment:
    """The groups and links of a block of documents, whose ids lie one behind the other."""

    def __init__(self, own: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.uint16), *ids]) for ids in (a, b))
        a_end, b_end = np.cumsum(own.a_length[self.a]), np.cumsum(own.b_length[self.b])
        # Both tokenizers give all bytes of every text, so ends of texts are ends of groups.
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        self.a_in, self.b_in = (np.bincount(g, minlength=len(cuts)) for g in (self.a_group, self.b_group))
        self.a_doc = np.repeat(np.arange(len(self.n_a)), self.n_a)
        a_first = np.cumsum(self.a_in) - self.a_in
        self.group_doc = self.a_doc[a_first]
        self._firsts = a_first, np.cumsum(self.b_in) - self.b_in
        self.n_groups = np.bincount(self.group_doc, minlength=len(self.n_a))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, pair (A's id in the high 16 bits) and number of links, every pair of a
        document once, by document and pair."""
        wide = self.a_in * self.b_in > WIDE
        rows = np.flatnonzero(~wide[self.a_group])
        each = self.b_in[self.a_group[rows]]
        token = np.repeat(rows, each)
        other = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each) + self._firsts[1][self.a_group[token]]
        keys = self.a[token].astype(np.uint64) << np.uint64(16) | self.b[other]
        found, n = np.unique(self.a_doc[token].astype(np.uint64) << np.uint64(32) | keys, return_counts=True)
        more = [(found, n)]
        for g in np.flatnonzero(wide):
            (a, m), (b, k) = (np.unique(ids[first[g]: first[g] + count[g]], return_counts=True)
                              for ids, first, count in ((self.a, self._firsts[0], self.a_in), (self.b, self._firsts[1], self.b_in)))
            pairs = (np.uint64(self.group_doc[g]) << np.uint64(32) | a.astype(np.uint64)[:, None] << np.uint64(16)) | b.astype(np.uint64)
            more.append((pairs.ravel(), (m[:, None] * k).ravel()))
        if len(more) > 1:
            found, place = np.unique(np.concatenate([f for f, _ in more]), return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, place, np.concatenate([k for _, k in more]))
        return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), n

    def texts(self) -> Iterator[str]:
        """Every document's groups: ``a1,a2|b1;a3|b2,b3``."""
        words = _words()
        a_last = np.r_[self.a_group[1:] != self.a_group[:-1], True][: len(self.a)]
        b_last = np.r_[self.b_group[1:] != self.b_group[:-1], True][: len(self.b)]
        ends = np.cumsum(self.n_b)[self.n_b > 0] - 1
        kind = np.where(b_last, 2, 0)
        kind[ends] = 3
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + self._firsts[1][self.a_group]] = self.a + (a_last.astype(np.int64) << 16)
        out[np.arange(len(self.b)) + (self._firsts[0] + self.a_in)[self.b_group]] = self.b + (kind << 16)
        stop = np.cumsum(self.n_a + self.n_b)
        for i, j in zip((stop - self.n_a - self.n_b).tolist(), stop.tolist()):
            yield "".join(map(words.__getitem__, out[i:j].tolist()))


@cache
def _words() -> list[str]:
    return [f"{i}{end}" for end in (",", "|", ";", "") for i in range(1 << 16)]


class PerfectHash:
    """Numbers 0 .. n - 1 of n different keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        totals = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self._rank = [np.cumsum(x) - 1 + t for x, t in zip(levels, totals)]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 2 * len(keys)
            at = cls._slots(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; a key that is not one of the n gets any, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self._rank)):
            at = self._slots(keys[left], level, len(bits))
            out[left] = np.where(bits[at], rank[at], -1)
            left = left[~bits[at]]
        return out

    def packed(self) -> tuple[list[int], list[bytes]]:
        return [len(x) for x in self.levels], [np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, sizes: list[int], bits: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)])


def _blob(array: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(array.tobytes())


def _take(column, kind) -> np.ndarray:
    return unpacked(column, kind, packed=True)


def encoded(documents: DataFrame, a_path: str, b_path: str, n_shards: int) -> DataFrame:
    """Rows of blocks (block, doc_ids, n_a, n_b, and 16-bit ids a, b, all packed) and of their
    pairs (block, shard, keys, counts), written to the shared folder."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, turn = tokenizers(a_path, b_path), TaskContext.get().partitionId(), 0
        held: list = []
        names = ["block", "doc_ids", "n_a", "n_b", "a", "b", "shard", "keys", "counts"]

        def block() -> pa.RecordBatch:
            number = task << 32 | turn
            made = Alignment(own, [a for _, a, _ in held], [b for _, _, b in held])
            _, keys, _ = made.links()
            keys, counts = np.unique(keys, return_counts=True)
            shard = (mix((keys >> np.uint32(16)).astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
            ends = np.r_[cut[1:], len(shard)]
            # One row for the documents, then one for every shard.
            ids, m = pa.concat_arrays([d for d, _, _ in held]), len(cut)
            first = lambda array: pa.array([_blob(array, 6), *[None] * m], pa.binary())
            others = lambda parts: pa.array([None, *parts], pa.binary())
            offsets = pa.array([0, *[len(ids)] * (m + 1)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([number] * (m + 1), pa.int64()), pa.ListArray.from_arrays(offsets, ids),
                first(made.n_a), first(made.n_b), first(made.a), first(made.b), pa.array([None, *shard[cut].tolist()], pa.int32()),
                others(_blob(keys[i:j]) for i, j in zip(cut, ends)), others(_blob(counts[i:j]) for i, j in zip(cut, ends))], names)

        size = 0
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                text = text.as_py()
                held.append((batch["doc_id"][i: i + 1], *own.encode(text)))
                size += len(text or "")
                if size >= BLOCK:
                    yield block()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield block()

    return written(documents.select("doc_id", "text").mapInArrow(
        run, f"block long, doc_ids array<{kind}>, n_a binary, n_b binary, a binary, b binary, shard int, keys binary, counts binary"), "aligned")


def _distinct(t: pa.Table) -> pa.Table:
    keys = np.unique(_take(t["keys"], np.uint32))
    return pa.table({"shard": t["shard"][:1], "keys": pa.array([_blob(keys)], pa.binary())})


def _hashed(t: pa.Table) -> pa.Table:
    keys = np.unique(_take(t["keys"], np.uint32))
    made = PerfectHash.of(keys)
    sizes, bits = made.packed()
    held = np.empty_like(keys)
    held[made.numbers(keys)] = keys
    return pa.table({"shard": t["shard"][:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.binary())),
                     "held": pa.array([_blob(held)], pa.binary())})


def _lookup(table: pa.Table):
    """A function from pairs to their verified numbers, and the keys by number."""
    row = table.slice(0, 1).to_pylist()[0]
    made, held = PerfectHash.unpacked(row["sizes"], row["bits"]), _take(table["held"].slice(0, 1), np.uint32)

    def numbers(keys: np.ndarray) -> np.ndarray:
        at = made.numbers(keys)
        if (at < 0).any() or (held[at] != keys).any():
            raise KeyError("a pair that was not hashed")
        return at

    return numbers, held


def _leaf(entries: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense vector of a leaf's blocks."""
    numbers, held = _lookup(hashes)
    vector = np.zeros(len(held), np.int64)
    for keys, counts in zip(entries["keys"], entries["counts"]):  # a block's keys are distinct
        vector[numbers(_take([keys], np.uint32))] += _take([counts], np.uint32)
    return pa.table({"shard": hashes["shard"][:1], "branch": hashes["leaf"][:1], "vector": pa.array([_blob(vector)], pa.binary())})


def _summed(t: pa.Table) -> pa.Table:
    vector = sum(_take([v], np.int64) for v in t["vector"])
    return pa.table({"shard": t["shard"][:1], "branch": t["up"][:1], "vector": pa.array([_blob(vector)], pa.binary())})


def _highest(vectors: pa.Table, hashes: pa.Table) -> pa.Table:
    """A shard's counts by number, and whether a pair has its token of A's highest count."""
    held, counts = _take(hashes["held"], np.uint32), _take(vectors["vector"], np.int64)
    best = np.zeros(1 << 16, np.int64)
    np.maximum.at(best, held >> 16, counts)
    row = {c: hashes[c] for c in ("shard", "sizes", "bits", "held")}
    return pa.table({**row, "total": pa.array([_blob(counts)], pa.binary()), "best": pa.array([_blob(counts == best[held >> 16])], pa.binary())})


def _found(entries: pa.Table, shards: pa.Table) -> pa.Table:
    """Every block's pairs with their counts, a row a block."""
    numbers, _ = _lookup(shards)
    total, best = _take(shards["total"], np.int64), _take(shards["best"], np.bool_)
    rows = [numbers(_take([keys], np.uint32)) for keys in entries["keys"]]
    return pa.table({"block": entries["block"], "keys": entries["keys"], "total": pa.array([_blob(total[r]) for r in rows], pa.binary()),
                     "best": pa.array([_blob(best[r]) for r in rows], pa.binary())})


def pair_counts(entries: DataFrame) -> DataFrame:
    """A row per shard: the hash (sizes, bits), held (pairs by number), total, best.
    ``entries`` (block, shard, branch, keys, counts) are dealt to leaves by shard and branch."""
    distinct = entries.groupBy("shard", "branch").applyInArrow(_distinct, "shard int, keys binary")
    hashes = written(distinct.groupBy("shard").applyInArrow(_hashed, "shard int, sizes array<long>, bits array<binary>, held binary"), "hashes")
    vectors = entries.groupBy("shard", "branch").cogroup(_for_leaves(hashes, entries).groupBy("shard", "leaf")).applyInArrow(
        _leaf, "shard int, branch int, vector binary")
    # One sum more than the widest shard needs changes nothing.
    width = (entries.agg(F.max("branch")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // FAN)
        up = F.floor(F.col("branch") / FAN).cast("int")
        vectors = vectors.withColumn("up", up).groupBy("shard", "up").applyInArrow(_summed, "shard int, branch int, vector binary")
    return written(vectors.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(
        _highest, "shard int, sizes array<long>, bits array<binary>, held binary, total binary, best binary"), "counts")


def _for_leaves(shards: DataFrame, entries: DataFrame) -> DataFrame:
    """A shard's row for every leaf of it."""
    return shards.join(entries.select("shard", F.col("branch").alias("leaf")).distinct(), "shard")


def align(documents: DataFrame, a_path: str, b_path: str, *, leaf: int = LEAF, with_groups: bool = False) -> DataFrame:
    """A row per row of documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose
    count is the highest of their token of A), count_sum (over links), groups_sha256 and, if
    asked for, groups."""
    spark = documents.sparkSession
    rows = encoded(documents, a_path, b_path, min(partitions(spark), 1 << 16))
    entries = rows.filter("shard is not null").select("block", "shard", "keys", "counts")
    # An entry takes a few packed bytes; this many leaves hold about ``leaf`` entries each.
    sizes = entries.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("keys")) / (2 * leaf)).cast("int").alias("leaves"))
    entries = written(entries.join(sizes, "shard").withColumn("branch", F.pmod(F.xxhash64("block"), F.col("leaves")).cast("int")).drop("leaves"), "entries")
    shards = pair_counts(entries)
    found = entries.groupBy("shard", "branch").cogroup(_for_leaves(shards, entries).groupBy("shard", "leaf")).applyInArrow(
        _found, "block long, keys binary, total binary, best binary")
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = rows.filter("shard is null").select("block", "doc_ids", "n_a", "n_b", "a", "b")

    def finish(docs: pa.Table, counts: pa.Table) -> pa.Table:
        own = tokenizers(a_path, b_path)
        each = lambda c: np.split(_take(docs[c], np.uint16), np.cumsum(_take(docs[f"n_{c}"], np.int64))[:-1])
        block = Alignment(own, each("a"), each("b"))
        doc, key, n = block.links()
        keys, total, best = _take(counts["keys"], np.uint32), _take(counts["total"], np.int64), _take(counts["best"], np.bool_)
        order = np.argsort(keys)
        at = order[np.searchsorted(keys, key, sorter=order)] if len(key) else np.zeros(0, np.int64)
        sums = np.zeros((3, len(block.n_a)), np.int64)
        for out, of in zip(sums, (n, n * best[at], n * total[at])):
            np.add.at(out, doc, of)
        texts = list(block.texts())
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        columns = [docs["doc_ids"].combine_chunks().flatten(), block.n_a, block.n_b, block.n_groups, *sums, digests] + [texts] * with_groups
        return pa.table(dict(zip(names, columns)))

    names = ["doc_id", *OUT, "groups_sha256"] + ["groups"] * with_groups
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in OUT) + ", groups_sha256 string" + ", groups string" * with_groups
    return ids.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)
