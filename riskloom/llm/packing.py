"""Packing: documents are laid end to end and cut into sequences of a fixed length.

Pass one tokenizes every document once, ends it with ``end_id`` and writes the ids with the
partition they came from and their offset inside it. The token totals of the partitions, one
number each, are summed to the partitions' global offsets. Pass two reads the written ids,
adds both offsets and cuts at multiples of the length; every piece is a boundary record.
All sequences but the last are full, so padding is less than one sequence in all.

Ids are those of the given ``tokenizers`` file. Its byte-level BPE vocabulary is loaded into
the faster ``tiktoken`` encoder, which gives the same ids (checked in ``tests/llm``). As in
``tokenizers``, a text is cut at the file's added tokens first, the longest of those that
start at a place, and each gives its one id; ``encode_special_tokens=True`` takes the
special ones as ordinary text, and is the default of ``pack``. The queries set it to False,
which is the default of the file.

Defined cases: null and empty texts are the end id alone; repeated rows are packed as often
as they occur; a null doc_id stays null; an empty table has no pieces; a document longer
than a sequence is cut as often as needed. Other columns are not read.

Recovery: pieces depend on the written table only, so a lost executor repeats its part and
finds the same offsets.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

LENGTH = 2048
END = 1
# Bytes of text or ids that a task works on and hands on at a time, one row at least.
SLICE = 1 << 20
# The pattern that splits text before merging; fixed by the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies print bytes as letters: printable ones as themselves, the
    others as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str, encode_special_tokens: bool = True) -> Callable[[str], list[int]]:
    """The ids of a text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t for t in spec["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    ordinary = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut_at = {c: t["id"] for c, t in added.items() if not (encode_special_tokens and t["special"])}
    if wide := [c for c in cut_at if any(added[c][k] for k in ("single_word", "lstrip", "rstrip"))]:
        raise ValueError(f"added tokens that depend on the text around them: {wide}")
    if not cut_at:
        return ordinary
    token = re.compile("(" + "|".join(re.escape(c) for c in sorted(cut_at, key=len, reverse=True)) + ")")

    def ids(text: str) -> list[int]:
        pieces = token.split(text)
        out = ordinary(pieces[0])
        for found, after in zip(pieces[1::2], pieces[2::2]):
            out.append(cut_at[found])
            out += ordinary(after)
        return out

    return ids


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about SLICE bytes of the column at a time."""
    turn = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
    cuts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]][: len(turn)])
    for a, b in zip(cuts, np.r_[cuts[1:], len(turn)]):
        yield batch.slice(a, b - a)


def tokenized(documents: DataFrame, tokenizer: str, *, end_id: int = END, encode_special_tokens: bool = True) -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), n and ids (little-endian
    unsigned 32-bit), written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer, encode_special_tokens), TaskContext.get().partitionId(), 0
        for batch in (s for whole in batches for s in _slices(whole, "text")):
            ids, starts, counts = [], [], []
            for text in batch["text"]:
                one = enc(text.as_py() or "")
                one.append(end_id)
                ids.append(np.array(one, dtype="<u4").tobytes())
                starts.append(before)
                counts.append(len(one))
                before += len(one)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return written(documents.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {kind}, part int, before long, n long, ids binary"), "tokens")


def offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of every partition; one number a partition comes to the driver."""
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    out, so_far = {}, 0
    for part, n in totals:
        out[part], so_far = so_far, so_far + n
    return out


def pack(documents: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END, with_ids: bool = False,
         encode_special_tokens: bool = True) -> DataFrame:
    """A row per piece: doc_id, start (its document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in the sequence) and, if asked for, ids."""
    tokens = tokenized(documents, tokenizer, end_id=end_id, encode_special_tokens=encode_special_tokens)
    first = offsets(tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for whole in batches for s in _slices(whole, "ids")):
            part = batch["part"].to_numpy(zero_copy_only=False)
            at = batch["before"].to_numpy() + np.fromiter((first[p] for p in part), np.int64, len(part))
            n = batch["n"].to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(at[row], (at[row] // length + nth) * length)
            end = np.minimum(at[row] + n[row], (at[row] // length + nth + 1) * length)
            start, ids = begin - at[row], batch["ids"]
            held = [memoryview(ids[i].as_buffer()) for i in range(len(n))]
            cuts = [held[i][4 * s : 4 * (s + k)] for i, s, k in zip(row, start, end - begin)]
            out = [batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(end - begin),
                   pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(n[row]),
                   pa.array(begin // length), pa.array(begin % length)]
            if with_ids:
                out.append(pa.array([bytes(c) for c in cuts], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names[1:])
    return tokens.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, padded to ``length`` unless its
    length is a power of two. At most ``length`` pieces meet in one row."""
    whole = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    full = F.concat(ids, F.unhex(F.repeat(F.hex(pad), (length - F.col("n_tokens")).cast("int"))))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return whole.select("sequence_id", "n_tokens", F.when(power, ids).otherwise(full).alias("ids"))
