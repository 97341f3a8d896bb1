"""Byte-level BPE by a dynamic program over prefixes, with exact appends and local edits.

Every prefix of a piece of text has one encoding, and that encoding ends in one token: the
prefix's last token. It is the only token t that ends there and that the merges leave beside
the last token of the prefix before it. The table of last tokens is all that is stored: the
encoding of any prefix is read by stepping back from its end, an append adds entries and
changes none, and after an edit the entries before it stay, those behind it are computed
anew until as many of them as the longest token is long have come out as they were.

Two tokens stand side by side if undoing their merges, youngest first, never meets a pair
that would have merged across their border earlier (``Vocabulary.beside``). A rank file
names no merges; every token's own last merge is the only split of it into two older tokens
that pass the same test.

Texts are cut by the pattern first and its matches are encoded separately, as ``tiktoken``
does. A match depends on the text from its start to at most two characters behind its end,
so an append or edit touches the matches near it only (``Encoded``).

Defined cases: null and empty texts have no tokens; repeated rows and null ids give a row
each; special tokens do not exist, their strings are ordinary text; a text is encoded whole,
and a piece without spaces of any length takes time in proportion to it; an empty table
gives an empty result; other columns are not read.

Scale: one pass over the documents, no shuffle. Different pieces of a group of texts fill
their tables side by side, in numpy. A task holds the pieces of one group (of one text, if
that is longer) and a memo of the last ``MEMO`` to twice as many encoded pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskloom.llm.common import mix, powers

MEMO = 1 << 18
SHORT = 48  # bytes; longer pieces are encoded one by one and not kept in the memo
FEW = 400
CHUNK = 20_000  # pieces whose tables are filled side by side
GROUP = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_POWER = powers(int(_BASE), SHORT + 1)


def _hash(token: bytes) -> int:
    out = 0
    for byte in token:
        out = (out * int(_BASE) + int(_VALUE[byte])) & (1 << 64) - 1
    return out


class _Table:
    """Numbers of 64-bit keys, looked up for whole arrays by open addressing."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        size = 1 << max(int(len(keys) * 8).bit_length(), 4)
        self._mask = np.uint64(size - 1)
        self._key, self._number = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        at, left = mix(keys) & self._mask, np.arange(len(keys))
        while len(left):
            free = left[self._number[at[left]] < 0]
            # Of several keys for one slot the first gets it, the others move on.
            first = free[np.unique(at[free], return_index=True)[1]]
            self._key[at[first]], self._number[at[first]] = keys[first], numbers[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & self._mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for unknown ones."""
        at = mix(keys) & self._mask
        out = self._number[at]
        other = np.flatnonzero((out >= 0) & (self._key[at] != keys))
        while len(other):
            at[other] = (at[other] + np.uint64(1)) & self._mask
            out[other] = self._number[at[other]]
            other = other[(out[other] >= 0) & (self._key[at[other]] != keys[other])]
        return out


class Vocabulary:
    """Tokens of a rank file, their splits, and the tables of last tokens of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = dict(map(reversed, ranks.items()))
        self.longest = max(map(len, ranks))
        self._lengths = [len(self.token[i]) if i in self.token else 0 for i in range(max(ranks.values()) + 1)]
        self._split: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._split[i] = (i, i)
            for k in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None and a < i and b < i and self._stay(a, b):
                    self._split[i], self._merged[a, b] = (a, b), i
                    break
        self._left, self._right = np.zeros((2, len(self._lengths)), np.int64)
        for i, (a, b) in self._split.items():
            self._left[i], self._right[i] = a, b
        pairs = np.array(list(self._merged), np.uint64).reshape(-1, 2)
        self._pairs = _Table(pairs[:, 0] << np.uint64(32) | pairs[:, 1], np.array(list(self._merged.values()), np.int64))
        known = [(token, i) for token, i in ranks.items() if len(token) <= SHORT]
        self._tokens = _Table(np.array([_hash(token) for token, _ in known], np.uint64), np.array([i for _, i in known], np.int64))

    def _stay(self, a: int, b: int) -> bool:
        """Whether no merge that is older than what made a and b crosses their border."""
        limit = len(self._lengths)
        while True:
            if self._merged.get((a, b), limit) < limit:
                return False
            left, right = self._split[a], self._split[b]
            # The younger of both is undone; a single byte cannot be.
            if a > b and left[0] != a or right[0] == b and left[0] != a:
                limit, a = a, left[1]
            elif right[0] != b:
                limit, b = b + 1, right[0]
            else:
                return True

    def beside(self, a: int, b: int) -> bool:
        found = self._beside.get((a, b))
        if found is None:
            if len(self._beside) >= 4 * MEMO:
                self._beside.clear()
            found = self._beside[a, b] = self._stay(a, b)
        return found

    def last_tokens(self, piece: bytes, table: array | None = None) -> array:
        """The last token of every prefix of ``piece``; ``table`` holds the first of them
        already and is extended."""
        table = array("I") if table is None else table
        rank, longest, beside = self.rank, self.longest, self.beside
        for end in range(len(table) + 1, len(piece) + 1):
            for start in range(max(end - longest, 0), end):
                token = rank.get(piece[start:end])
                if token is not None and (start == 0 or beside(table[start - 1], token)):
                    table.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {piece[end - 1]}")
        return table

    def _all_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stay`` of many pairs."""
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), len(self._lengths))
        while len(live):
            merged = self._pairs.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            crossed = (merged >= 0) & (merged < limit)
            out[live[crossed]] = False
            whole_a, whole_b = self._left[a] == a, self._left[b] == b
            undo_a = ~whole_a & ((a > b) | whole_b)
            go = ~crossed & ~(whole_a & whole_b)
            limit = np.where(undo_a, a, b + 1)[go]
            a, b = np.where(undo_a, self._right[a], a)[go], np.where(undo_a, b, self._left[b])[go]
            live = live[go]
        return out

    def many(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """The encodings of pieces of at most SHORT bytes, their tables filled side by side:
        one column of last tokens after the other."""
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        width = int(lengths[order[0]]) if len(pieces) else 0
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(pieces), width)
        hashes, table = np.zeros((width + 1, len(pieces)), np.uint64), np.zeros((width, len(pieces)), np.int64)
        counts = np.searchsorted(-lengths[order], -np.arange(width + 1), side="right")
        with np.errstate(over="ignore"):
            for end in range(1, width + 1):
                n = counts[end]
                hashes[end, :n] = hashes[end - 1, :n] * _BASE + _VALUE[data[:n, end - 1]]
                open_ = np.arange(n)
                for start in range(max(end - self.longest, 0), end):
                    token = self._tokens.find(hashes[end, open_] - hashes[start, open_] * _POWER[end - start])
                    at = np.flatnonzero(token >= 0)
                    if start:
                        at = at[self._all_stay(table[start - 1, open_[at]], token[at])]
                    table[end - 1, open_[at]] = token[at]
                    open_ = np.delete(open_, at)
                if len(open_):
                    raise ValueError("the vocabulary lacks a byte")
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        table = np.ascontiguousarray(table.T)
        for piece, at in zip(pieces, place):
            ids = self.walk(table[at, : len(piece)].tolist())
            # Tokens were found by 64-bit hashes; their bytes tell.
            yield ids if self.decode(ids) == piece else self.walk(self.last_tokens(piece))

    def edited(self, piece: bytes, table: array, at: int, removed: int, new: bytes) -> tuple[bytes, array]:
        """``piece`` and its table after ``removed`` bytes from ``at`` on give way to ``new``."""
        after = piece[:at] + new + piece[at + removed:]
        out, shift, same = table[:at], len(new) - removed, 0
        while len(out) < len(after):
            self.last_tokens(after[: len(out) + 1], out)
            old = len(out) - 1 - shift
            same = same + 1 if old >= at + removed and table[old] == out[-1] else 0
            if same == self.longest:  # no later entry can see a difference
                out += table[old + 1:]
        return after, out

    def walk(self, table, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, the whole piece if not given."""
        out, at = [], len(table) if end is None else end
        while at:
            out.append(table[at - 1])
            at -= self._lengths[out[-1]]
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Encoder:
    """Ids of texts: every match of the pattern by the table of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._memo: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _known(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of all these pieces. Pieces that were not asked for lately leave the memo."""
        if len(self._memo) >= MEMO:
            self._memo, self._before = {}, self._memo
        for piece in (pieces - self._memo.keys()) & self._before.keys():
            self._memo[piece] = self._before[piece]
        new = list(pieces - self._memo.keys())
        data = [piece.encode() for piece in new]
        # A handful is quicker one by one.
        short = [i for i, d in enumerate(data) if len(d) <= SHORT] if len(data) >= FEW else []
        for i in range(0, len(short), CHUNK):
            part = short[i: i + CHUNK]
            for k, ids in zip(part, self.vocabulary.many([data[k] for k in part])):
                self._memo[new[k]] = np.array(ids, "<u4").tobytes()
        known = {new[i]: np.array(self.vocabulary.walk(self.vocabulary.last_tokens(d)), "<u4").tobytes()
                 for i, d in enumerate(data) if len(d) > SHORT or len(data) < FEW}
        self._memo.update((p, known[p]) for p in known if len(p) <= SHORT)
        known.update((p, self._memo[p]) for p in pieces if p not in known)
        return known

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Every text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(text) for text in texts]
        known = self._known(set().union(*cut))
        for pieces in cut:
            yield b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), "<u4").tolist()


class Encoded:
    """A text with the tables of its pieces, kept up to date over appends and edits.

    ``touched`` counts the bytes whose entries the last change computed anew."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[tuple[bytes, array]] = []
        self.touched = 0
        self.replace(0, 0, text)

    def _fixed(self, upto: int) -> int:
        """Number of leading pieces that depend on the first ``upto`` characters only: a match
        looks at two characters behind its end, and at three from its start."""
        n = bisect_right(self.starts, upto)
        ends = [*self.starts[1:n], self.starts[n] if n < len(self.starts) else len(self.text)] if n else []
        while n and (ends[n - 1] + 2 > upto or self.starts[n - 1] + 3 > upto):
            n -= 1
        return n

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """The characters from ``start`` to ``stop`` give way to ``new``."""
        vocabulary, shift = self.encoder.vocabulary, len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        keep = self._fixed(start)
        at = self.starts[keep] if keep < len(self.starts) else len(self.text) if keep else 0
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        starts, pieces, rest, self.touched = [], [], [], 0
        for match in self.encoder.pattern.finditer(text, at):
            if match.start() in old and match.start() >= start + len(new):
                rest = range(old[match.start()], len(self.starts))
                break
            data, n = match.group().encode(), keep + len(pieces)
            before, table = self.pieces[n] if n < len(self.pieces) else (b"", array("I"))
            # Of the piece that stood here, what both begin and end with is not encoded anew.
            lead = _common(before, data)
            tail = _common(before[lead:][::-1], data[lead:][::-1])
            _, made = vocabulary.edited(before, table, lead, len(before) - lead - tail, data[lead: len(data) - tail])
            self.touched += len(data) - lead
            starts.append(match.start())
            pieces.append((data, made))
        self.starts = self.starts[:keep] + starts + [self.starts[i] + shift for i in rest]
        self.pieces = self.pieces[:keep] + pieces + [self.pieces[i] for i in rest]
        self.text = text

    def ids(self) -> list[int]:
        return [i for _, table in self.pieces for i in self.encoder.vocabulary.walk(table)]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else []
    return int(differ[0]) if len(differ) else n


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, made once in every process."""
    return Encoder(Vocabulary(read_ranks(path)), pattern)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls as empty ones, in lists of about GROUP characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(documents: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """A row per row of documents: doc_id, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the bytes that the ids decode to) and, if
    asked for, ids (binary, those integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            rows = []
            for texts in _groups(batch["text"]):
                for data in own.encode_all(texts):
                    ids = np.frombuffer(data, "<u4")
                    rows.append((len(ids), hashlib.sha256(data).hexdigest(),
                                 hashlib.sha256(own.vocabulary.decode(ids.tolist())).hexdigest(), data if with_ids else None))
            n, digest, decoded, data = zip(*rows) if rows else ((), (), (), ())
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_ids, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of rows of doc_id and ids, as ``encoded`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path, pattern).vocabulary.decode
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u4").tolist() if x.is_valid else [] for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(decode, ids), pa.binary())], ["doc_id", "bytes"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")
