import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskloom.llm import prefix_bpe as b

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "aabbcceeinrst  '’éñ日本\n\t123._-="


@pytest.fixture(scope="module")
def own():
    return b.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.rank, special_tokens={}).encode_ordinary


def texts(n, length=80):
    rng = random.Random(n)
    return ["".join(rng.choices(LETTERS, k=rng.randrange(length))) for _ in range(n)]


def test_ids_are_those_of_tiktoken(own, theirs):
    """Side by side and one by one."""
    given = [*texts(1500), "ab" * 3000 + "xyz", "<|endoftext|>", "\x00\x1c\x85\u2028 \ud7ff\U0010ffff", "don't I'll 'S  x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(given)] == [theirs(t) for t in given]
    assert [own.encode(t) for t in given] == [theirs(t) for t in given]


def test_every_prefix_of_a_piece(own):
    """Every entry of the table ends the encoding of its prefix."""
    single = tiktoken.Encoding("s", pat_str="(?s).+", mergeable_ranks=own.vocabulary.rank, special_tokens={})._core_bpe.encode_single_piece
    rng = random.Random(2)
    for _ in range(150):
        piece = bytes(rng.choices(b"theinganrst \xc3\xa9", k=rng.randrange(1, 50)))
        table = own.vocabulary.last_tokens(piece)
        assert [own.vocabulary.walk(table, n) for n in range(1, len(piece) + 1)] == [single(piece[:n]) for n in range(1, len(piece) + 1)]


def test_small_vocabulary_against_merging():
    """All strings of a small alphabet against merging the pair of least rank again and again."""
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    for token in (b"ab", b"bc", b"aa", b"abc", b"aab", b"bcbc", b"caab"):
        ranks[token] = len(ranks)
    vocabulary = b.Vocabulary(ranks)

    def merged(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(x + y, 99), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(99, 0))
            if best[0] == 99:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 16))) for _ in range(1500)]
    assert [vocabulary.walk(vocabulary.last_tokens(p)) for p in pieces] == [merged(p) for p in pieces] == list(vocabulary.many(pieces))


def test_appends_and_edits(own, theirs):
    rng = random.Random(5)
    for text in texts(200):
        held = b.Encoded(own, text)
        for _ in range(6):
            i = rng.randrange(len(held.text) + 1)
            j = rng.randrange(i, min(len(held.text), i + 8) + 1)
            new = "".join(rng.choices("aest' \né'd1.", k=rng.randrange(6)))
            if rng.random() < 0.3:
                i = j = len(held.text)
            want = held.text[:i] + new + held.text[j:]
            held.replace(i, j, new)
            assert held.text == want and held.ids() == theirs(want)


def test_an_edit_stays_local(own, prose):
    held = b.Encoded(own, " ".join(prose(1, 20_000)))
    held.replace(60_000, 60_003, "xyz")
    assert held.touched < 100
    held.append(" and so on")
    assert held.touched < 100
    piece = b"ab" * 5000
    table = own.vocabulary.last_tokens(piece)
    after, changed = own.vocabulary.edited(piece, table, 4000, 3, b"zzzzz")
    assert after == piece[:4000] + b"zzzzz" + piece[4003:] and changed == own.vocabulary.last_tokens(after)


def test_documents(spark, documents, theirs):
    given = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "x"), (7, "日本 " * 9000), *((10 + i, t) for i, t in enumerate(texts(60)))]
    got = b.encoded(documents(given), PATH, public_tokenizers.PATTERN, with_ids=True)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(theirs(t or "")), digest(np.array(theirs(t or ""), "<u4").tobytes()), digest((t or "").encode())) for i, t in given]
    key = lambda r: (r[0] is not None, *r)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(want, key=key)
    back = b.decoded(got, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((r[0], bytes(r[1])) for r in back), key=lambda r: (r[0] is not None, *r)) == sorted(
        ((i, (t or "").encode()) for i, t in given), key=lambda r: (r[0] is not None, *r))


def test_empty_table_and_nulls(spark, documents):
    assert b.encoded(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(None, None, 5)], "doc_id long, ids binary, n_tokens long")
    assert [tuple(r) for r in b.decoded(nulls, PATH, public_tokenizers.PATTERN).collect()] == [(None, b"")]
