import hashlib
import os
import random
import string

import numpy as np
import pytest

from riskloom.llm import suffix_dedup as s


def brute(docs):
    """n_bytes, n_removed, n_spans and digest by looking up every string."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for q in range(len(b) - s.LENGTH + 1):
            w = b[q:q + s.LENGTH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for q in range(len(b) - s.LENGTH + 1):
            if first[b[q:q + s.LENGTH]] < i:
                gone[q:q + s.LENGTH] = [True] * s.LENGTH
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases(prose):
    base = [" ".join(prose(k, 120)) for k in range(6)]
    rng = random.Random(4)
    docs = [(10 + k, t) for k, t in enumerate(base)]
    for k in range(25):  # near copies: a word replaced, a piece moved, ends cut
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["ñandú", "x", "é" * 9])
        a = rng.randrange(len(w))
        docs.append((100 + k, " ".join(rng.choice([w, w[a:] + w[:a], w[a:], w[:a]]))))
    docs += [(3, None), (4, ""), (5, "short"), (6, base[0][:50]), (7, base[0][1:51]), (8, base[0][:49]), (200, base[1]), (201, base[1]), (201, base[1]),
             (300, "ab" * 200), (301, "ab" * 90), (302, "a" * 400), (303, "a" * 49), (304, "\0" * 60), (305, "\0" * 120), (306, base[2] + base[3]), (307, "日本語の文" * 30), (308, "x日本語の文" * 20)]
    return docs


@pytest.mark.parametrize("hot", [1 << 17, 1])
def test_against_brute_force(documents, prose, hot):
    docs = cases(prose)
    got = s.deduplicate(documents(docs), hot=hot, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(docs)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_empty_table(documents):
    assert s.deduplicate(documents([])).count() == 0


def test_very_long_text(documents, prose):
    long = " ".join(prose(1, 120_000))
    assert len(long) > s.SEGMENT
    docs = [(1, long), (2, "q" + long[400_000:700_000]), (3, long[500_000:500_060])]
    got = {r["doc_id"]: tuple(r)[1:4] for r in s.deduplicate(documents(docs)).collect()}
    assert got == {1: (len(long), 0, 0), 2: (300_001, 300_000, 1), 3: (60, 60, 1)}


def test_null_ids_come_first(documents, prose):
    t = " ".join(prose(9, 40))
    got = sorted((r["doc_id"] is not None, r["n_removed"]) for r in s.deduplicate(documents([(None, t), (-5, t)])).collect())
    assert got == [(False, 0), (True, len(t))]


def test_passage_repeated_inside_a_document(documents, prose):
    """Both copies of a passage go where an earlier document has a part of it."""
    passage = " ".join(prose(7, 60))
    docs = [(1, "x" + passage[40:140] + "y"), (2, f"{passage} and {passage} or {passage}"), (3, passage[100:200] * 3)]
    for hot in (1 << 17, 1):
        assert sorted(tuple(r) for r in s.deduplicate(documents(docs), hot=hot).collect()) == brute(docs)


def test_marks_of_random_strings():
    for seed in range(200):
        rng = random.Random(seed)
        letters = rng.choice([b"a", b"ab", b"abcdefgh\0", bytes(range(256))])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randrange(20, 160))) for _ in range(4)]
        docs = [b"".join(rng.choice(pool)[rng.choice([0, 0, rng.randrange(15)]):] for _ in range(rng.randrange(1, 6))) for _ in range(6)]
        first, rows = {}, []
        for i, t in enumerate(docs):
            for q in range(len(t) - s.LENGTH + 1):
                first.setdefault(t[q:q + s.LENGTH], i)
            every = [g.astype(np.uint32) for _, _, g, _, _ in s.anchors([t])]
            for _, place, far, near, around in s._surroundings([t], [np.concatenate([*every, np.zeros(0, np.uint32)])]):
                rows.append((np.full(len(place), i), place, far.astype(np.int64), near.astype(np.int64), around))
        if rows:
            rank, place, far, near, around = (np.concatenate(x) for x in zip(*rows))
            bits = s.marked(around, rank, far, near)
            got = {(int(r), int(p) - o) for r, p, b in zip(rank, place, bits) for o in range(s.REACH + 1) if b >> np.uint32(o) & 1}
            assert got == {(i, q) for i, t in enumerate(docs) for q in range(len(t) - s.LENGTH + 1) if first[t[q:q + s.LENGTH]] < i}


def test_factor_array():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        order, common = rng.integers(0, 6, n), np.r_[0, rng.integers(0, 5, n)][:n]
        common[0] = 0
        want = [max([0, *(min(common[min(i, j) + 1:max(i, j) + 1]) for j in range(n) if order[j] < order[i])]) for i in range(n)]
        assert s.longest_previous(order, common).tolist() == want


def test_disk_holds_the_texts_once(spark, documents):
    """Of all that the steps shuffle, only the last join's texts are left when the rows are made."""
    rng = random.Random(8)
    shared = "".join(rng.choices(string.printable, k=400))
    texts = [shared + "".join(rng.choices(string.printable, k=15_000)) for _ in range(200)]
    df = documents(list(enumerate(texts)))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n: os.path.getsize(n) for n in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n and n.endswith(".data")}

    before = shuffled()
    got = {r.doc_id: r.n_removed for r in s.deduplicate(df).collect()}
    left = sum(n for name, n in shuffled().items() if name not in before)
    assert got[0] == 0 and all(got[i] >= 400 for i in range(1, 200))
    assert 0 < left < 1.5 * sum(map(len, texts))


def test_hot_strings_travel_only_if_they_are_rare(spark, documents, monkeypatch):
    """A string of most rows is answered where it is found; whatever is answered where, the
    result is that of looking up every string."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(40)]
    line = " ".join(rng.choices(words, k=30))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + line * (i % 3) + " ".join(rng.choices(words, k=5)) + "é" * (i % 40)) for i in range(60)]
    rows += [(60, rows[5][1]), (61, None), (62, line)]
    tables, written = {}, s.written
    monkeypatch.setattr(s, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    sent = []
    for heavy in (50_000, 2_000, 1):
        tables.clear()
        monkeypatch.setattr(s, "HEAVY", heavy)
        got = sorted(map(tuple, s.deduplicate(documents(rows), hot=-(1 << 40)).collect()))
        assert got == brute(rows)
        sent.append(tables["hot"].filter("marks is null").count())
        assert tables["hot"].filter("marks is not null").isEmpty() == (heavy == 1)
    # A few pass the filter of repeated strings that are none.
    assert 50 * sent[0] < sent[2] and sent[0] < sent[1] < sent[2]


def test_rare_anchors_fill_all_cells_alike():
    """No cell is hot because least hashes are small: only a frequent anchor makes one so."""
    text = bytes(np.random.default_rng(1).integers(32, 127, 2_000_000, dtype=np.uint8))
    count = sum(np.bincount(s._cells(grams), minlength=s.CELLS) for _, _, grams, _, _ in s.anchors([text]))
    assert count.sum() > 100_000 and count.max() < 20
