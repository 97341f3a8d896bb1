import random
import re

import numpy as np
import pytest

from riskloom.llm import ngram_join as n


def sets_of(docs):
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(docs):
    sets = sets_of(docs)
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def cases(prose, copies=40):
    rng, docs = random.Random(2), []
    for g in range(4):
        base = prose(g, 90 + 20 * g)
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["Ünique", f"own{rng.randrange(9999)}"])
            docs.append((1000 * g + k, " ".join(w[: len(w) - rng.randrange(6)])))
    shared = " ".join(prose(77, 60))
    docs += [(9000 + k, shared + " " + " ".join(prose(500 + k, 15 + k))) for k in range(20)]
    docs += [(8000, None), (8001, ""), (8002, "  \t\n"), (8003, "One two"), (8004, "one  TWO"), (8005, "one two three four five"), (8006, "ONE two three four five"),
             (8007, "É two three four five"), (8008, "é two three four five"), (8009, "a b c d e f a b c d e f a b c d e"), (8010, " ".join(prose(5, 30_000)))]
    return docs + [docs[0], (8012, docs[5][1]), (8013, docs[5][1])]


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"members": 9}, {"members": 40, "shingles": 3000}])
def test_against_brute_force(documents, prose, options):
    docs = cases(prose)
    rows = n.classes(documents(docs), **options).collect()
    assert sorted(set(tuple(r) for r in rows)) == sorted(set(brute(docs))) and len(rows) == len(docs)
    assert len({r[2] for r in rows}) < len(docs) - 60  # the cases do link


def brute_links(docs):
    sets = sets_of(docs)
    alike = lambda x, y: x and 100 * len(x & y) >= 80 * len(x | y)
    return [(i, len(s), None if i is None else sum(bool(alike(s, o)) for k, (j, o) in enumerate(sets) if k != at and j is not None))
            for at, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"members": 9}, {"members": 40, "shingles": 3000}])
def test_every_link_is_counted(documents, prose, options):
    docs = cases(prose) + [(None, cases(prose)[3][1]), (None, "")]
    order = lambda r: (str(r[0]), r[1], str(r[2]))
    got = sorted((tuple(r) for r in n.link_counts(documents(docs), **options).collect()), key=order)
    assert got == sorted(brute_links(docs), key=order)


def test_links_of_a_triangle(documents, prose):
    base = prose(1, 200)
    docs = [(k, " ".join([*base[:190 - k], *base[190 - k:-1], f"end{k}"])) for k in range(3)]
    assert sorted(tuple(r)[::2] for r in n.link_counts(documents(docs)).collect()) == [(0, 2), (1, 2), (2, 2)]
    assert n.link_counts(documents([])).count() == 0


def test_sets_hash_what_words_say(prose):
    docs = [(i, t) for i, t in cases(prose)]
    got = list(n.shingle_sets([(t or "").encode() for _, t in docs]))
    assert [len(g) for g in got] == [len(s) for _, s in sets_of(docs)]


def test_derived_answers_equal_counted_ones():
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
    sets = sorted((np.unique(np.r_[rng.choice(base, 280, replace=False), rng.integers(10_000, 20_000, rng.integers(1, 60)).astype(np.uint64)]) for _ in range(60)), key=len)
    g = n.Group(sets)
    for x, near, _ in g.answers(list(range(60))):
        want = [y for y in range(60) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))]
        assert near.tolist() == want


def test_filter_and_nulls(documents, prose):
    t = " ".join(prose(3, 50))
    docs = documents([(5, t), (2, t), (2, t), (7, "other words that are not alike at all"), (None, t), (None, None)])
    assert sorted(r["doc_id"] or -1 for r in n.first_of_each(docs).collect()) == [-1, -1, 2, 2, 7]
    assert {r["component_id"] for r in n.classes(docs).filter("doc_id is null").collect()} == {None}
    assert n.classes(documents([])).count() == 0 and n.classes(documents([(1, None)])).collect()[0][2] == 1
