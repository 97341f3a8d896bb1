import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, turns string, path int, chars int, family string"


def lists(rows):
    """conv_id to its (role, text) turns in order; ties by digest."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            digest = hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
            out.setdefault(c, []).append((turn is not None, turn or 0, digest, r, x))
    return {c: tuple((r, x) for *_, r, x in sorted(t)) for c, t in out.items()}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {n: 0 for n in members}
    own = {n: (len(m) - 1) * len(n[-1][1]) if n else 0 for n, m in members.items()}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += own[n]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


def cases(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a", "b", "", "日本", "long " * 9, None])
    rows = [(c, t, rng.choice(["user", "assistant", None]), text()) for c in range(40) for t in range(rng.randrange(6))]
    rows += [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]  # copies over several shards
    rows += [(500, t, "user", f"{t % 3}") for t in range(150)] + [(501, t, "user", f"{t % 3}") for t in range(140)] + [(-3, None, "x", "null turn"), (-3, 0, "x", "y")]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "bot", "tie"), (None, 0, "user", "nobody")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "f") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed, shard", [(1, 40), (2, 250_000), (3, 15)])
def test_against_brute_force(spark, seed, shard):
    rows = cases(seed)
    got = p.trie(p.turn_lists(frame(spark, rows), F.col("conv_id")), shard=shard).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == brute(lists(rows))


def test_empty_and_turnless(spark):
    assert p.trie(p.turn_lists(frame(spark, []), F.col("conv_id"))).count() == 0
    bare = p.turn_lists(frame(spark, [(c, 0, "user", "x") for c in range(9000)]), F.col("conv_id")).select("conv_id", F.slice("turns", 1, 0).alias("turns"))
    got = p.trie(bare, shard=1000).collect()
    ends = hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(0, 0, None, 9000, 0, 1, 0, ends)]


def test_order_and_starts_of_long_rows():
    """Several matrices side by side give the order and the starts of whole rows."""
    rng = np.random.default_rng(4)
    rows = [rng.integers(1, 3, rng.integers(0, 6)).tolist() for _ in range(60)]
    rows += [[1] * 100 + rng.integers(1, 3, rng.integers(0, 99)).tolist() for _ in range(30)]
    ids, lengths = np.array(sum(rows, [])), np.array(list(map(len, rows)))
    begins, last = np.cumsum(lengths) - lengths, rng.permutation(len(rows))
    order = p.row_order(ids, begins, lengths, last)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], last[i]))
    found = set()
    for first, at, mask in p.node_starts(ids, begins[order], lengths[order]):
        found |= {(int(at[i]), first + int(k)) for i, k in zip(*np.nonzero(mask)) if first + k < lengths[order][at[i]]}
    want = {(j, d) for j, i in enumerate(order) for d in range(len(rows[i])) if j == 0 or rows[order[j - 1]][: d + 1] != rows[i][: d + 1]}
    assert found == want
