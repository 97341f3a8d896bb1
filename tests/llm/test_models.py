import random
import zlib

import numpy as np
import pytest

from riskloom.llm import ann, language, quality


def test_quality_learns_and_handles_all_texts(spark, documents, prose):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(700):
        words = prose(i, rng.randrange(30, 200))
        good = i % 4 != 0
        if not good:
            words = [w + rng.choice(["***", "$$$", "%%%"]) for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    odd = [(9000, None), (9001, ""), (9002, " \n"), (9003, "x" * 300_000), (None, "null id"), (5, rows[5][1])]
    docs = documents(rows + odd)
    table = spark.createDataFrame(labels + [(9001, None), (None, 1), (3, 0), (8888, 1)], "doc_id long, quality int")
    model = quality.fit_labels(docs, table)
    got = quality.score(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 700 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.95
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in quality.score(docs.limit(9), quality.fit_labels(docs, table.limit(0))).collect()} == {0.5}


def test_quality_shapes_and_temperature():
    assert [quality.shape(t) for t in ("heiße12***", "AbC", "ÜBER!!", "a-1")] == ["<a0*>", "<AaA>", "<A!>", "<a-0>"]
    z = np.random.default_rng(0).normal(0, 4, 4000)
    y = (np.random.default_rng(1).random(4000) < 1 / (1 + np.exp(-z / 3))).astype(float)
    assert abs(quality._temperature(z, y) - 3) < 0.5


LETTERS = {"aa": "the quick brown fox", "bb": "ñandú qué será él", "cc": "über große straße"}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return [(i, (k := list(LETTERS)[i % 3]), " ".join(rng.choices(LETTERS[k].split(), k=rng.randrange(5, 60)))) for i in range(400)]


def test_language_by_held_out_accuracy(spark, texts):
    odd = [(900, None, "1234 !!"), (901, "aa", None), (902, None, ""), (903, None, "the " * 60_000), (None, "bb", "será él"), (4, "bb", texts[4][2])]
    df = spark.createDataFrame([(i, t, k, None) for i, k, t in texts + odd], "doc_id long, text string, lang string, score string").repartition(3)
    got = language.identify(df, language.fit(df, per_language=100)).collect()
    assert len(got) == len(texts) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and by[900]["score"] == 0
    held = [(i, k) for i, k, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by[i]["lang_pred"] == k for i, k in held]) > 0.97
    assert language.identify(df.limit(0), language.fit(df, per_language=5)).count() == 0
    nothing = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df.limit(5), nothing).collect()} == {"und"}


def test_gradients_of_the_network():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, 0.5, s).astype(np.float64) for s in ((9, 257), (9, 3), (9, 1))]
    x = rng.integers(0, 256, (5, 4))
    aim = rng.normal(size=(5, 3, 4))

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        for t in range(5):
            g, i = weights[1] @ h + weights[2], weights[0][:, x[t]]
            r, z = (1 / (1 + np.exp(-(i[k:k + 3] + g[k:k + 3]))) for k in (0, 3))
            n = np.tanh(i[6:] + r * g[6:])
            h = n + z * (h - n)
            total += (aim[t] * h).sum()
        return total

    _, saved = language._run([w.astype(np.float32) for w in weights], x, True)
    grads = language._back([w.astype(np.float32) for w in weights], x, saved, aim.astype(np.float32))
    for w, g in zip(weights, grads):
        for at in [(0, 1), (4, 2), (8, 0)] if w.shape[1] == 3 else [(0, 0), (5, 0), (8, 0)] if w.shape[1] == 1 else [(k, x[1, 0]) for k in (0, 4, 8)]:
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 2e-3


def nearest(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i in asked:
        s = x @ x[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_against_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * (rng.random((3000, 1)) * 3 + 0.1 if scale else 1)
    x[200:700] = x[200]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15 + [None]), (5004, [1.0]), (5005, []), (5006, [float("inf")] * 16), (None, [1.0] * 16), (7, rows[7][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=20, per_list=100, block=300).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = nearest(rows, range(0, 3000, 20), 20)
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, v in found.items():
        assert [s for _, s in v] == pytest.approx([float(x[i] @ x[q]) for i, _ in v], abs=1e-12) and q not in {i for i, _ in v}
    assert [i for i, _ in found[220]] == [i for i in range(200, 221) if i != 220]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20), (0, 2, 21), (20, 1, 21), (20, 2, 0)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
