"""Language ID by a bidirectional gated recurrent network over the bytes of a text.

Texts are read as UTF-8 in windows of ``STEPS`` bytes; a forward and a backward network run
over each window, and at every position both states give probabilities of the languages. A
document's probabilities are the means over all its positions; every byte of the whole text
counts. Context does not cross a window's edge, which makes all windows of a batch, whatever
document they belong to, run side by side in one matrix product a step.

Training is backpropagation through time in numpy, on windows drawn from a bounded sample:
``per_language`` documents of every language, ``windows`` windows of each.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every
text if no labelled document has a language; rows whose language is null are not learned
from; repeated rows are answered each; extra columns are kept unless they carry the name of
a result. Memory is bounded by a batch: windows are run ``SIDE`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import remainder

STEPS = 64
HIDDEN = 8
SIDE = 2048
PAD = 256


@dataclass
class Model:
    """For each direction: input table (3H x 257), recurrent matrix (3H x H), its bias (3H);
    for the output a matrix (L x 2H) and a bias. Gates in order: reset, update, candidate."""

    languages: list[str]
    weights: list[np.ndarray]


def _run(weights, x: np.ndarray, keep: bool):
    """States of one direction over x (steps x batch): (steps x H x batch), and what
    training needs. The gates' sigmoids are tanh of half the argument."""
    table, u, b = weights
    hid, side = u.shape[1], x.shape[1]
    h = np.zeros((hid, side), np.float32)
    states, saved = np.empty((len(x), hid, side), np.float32), []
    for t in range(len(x)):
        g = u @ h
        g += b
        i = table.take(x[t], axis=1)
        gates = i[: 2 * hid]
        gates += g[: 2 * hid]
        np.tanh(gates * np.float32(0.5), out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        r, z, own = gates[:hid], gates[hid:], g[2 * hid :]
        n = i[2 * hid :]
        n += r * own
        np.tanh(n, out=n)
        if keep:
            saved.append((h, r, z, n, own))
        h = n + z * (h - n)
        states[t] = h
    return states, saved


def _outputs(model: Model, x: np.ndarray):
    """Position probabilities (languages x steps x batch)."""
    w = model.weights
    both = np.concatenate([_run(w[0:3], x, False)[0], _run(w[3:6], x[::-1], False)[0][::-1]], axis=1)
    z = np.matmul(w[6], both) + w[7]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z.transpose(1, 0, 2)


def _back(weights, x, saved, d_states):
    """Gradients of one direction by backpropagation through time."""
    table, u, _ = weights
    hid = u.shape[1]
    d_table, d_u, d_b = np.zeros((table.shape[1], 3 * hid)), np.zeros_like(u), np.zeros((3 * hid, 1), np.float32)
    dh = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, r, z, n, own = saved[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * own * r * (1 - r)
        into = np.concatenate([dr, dz, dn])
        g = np.concatenate([dr, dz, dn * r])
        np.add.at(d_table, x[t], into.T)
        d_u += g @ h.T
        d_b += g.sum(axis=1, keepdims=True)
        dh = dh * z + u.T @ g
    return [d_table.T.astype(np.float32), d_u, d_b]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], *, epochs: int = 6, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Model:
    """``x``: windows x steps of bytes (PAD behind the end), ``y``: language number of each."""
    rng, n_out = np.random.default_rng(seed), len(languages)
    make = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    w = []
    for _ in range(2):
        w += [make(3 * HIDDEN, 257), make(3 * HIDDEN, HIDDEN), np.zeros((3 * HIDDEN, 1), np.float32)]
    w += [make(n_out, 2 * HIDDEN), np.zeros((n_out, 1), np.float32)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    steps = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]].T, y[order[i : i + batch]]
            fs, f_saved = _run(w[0:3], xb, True)
            bs, b_saved = _run(w[3:6], xb[::-1], True)
            both = np.concatenate([fs, bs[::-1]], axis=1)
            z = np.matmul(w[6], both) + w[7]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[:, yb, np.arange(len(yb))] -= 1
            p *= (xb != PAD)[:, None, :] / np.float32(max((xb != PAD).sum(), 1))
            d_both = np.matmul(w[6].T, p)
            grads = _back(w[0:3], xb, f_saved, d_both[:, :HIDDEN]) + _back(w[3:6], xb[::-1], b_saved, d_both[::-1, HIDDEN:])
            grads += [np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))[:, None]]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            lr = rate * (1 - step / (steps + 1))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def windows_of(data: bytes) -> np.ndarray:
    """The bytes in rows of STEPS, the last filled up with PAD."""
    out = np.full(-(-len(data) // STEPS) * STEPS, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, STEPS)


def fit(documents: DataFrame, *, folds: int = 4, held_fold: int = 2, per_language: int = 300, windows: int = 16) -> Model:
    """Learns from rows whose crc32(doc_id) mod ``folds`` is not ``held_fold``. The ids of
    the sample come first, without texts; then only the sample's texts."""
    known = documents.select("doc_id", "lang").dropna().filter(remainder("doc_id", folds) != held_fold).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("k", F.row_number().over(turn)).filter(F.col("k") <= per_language).collect()
    lang = {r["doc_id"]: r["lang"] for r in ids}
    languages = sorted(set(lang.values()))
    if not languages:
        return Model([], [])
    rows = documents.select("doc_id", "text").filter(F.col("doc_id").isin(list(lang))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rng, x, y = np.random.default_rng(11), [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own = windows_of((r["text"] or "").encode("utf-8", "replace"))
        if len(own):
            own = own[rng.choice(len(own), min(windows, len(own)), replace=False)]
            x.append(own)
            y += [languages.index(lang[r["doc_id"]])] * len(own)
    if not x:
        return Model([], [])
    return train(np.concatenate(x), np.array(y), languages)


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities, a row per text; zero for empty texts."""
    own = [windows_of(t) for t in texts]
    count = np.array([len(w) for w in own], dtype=np.int64)
    row = np.repeat(np.arange(len(own)), count)
    out = np.zeros((len(own), len(model.languages)))
    every = np.concatenate(own) if own else np.zeros((0, STEPS), np.int16)
    for i in range(0, len(every), SIDE):
        x = every[i : i + SIDE].T
        p = (_outputs(model, x) * (x != PAD)).sum(axis=1)
        np.add.at(out, row[i : i + SIDE], p.T)
    return out / np.maximum(np.array([len(t) for t in texts])[:, None], 1)


def identify(documents: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """The rows of ``documents`` with lang_pred and score, with or without their texts."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*[c for c in documents.columns if c.lower() not in ("lang_pred", "score")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            readable = [bool(m.languages) and isinstance(t, str) and any(map(str.isalpha, t)) for t in f["text"]]
            texts = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(f["text"], readable)]
            names, scores = ["und"] * len(f), np.zeros(len(f))
            if any(readable):
                p = probabilities(m, texts)
                best = p.argmax(axis=1)
                names = [m.languages[k] if ok else "und" for k, ok in zip(best, readable)]
                scores = np.clip(np.where(readable, p.max(axis=1), 0.0), 0, 1)
            out = f if keep_text else f.drop(columns="text")
            yield out.assign(lang_pred=names, score=scores)

    schema = T.StructType([*(x for x in kept.schema.fields if keep_text or x.name != "text"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInPandas(run, schema)
