"""Quality classifier: random-indexing word vectors, a two-layer network, temperature.

Random indexing: every token owns a sparse random index vector, fixed by its hash; its word
vector is that plus the index vectors of its neighbours in the sample, so tokens used alike
come out alike. Tokens are what white space separates; one that is rare in the sample stands
for its shape (letters, digits and signs, runs collapsed). A document is
the mean of its tokens' vectors with its logarithmic length and share of different tokens. A
network with one hidden layer is trained on these by Adam in numpy; a temperature, fitted on
rows held back from training, calibrates its probabilities.

Fitting reads at most ``sample`` labelled documents (those with the smallest hashes of their
ids); scoring reads all whole texts where they are, without a shuffle.

Defined cases: null and empty texts have no tokens, a zero mean vector and a score like any
other document; repeated rows are scored each; a doc_id with contradicting labels counts as
the smaller label; labels that are null are not used; without any label, or with one class
only, every score is that class's share (0.5 without labels); extra columns are kept unless
they carry the name of a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import remainder

DIM = 48
NONZERO = 4
WINDOW = 2
RARE = 3
_CODES = {c: "a" for c in map(chr, range(97, 123))} | {c: "A" for c in map(chr, range(65, 91))} | {str(d): "0" for d in range(10)}
_SHAPES = str.maketrans(_CODES)
_OTHER = re.compile(r"[^\x00-\x7f]+")
_RUNS = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """``heiße12***`` becomes ``<a0*>``: one sign for each run of a kind of characters."""
    if not token.isascii():
        token = _OTHER.sub(lambda m: "A" if m[0].isupper() else "a", token)
    return "<" + _RUNS.sub(r"\1", token.translate(_SHAPES)) + ">"


def index_vector(token: str, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of a token's index vector."""
    h = xxhash.xxh3_128_intdigest(token)
    return np.array([(h >> (16 * i)) % dim for i in range(NONZERO)]), np.array([1.0 - 2 * ((h >> (64 + i)) & 1) for i in range(NONZERO)])


@dataclass
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    prior: float

    def features(self, text: str | None) -> np.ndarray:
        counts = Counter((text or "").split())
        total = sum(counts.values())
        out = np.zeros(self.vectors.shape[1] + 2)
        if total:
            ids = np.fromiter((self.place(t) for t in counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.float64, len(counts))
            out[:-2] = n @ self.vectors[ids] / total
            out[-1] = len(counts) / total
        out[-2] = math.log1p(total)
        return out

    def place(self, token: str) -> int:
        """Row of a token's vector: its own, its shape's, or that of no known shape."""
        at = self.vocabulary.get(token)
        if at is None:
            at = self.vocabulary.get(token.lower())
            if at is None or token[0].isupper() and token[1:].isupper():
                at = self.vocabulary.get(shape(token), 0)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        z = _logits(self.layers, (x - self.center) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logits(layers, x):
    w1, b1, w2, b2 = layers
    return (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 7) -> tuple:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            xb, yb = x[order[i : i + 128]], y[order[i : i + 128]]
            h = np.tanh(xb @ p[0] + p[1])
            d = ((1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))))[:, 0] - yb)[:, None] / len(xb)
            dh = (d @ p[2].T) * (1 - h * h)
            grads = [xb.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy."""
    grid = np.exp(np.linspace(math.log(0.25), math.log(8), 60))
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t))
    return float(min(grid, key=loss)) if len(z) else 1.0


def word_vectors(texts: list[str], dim: int = DIM) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary (row 0: no known shape) and vectors by random indexing over the texts."""
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(t.split())
    name = lambda w: w if seen[w] >= RARE else shape(w)
    vocabulary: dict[str, int] = {"": 0}
    ids = [np.array([vocabulary.setdefault(name(w), len(vocabulary)) for w in t.split()], dtype=np.int64) for t in texts]
    rows = [index_vector(w, dim) for w in vocabulary]
    places, signs = np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])
    flat = np.zeros(len(vocabulary) * dim)
    for one in ids:
        for step in range(1, WINDOW + 1):
            for a, b in ((one[:-step], one[step:]), (one[step:], one[:-step])):
                np.add.at(flat, (a[:, None] * dim + places[b]).ravel(), signs[b].ravel())
    context = flat.reshape(-1, dim)
    own = np.zeros_like(context)
    np.add.at(own, (np.arange(len(own))[:, None], places), signs)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = context / np.maximum(size, 1e-9) + own / math.sqrt(NONZERO)
    vectors[0] = 0
    return vocabulary, vectors.astype(np.float32)


def fit(labelled: list[tuple[str | None, int]], *, hidden: int = 24, epochs: int = 40) -> Model:
    """A model of (text, 0 or 1) rows; every fifth row is held back for the temperature."""
    y = np.array([int(q) for _, q in labelled], dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    vocabulary, vectors = word_vectors([t or "" for t, _ in labelled])
    model = Model(vocabulary, vectors, np.zeros(DIM + 2), np.ones(DIM + 2), (), 1.0, prior)
    if len(y) < 10 or prior in (0.0, 1.0):
        return model
    x = np.stack([model.features(t) for t, _ in labelled])
    held = np.arange(len(y)) % 5 == 4
    model.center, model.scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    x = (x - model.center) / model.scale
    model.layers = _train(x[~held], y[~held], hidden, epochs)
    model.temperature = _temperature(_logits(model.layers, x[held]), y[held])
    return model


def fit_labels(documents: DataFrame, labels: DataFrame, *, sample: int = 3000, folds: int = 5, held_fold: int = 0) -> Model:
    """Fits on the rows whose crc32(doc_id) mod ``folds`` is not ``held_fold``: at most
    ``sample`` ids by hash, whose texts alone come to the driver."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(remainder("doc_id", folds) != held_fold)
    ids = known.groupBy("doc_id").agg(F.min("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    quality = {r["doc_id"]: r["q"] for r in ids}
    if not quality:
        return fit([])
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isin(list(quality)))
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], quality[r["doc_id"]]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def score(documents: DataFrame, model: Model, *, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """The rows of ``documents`` with score (likelihood of label 1) and predicted, with or
    without their texts."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*[c for c in documents.columns if c.lower() not in ("score", "predicted")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for f in frames:
            s = m.scores(np.stack([m.features(t) for t in f["text"]])) if len(f) else np.zeros(0)
            out = f if keep_text else f.drop(columns="text")
            yield out.assign(score=s, predicted=(s >= threshold).astype(np.int32))

    schema = T.StructType([*(x for x in kept.schema.fields if keep_text or x.name != "text"),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInPandas(run, schema)
