"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component that makes all of them equally long, sqrt(M^2 - |x|^2) with M
the largest norm; a query, scaled to length M, gets 0 there. Its nearest vectors by distance
are then those with the largest inner product, and clusters, graph and pruning can use
distances. Results are inner products of the original vectors in double precision.

* Fit: at most ``sample`` vectors (smallest hashes of their ids) are split by k-means again
  and again until no cluster holds more than a list's share, so lists come out even.
* Index: every vector goes to the list of its nearest centroid, and if it lies near a
  boundary to up to ``copies`` lists in all: those whose centroid is at most ``1 + spread``
  times as far.
* Search: a graph of near centroids, held in memory, is walked from a few entries; of the
  centroids found, those at most ``1 + ratio`` times as far as the nearest are kept, and as
  many more as it takes to hold ``k`` others. The lists are scanned exactly.
* The ratio is the smallest that finds a share of ``recall`` of the neighbours that brute
  force finds within the sample. Neighbours in all vectors are nearer than those in a
  sample, so recall on the whole is no lower but for chance; ``tests/llm`` measures it.

Defined cases: vectors that are null, zero, of another length than most of the sample, or
hold null or non-finite components take no part; of rows that repeat a vec_id the one with
the largest components, compared in order, counts; ties go to the smaller vec_id; fewer candidates than ``k`` are all given;
an empty table gives no rows; other columns are not read.

Scale: centroids (at most ``lists``) and their graph are the only things broadcast. Lists
that lie near each other are scanned in one shard of about ``block`` vectors, and a hot list,
say of equal vectors, is cut into parts by a hash of the id; a shard or part hands on its
``k`` best for a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

STEP = 8


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))


def _split(x: np.ndarray, rows: np.ndarray, most: int, rng) -> list[np.ndarray]:
    """Centroids of parts of at most ``most`` rows (more, if rows are equal)."""
    if len(rows) <= most:
        return [x[rows].mean(0)]
    k = int(min(8, -(-len(rows) // most)))
    c = x[rng.choice(rows, k, replace=False)]
    for _ in range(8):
        near = _distances(x[rows], c).argmin(1)
        c = np.stack([x[rows[near == j]].mean(0) if (near == j).any() else c[j] for j in range(k)])
    near = _distances(x[rows], c).argmin(1)
    parts = [rows[near == j] for j in range(k) if (near == j).any()]
    if len(parts) == 1:
        return [x[rows].mean(0)]
    return [m for p in parts for m in _split(x, p, most, rng)]


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float
    ratio: float = 0.0
    width: int = 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def aim(self, q: np.ndarray) -> np.ndarray:
        y = q * (self.norm / np.linalg.norm(q, axis=1))[:, None]
        return np.hstack([y, np.zeros((len(y), 1))])

    def lists_of(self, x: np.ndarray, copies: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every copy of the vectors."""
        y = self.lift(x)
        d = _distances(y, self.centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, :copies]
        dn = np.take_along_axis(d, near, 1)
        row, col = np.nonzero(dn <= (1 + spread) * dn[:, :1])
        return row, near[row, col]

    def calibrate(self, x: np.ndarray, k: int, copies: int, spread: float, recall: float) -> None:
        """Sets ratio and width by up to 200 of the vectors as queries against all of them."""
        asked = np.unique(np.linspace(0, len(x) - 1, min(len(x), 200)).astype(np.int64))
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        row, at = self.lists_of(x, copies, spread)
        member = np.zeros((len(x), len(self.centroids)), bool)
        member[row, at] = True
        d = _distances(self.aim(x[asked]), self.centroids)
        found = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, found, 1)
        for self.ratio in np.arange(0.02, 2.0, 0.01).tolist():
            keep = d <= (1 + self.ratio) * d[:, :1]
            opened = np.zeros((len(asked), len(self.centroids)), bool)
            r, c = np.nonzero(keep)
            opened[r, found[r, c]] = True
            if np.mean([(member[n] & o).any(1).mean() for n, o in zip(near, opened)]) >= recall:
                break
        self.width = int(min(len(self.centroids), 32 + 1.5 * keep.sum(1).max()))

    def walk(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For every query, up to ``width`` centroids found in the graph, nearest first, and
        their distances (infinite where there are fewer)."""
        y = self.aim(q)
        n, m = len(y), len(self.centroids)
        every = np.arange(n)[:, None]
        seen = np.zeros((n, m), bool)
        at = np.tile(self.entries, (n, 1))
        seen[every, at] = True
        far = lambda at: np.linalg.norm(self.centroids[at] - y[:, None], axis=2)
        d, open_ = far(at), np.ones(at.shape, bool)
        rows = np.arange(n)
        while open_.any():
            # The nearest few that are open, then one new order of all.
            ahead = np.where(open_, d, np.inf)
            picks = np.argpartition(ahead, min(STEP, d.shape[1]) - 1, axis=1)[:, :STEP]
            more, new_ones = [], []
            for pick in picks.T:
                live = open_[rows, pick]
                open_[rows, pick] = False
                new = self.graph[at[rows, pick]]
                new_ones.append(~seen[every, new] & live[:, None])
                seen[every, new] |= live[:, None]
                more.append(new)
            new, fresh = np.hstack(more), np.hstack(new_ones)
            dn = np.where(fresh, far(new), np.inf)
            at, d, open_ = np.hstack([at, new]), np.hstack([d, dn]), np.hstack([open_, fresh])
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            at, d, open_ = (np.take_along_axis(a, order, 1) for a in (at, d, open_))
        return at, d


def fit(x: np.ndarray, norm: float, lists: int) -> Index:
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), norm)
    y, rng = index.lift(x), np.random.default_rng(5)
    c = np.stack(_split(y, np.arange(len(y)), max(1, -(-len(y) // lists)), rng))
    near = np.argsort(_distances(c, c), axis=1, kind="stable")
    # Near neighbours lead the walk on, a few far ones keep the graph in one piece.
    links = min(len(c), 25)
    far = rng.integers(0, len(c), (len(c), 4))
    far[:, 0] = (np.arange(len(c)) + 1) % len(c)
    graph = np.hstack([near[:, :links], far])
    for row, own in zip(graph, range(len(c))):  # a node named twice would be scanned twice
        _, once = np.unique(row, return_index=True)
        row[np.setdiff1d(np.arange(len(row)), once)] = own
    index.centroids, index.graph = c, graph
    index.entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 8)).astype(np.int64))
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, per_list: int = 400, lists: int = 2048, sample: int = 20_000,
           copies: int = 3, spread: float = 0.02, recall: float = 0.97, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every query (vec_id, embedding)
    among all vectors but those with the query's own id."""
    # One row for each id; equal rows and different ones come down to the same choice.
    one = lambda df: usable(df).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    every, asked = written(one(vectors), "vectors"), one(queries)
    drawn = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not drawn.num_rows:
        return vectors.sparkSession.createDataFrame([], out)
    dims = np.bincount([len(v) for v in drawn["embedding"]]).argmax().item()
    every, asked = every.filter(F.size("embedding") == dims), asked.filter(F.size("embedding") == dims)
    drawn = drawn.filter(pa.array([len(v) == dims for v in drawn["embedding"]]))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    n, norm = every.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    drawn = _matrix(drawn["embedding"])
    index = fit(drawn, norm, int(min(max(n // per_list, 1), lists)))
    index.calibrate(drawn, k, copies, spread, recall)
    held = vectors.sparkSession.sparkContext.broadcast(index)

    def post(batches):
        for batch in batches:
            row, at = held.value.lists_of(_matrix(batch["embedding"]), copies, spread)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch["vec_id"].take(row), batch["embedding"].take(row)], ["list", "vec_id", "embedding"])

    postings = written(every.mapInArrow(post, "list int, vec_id long, embedding array<double>"), "postings")
    counted = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counted.get(i, 0) for i in range(len(index.centroids))])
    # Lists that follow each other stem from one split and lie near each other: a shard holds
    # as many as fill a block, and a list above that is cut into parts.
    shard_of = (np.cumsum(sizes) - sizes) // block
    parts_of = np.maximum(-(-sizes // block), 1)
    width = index.width

    def probe(batches):
        for batch in batches:
            at, d = held.value.walk(_matrix(batch["embedding"]), max(width, min(len(sizes), 64)))
            keep = d <= (1 + held.value.ratio) * d[:, :1]
            # Copies of a vector may stand in several lists: enough of them for k others.
            before = np.cumsum(np.where(np.isfinite(d), sizes[at], 0), axis=1) - sizes[at]
            keep |= before < copies * (k + 1)
            row, col = np.nonzero(keep & np.isfinite(d))
            lists_ = at[row, col]
            times = parts_of[lists_]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, lists_ = np.repeat(row, times), np.repeat(lists_, times)
            order = np.lexsort((lists_, part, shard_of[lists_], row))
            row, part, lists_ = row[order], part[order], lists_[order]
            shard = shard_of[lists_]
            new = np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])][: len(row)]
            cut = np.flatnonzero(new)
            which = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(row)].astype(np.int32)), pa.array(lists_.astype(np.int32)))
            row = pa.array(row[cut])
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[cut].astype(np.int32)), pa.array(part[cut].astype(np.int32)), batch["vec_id"].take(row), batch["embedding"].take(row), which],
                ["shard", "part", "query_id", "query", "lists"])

    probes = asked.mapInArrow(probe, "shard int, part int, query_id long, query array<double>, lists array<int>")
    look = lambda a: F.element_at(F.lit(a.tolist()), F.col("list") + 1)
    placed = postings.withColumns({"shard": look(shard_of).cast("int"), "part": F.pmod(F.xxhash64("vec_id"), look(parts_of)).cast("int")})

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of every query among the vectors of its lists in one shard or part."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, at, x = left["vec_id"].to_numpy(), left["list"].to_numpy(), _matrix(left["embedding"])
            order = np.argsort(ids, kind="stable")
            ids, at, x = ids[order], at[order], x[order]
            low = at.min()
            asked_ids, q, lists_ = right["query_id"].to_numpy(), _matrix(right["query"]), right["lists"].to_pylist()
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ x.T
                opened = np.zeros((len(s), at.max() - low + 1), bool)
                for j, own in enumerate(lists_[i : i + 256]):
                    own = np.array(own) - low
                    opened[j, own[(own >= 0) & (own < opened.shape[1])]] = True
                s[~opened[:, at - low] | (asked_ids[i : i + 256][:, None] == ids)] = -np.inf
                # A vector may stand here in several lists: enough for k different ones.
                most = copies * k
                least = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most] if s.shape[1] > most else np.full((len(s), 1), -np.inf)
                row, col = np.nonzero((s >= least) & (s > -np.inf))
                order = np.lexsort((col, -s[row, col], row))  # columns stand in order of ids
                row, col = row[order], col[order]
                _, once = np.unique(row.astype(np.int64) * len(ids) + np.searchsorted(ids, ids[col]), return_index=True)
                once.sort()
                row, col = row[once], col[once]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[nth < k], col[nth < k]
                found.append((asked_ids[i + row], ids[col], s[row, col]))
        query, vec, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    near = placed.groupBy("shard", "part").cogroup(probes.groupBy("shard", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
