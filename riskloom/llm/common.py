"""What the operators share: tables written to the shared folder, hashes of bytes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.staging import shuffles_removed

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, as
    in tests on one machine, a folder of this process. A cluster without it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
    return _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, independent of executors. What
    it shuffled is not kept, so the steps of an operator do not add up on disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """``df``, written, for a join: broadcast if it has at most ``rows`` rows, else as it is,
    so that Spark shuffles both sides."""
    side = written(df, name)
    return F.broadcast(side) if side.count() <= rows else side


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them where a column is called so in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: str, by: int):
    """crc32 of a key's decimal text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing steps that spread every bit of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Buckets:
    """Entries dealt to buckets by number, to leave a task as one row of packed arrays for
    each bucket; ``limit`` entries are held at most before a flush. The column ``runs`` is
    kept as its runs of equal values, with a further column of their lengths; ``packed``
    compresses the arrays."""

    def __init__(self, n: int, names: list[str], limit: int = 1_000_000, runs: str = "", packed: bool = False):
        self.n, self.names, self.limit, self.held, self.size, self.runs = n, names, limit, [], 0, runs
        self.pack = zstandard.ZstdCompressor(level=1).compress if packed else bytes

    def add(self, bucket: np.ndarray, *arrays: np.ndarray) -> None:
        self.held.append((bucket, *arrays))
        self.size += len(bucket)

    def flush(self, least: int = 1):
        """The record batches of what is held, if that is at least ``least`` entries."""
        if self.size < least:
            return
        bucket, *arrays = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(bucket)]
        columns, names = [pa.array(bucket[cuts].astype(np.int32))], ["bucket"]
        for name, a in zip(self.names, arrays):
            parts = [a[order[i:j]] for i, j in zip(cuts, ends)]
            lengths = None
            if name == self.runs:
                heads = [np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) for p in parts]
                lengths = [np.diff(np.r_[h, len(p)]).astype(np.uint32) for h, p in zip(heads, parts)]
                parts = [p[h] for h, p in zip(heads, parts)]
            columns.append(pa.array([self.pack(p.tobytes()) for p in parts], pa.binary()))
            names.append(name)
            if lengths is not None:
                columns.append(pa.array([self.pack(x.tobytes()) for x in lengths], pa.binary()))
                names.append(f"{name}_runs")
        yield pa.RecordBatch.from_arrays(columns, names)


def unpacked(blobs, kind, packed: bool = False) -> np.ndarray:
    """The arrays of a binary column, one behind the other."""
    read = zstandard.ZstdDecompressor().decompress if packed else memoryview
    return np.concatenate([np.frombuffer(read(b.as_buffer()), kind) for b in blobs] or [np.zeros(0, kind)])


FILTER_WORDS = 1 << 17


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.uint64))
    return (h >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1), np.uint64(1) << (h & np.uint64(63))


def id_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size, 1 MB, that holds all values of a long column. It lets too much
    through when there are very many, so it only ever saves work before an exact join."""

    def local(batches):
        bits = np.zeros(FILTER_WORDS, np.uint64)
        for b in batches:
            word, bit = _slots(b[0].to_numpy(zero_copy_only=False).view(np.int64))
            np.bitwise_or.at(bits, word, bit)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["word", "bits"])

    words = df.select(column).dropna().mapInArrow(local, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    word, bit = _slots(ids)
    return (bits[word] & bit) != 0


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of every component of undirected edges (a, b) of longs.

    Labels fall to the least label of a neighbour and then jump to their label's label;
    every round is written, and rounds end when no label changes."""
    both = written(edges.filter("a <> b").select("a", "b").unionAll(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(least.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if after.filter("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
