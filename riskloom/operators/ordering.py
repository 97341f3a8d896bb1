"""Places in an order, and answers over ranges of it, without one task per group.

An order is a range partitioning with sorted partitions, written once. A row's place is its
partition and its number inside it: nothing is counted across partitions to compare two
places, and a group of any size lies in as many partitions as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.staging import stage

_PLACE = 33  # bits of a row's number inside its partition
_BITS = 6  # 64 rows, or blocks of rows, make a block
_PIECE_ROWS = 1_000_000  # rows of an order's piece that one task answers in memory
_NONE = np.iinfo(np.int64).max


def in_order(df: DataFrame, order: list[Column | str], place: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """``df``, written in this order, with a long ``place`` that rises with it: the number of
    the partition above 33 bits for the row's number in it. ``order`` has to tell rows apart
    as far as their places matter; equal rows split over partitions like others."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    return stage(placed.select(*(keep or df.columns), place), name)


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the place, from 1, of every row in its group.

    A group's rows before a partition are the sum of its counts in the partitions before:
    a row for each partition that the group reaches. No task sees a whole group."""
    placed = in_order(df, [*keys, *order], "_at", "ranked")
    part = F.shiftright("_at", _PLACE)
    counts = placed.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return placed.join(before, [*same, part == F.col("_part")]).select(*df.columns, (F.col("_at") + F.col("_add")).alias(rank))


def _two_least(numbers: Column) -> Column:
    """The least and second least of the different numbers of an array, at most two."""
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(numbers))), 1, 2)


def _blocks(places: DataFrame, levels: int, inside: int, parts: int) -> DataFrame:
    """Level, block, and the entries of every block: two numbers, the least and the second
    least or nulls, for each child in order. Children are places at the first level, blocks
    of the level below at the others. There are no gaps between them: ``inside`` levels number
    the rows of a partition, the others the ``parts`` partitions, empty ones too."""
    def grouped(df: DataFrame) -> DataFrame:
        child = F.struct(F.col("at").bitwiseAND((1 << _BITS) - 1).cast("int").alias("child"), "one", "two")
        return df.groupBy(F.shiftright("at", _BITS).alias("block")).agg(F.array_sort(F.collect_list(child)).alias("c")).select(
            "block", F.flatten(F.transform("c", lambda e: F.array(e["one"], e["two"]))).alias("entries"))

    out, level = None, grouped(places.select("at", F.col("number").alias("one"), F.lit(None).cast("bigint").alias("two")))
    for n in range(1, levels + 1):
        # The first levels hold nearly all rows; what follows starts from a written one.
        level = stage(level, "minima") if n <= 2 else level
        one = level.select(F.lit(n).alias("level"), "block", "entries")
        out = one if out is None else out.unionByName(one)
        level = level.select(F.col("block").alias("at"), _two_least(F.col("entries")).alias("least")).select(
            "at", F.get("least", F.lit(0)).alias("one"), F.get("least", F.lit(1)).alias("two"))
        if n == inside:
            level = places.sparkSession.range(parts).withColumnRenamed("id", "at").join(level, "at", "left")
        level = grouped(level)
    return out


def two_least_in_ranges(places: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """For every range (``keys``, ``lo``, ``hi``) of places the least two of the different
    numbers at places lo to hi - 1, in the array ``least``; ranges without a row are left out.

    ``places`` are a written order's (``at``, ``number``); places without a number only bound
    ranges. Minima of blocks of rows, of blocks of blocks and so on answer a range from at
    most two blocks a level, so the work does not depend on how many rows a range holds."""
    # Places keep a partition's number above so many bits as its largest row number has.
    low = (1 << _PLACE) - 1
    top = places.agg(F.max(F.col("at").bitwiseAND(low)).alias("n"), F.max(F.shiftright("at", _PLACE)).alias("p")).first()
    # A range may end behind the last place of a partition.
    inside = max(-(-((top["n"] or 0) + 1).bit_length() // _BITS), 1)
    width, parts = inside * _BITS, (top["p"] or 0) + 1
    levels = inside + -(-(parts - 1).bit_length() // _BITS)
    narrow = lambda c: F.shiftleft(F.shiftright(c, _PLACE), width).bitwiseOR(F.col(c).bitwiseAND(low))
    end, pieces = 1 << _BITS, []
    at = lambda place: place.bitwiseAND(end - 1).cast("int")
    for n in range(1, levels + 1):
        # The whole blocks between the two of the level below: lo >> 6 and one more, level by
        # level, and hi >> 6, both in one step. Once nothing is left, lo stays above hi.
        below, skipped = _BITS * (n - 1), sum(1 << _BITS * k for k in range(1, n))
        lo, hi = F.shiftright(F.col("_lo") + skipped, below), F.shiftright("_hi", below)
        a, b = F.shiftright(lo, _BITS), F.shiftright(hi, _BITS)
        piece = lambda block, start, stop, n=n: F.struct(
            F.lit(n).alias("level"), block.alias("block"), start.alias("start"), stop.alias("stop"))
        pieces += [F.when((a == b) & (lo < hi), piece(a, at(lo), at(hi))), F.when(a < b, piece(a, at(lo), F.lit(end))),
                   F.when((a < b) & (at(hi) > 0), piece(b, F.lit(0), at(hi)))]
    asked = ranges.withColumns({"_lo": narrow("lo"), "_hi": narrow("hi")}).select(*keys, F.explode(F.array_compact(F.array(*pieces))).alias("piece")).select(*keys, "piece.*")
    blocks = _blocks(places.select(narrow("at").alias("at"), "number"), levels, inside, parts)
    found = asked.join(blocks, ["level", "block"]).select(
        *keys, _two_least(F.slice("entries", F.col("start") * 2 + 1, (F.col("stop") - F.col("start")) * 2)).alias("least"))
    return found.groupBy(*keys).agg(_two_least(F.flatten(F.collect_list("least"))).alias("least")).filter(F.size("least") > 0)


def _merged(a: tuple, b: tuple) -> tuple:
    """The least two different numbers of two such pairs of arrays."""
    least, most = np.minimum(a[0], b[0]), np.maximum(a[0], b[0])
    return least, np.minimum(np.where(most > least, most, _NONE), np.minimum(a[1], b[1]))


def _span_minima(numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least two different numbers at lo to hi - 1 of every range: two spans of the largest
    power of two that fits, one from each end. Only the minima of one length are held."""
    one, two = np.full(len(lo), _NONE), np.full(len(lo), _NONE)
    level = np.frexp(np.maximum(hi - lo, 1).astype(np.float64))[1] - 1
    level[hi <= lo] = -1
    spans = numbers, np.full(len(numbers), _NONE)
    for n in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == n)
        a, b = lo[at], hi[at] - (1 << n)
        one[at], two[at] = _merged((spans[0][a], spans[1][a]), (spans[0][b], spans[1][b]))
        step = 1 << n
        spans = _merged(tuple(s[:-step] for s in spans), tuple(s[step:] for s in spans))
    return one, two


def _nested_pairs(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the opening and closing marks that belong together; ranges nest, so on every
    depth they alternate."""
    depth = np.cumsum(np.where(opens, 1, -1)) + ~opens
    by_depth = np.argsort(depth, kind="stable")
    first, second = by_depth[:-1], by_depth[1:]
    pair = (depth[first] == depth[second]) & opens[first] & ~opens[second]
    return first[pair], second[pair]


_WHOLE, _OPEN, _CLOSE, _ALL = range(4)


def two_least_between_marks(df: DataFrame, keys: list[str], kind: str, number: str, rows: int) -> DataFrame:
    """For every pair of marks the least two of the different numbers of the rows between them,
    in the array ``least``; pairs without a row between them are left out.

    Rows of ``df`` are ordered by the two ``keys`` (a group, and a binary key), kind and number.
    A pair's first mark has kind 0, the second one kind 2 and the key of the first with one byte
    more; pairs lie beside or in one another. Other rows have kind 1 and a ``number``. A mark's
    group and key are given once. ``rows`` is how many rows there are, about: a task holds the
    numbers and marks of a piece of some million rows."""
    group, key = keys
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // _PIECE_ROWS + 1)
    order = [group, key, kind, number]
    mark = F.col(kind) != 1
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("piece"), F.col(kind).cast("tinyint").alias("kind"), F.col(number).cast("bigint").alias("no"),
        F.when(mark, F.col(group)).alias("g"), F.when(mark, F.col(key)).alias("k"))
    answer = f"piece int, what int, g {df.schema[group].dataType.simpleString()}, k binary, one bigint, two bigint"

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, kinds, marks, piece = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind_of = batch["kind"].to_numpy(zero_copy_only=False)
            piece = batch["piece"][0].as_py()
            kinds.append(kind_of)
            numbers.append(batch["no"].filter(pa.array(kind_of == 1)).to_numpy(zero_copy_only=False))
            marks.append(batch.select(["g", "k"]).filter(pa.array(kind_of != 1)))
        if not kinds:
            return
        kinds, numbers, table = np.concatenate(kinds), np.concatenate(numbers).astype(np.int64), pa.Table.from_batches(marks)
        is_mark = kinds != 1
        at = np.cumsum(~is_mark)[is_mark]  # numbers before each mark
        opens = kinds[is_mark] == 0
        first, second = _nested_pairs(opens)
        alone = np.ones(len(opens), dtype=bool)
        alone[first] = alone[second] = False
        begun, ended = np.flatnonzero(alone & opens), np.flatnonzero(alone & ~opens)
        end = len(numbers)
        row = np.concatenate([first, begun, ended])
        lo = np.concatenate([at[first], at[begun], np.zeros(len(ended), dtype=np.int64), [0]])
        hi = np.concatenate([at[second], np.full(len(begun), end), at[ended], [end]])
        what = np.repeat([_WHOLE, _OPEN, _CLOSE, _ALL], [len(first), len(begun), len(ended), 1])
        one, two = _span_minima(numbers, lo, hi)
        # Whole ranges without a row have no answer; ends are kept, to find each other.
        keep = (what != _WHOLE) | (one != _NONE)
        taken = pa.array(np.append(row, 0), mask=what == _ALL)
        table = table.take(taken)
        for start in range(0, len(what), 100_000):
            s = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(what[s]), piece, dtype=np.int32)), pa.array(what[s].astype(np.int32)),
                *[table[c].slice(start, 100_000).combine_chunks() for c in ("g", "k")],
                pa.array(one[s], mask=one[s] == _NONE), pa.array(two[s], mask=two[s] == _NONE),
            ], names=["piece", "what", "g", "k", "one", "two"]).filter(pa.array(keep[s]))

    found = stage(placed.mapInArrow(answers, answer), "ranges")
    kept = lambda what: found.filter(F.col("what") == what)
    # Ranges over several pieces: at each border at most one for every beginning of a key.
    least = F.array("one", "two")
    close = kept(_CLOSE).select("g", F.expr("substring(k, 1, length(k) - 1)").alias("k"), F.col("piece").alias("last"), least.alias("right"))
    over = kept(_OPEN).select("g", "k", "piece", least.alias("left")).join(close, ["g", "k"])
    between = over.filter(F.col("last") > F.col("piece") + 1) \
        .select("g", "k", F.explode(F.sequence(F.col("piece") + 1, F.col("last") - 1)).alias("piece")) \
        .join(kept(_ALL).select("piece", least.alias("least")), "piece").select("g", "k", "least")
    ends = over.select("g", "k", F.explode(F.array("left", "right")).alias("least"))
    across = ends.unionByName(between).groupBy("g", "k").agg(_two_least(F.flatten(F.collect_list("least"))).alias("least"))
    whole = kept(_WHOLE).select("g", "k", F.array_compact(least).alias("least"))
    return whole.unionByName(across.filter(F.size("least") > 0)).withColumnsRenamed({"g": group, "k": key})
