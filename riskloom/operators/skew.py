"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_on: list[str],
    how: str = "inner",
    fan_out: int = 64,
    grows: bool = False,
) -> DataFrame:
    """Join many rows of ``large`` to one row per key of ``small``.

    Each key of ``large`` is split over ``fan_out`` tasks by a hash of ``spread_on``;
    ``small`` (one row per key) is repeated once per split. A repository with a third of
    all rows is then joined by ``fan_out`` tasks, and adaptive execution can split those
    further. The hint builds the hash table from ``small`` and keeps a large side that
    is merely estimated to be small from being broadcast. Set ``grows`` when a joined row
    becomes many: all shuffle partitions are then kept, where adaptive execution would
    merge them by their size before the growth.
    """
    # Known not to be null, or the join would filter on it and ``large`` could not share a
    # shuffle with a ``small`` that is aggregated from it.
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_on), F.lit(fan_out)).cast("int"), F.lit(0))
    salts = F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1)))
    large = large.withColumn("_salt", salt)
    if grows:
        partitions = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        large = large.repartition(partitions, *on, "_salt")
    return (
        large.join(small.withColumn("_salt", salts).hint("shuffle_hash"), [*on, "_salt"], how)
        .drop("_salt")
    )


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread_on: list[str],
    rank: str = "rank", fan_out: int = 64,
) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    Groups are first cut to ``k`` rows in each of ``fan_out`` hashed parts, then as a whole,
    so no task sorts a whole hot group; for small ``k`` Spark also cuts the rows of every map
    task before the shuffle.
    """
    part = F.pmod(F.xxhash64(*spread_on), F.lit(fan_out)).cast("int")
    by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    df = (
        df.withColumn("_part", part)
        .withColumn(rank, F.row_number().over(by_part))
        .filter(F.col(rank) <= k)
        .drop("_part", rank)
    )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
