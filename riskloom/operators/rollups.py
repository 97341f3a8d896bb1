"""Directory and module rollups, and the file tree as rows.

A file is counted once for each directory above it. Directories near the root collect
nearly all files of a repository; their rows are merged inside each task before they
are shuffled, so no task sees a directory's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths, scores
from riskloom.operators.ordering import ranked
from riskloom.settings import TIERS, Settings, check_tier

DIR = ["repo_id", "dir"]


def exploded(files: DataFrame) -> DataFrame:
    """One row per file and directory above it."""
    return files.withColumn("dir", F.explode(paths.ancestors(F.col("path"))))


def _hottest_tier(score: str, tier: str = "tier") -> Column:
    """Tier of the hottest row (the higher tier on ties); low when nothing has heat.

    Score and tier rank are packed in one number, which aggregates without sorting.
    """
    packed = F.max(F.col(score) * 8 + scores.tier_rank(F.col(tier)))
    return F.when(F.max(score) > 0, scores.tier_of_rank(F.pmod(packed, F.lit(8)))) \
        .otherwise("low")


def dir_rollup(heat: DataFrame) -> DataFrame:
    """Hottest score, file count and depth of every directory."""
    return (
        exploded(heat.select("repo_id", "path", "heat_score"))
        .groupBy(*DIR)
        .agg(F.max("heat_score").alias("max_heat"), F.count("*").alias("files"))
        .withColumn("depth", F.size(F.split("dir", "/")))
    )


def dir_tier_counts(heat: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Files of each tier below every directory, and the tier of its hottest score."""
    return (
        exploded(heat.select("repo_id", "path", "heat_score", "tier"))
        .groupBy(*DIR)
        .agg(F.max("heat_score").alias("max_heat"),
             *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
        .withColumn("tier", scores.tier_of(F.col("max_heat"), settings.tiers))
    )


def explorer_dirs(heat: DataFrame) -> DataFrame:
    """Directories as an explorer lists them: hottest file's tier and files below."""
    return (
        exploded(heat.select("repo_id", "path", "heat_score", "tier"))
        .groupBy(*DIR)
        .agg(F.max("heat_score").alias("max_heat"), _hottest_tier("heat_score").alias("tier"),
             F.count("*").alias("files"))
        .withColumn("parent", paths.directory(F.col("dir")))
    )


def module_rollup(heat: DataFrame, weight: str = "lines", under: str = "") -> DataFrame:
    """Weight, hottest score and tier of each module, hottest module first.

    With ``under`` the modules are the directories below that path.
    """
    name = paths.module(F.col("path"))
    if under:
        name = paths.directory(F.col("path"))
        heat = heat.filter(F.startswith(name, F.lit(under)) | (F.col("path") == under))
    tenths = F.sum(scores.treemap_tenths(F.col("heat_score"), F.col("lines"), weight))
    return (
        heat.withColumn("module", name)
        .groupBy("repo_id", "module")
        .agg((tenths.cast("double") / F.lit(10.0)).alias("total_weight"), F.max("heat_score").alias("max_heat"),
             _hottest_tier("heat_score").alias("tier"), F.count("*").alias("files"))
        .orderBy("repo_id", F.col("max_heat").desc(), F.col("total_weight").desc(), "module")
    )


def tree_nodes(heat: DataFrame) -> DataFrame:
    """Every file and directory of the tree: parent, name, depth, score, lines."""
    path = F.col("path")
    files = heat.select(
        "repo_id", "path", F.lit(False).alias("is_dir"), "heat_score", "tier",
        F.col("lines").cast("bigint").alias("lines"),
    )
    dirs = dir_rollup(heat).select(
        "repo_id", F.col("dir").alias("path"), F.lit(True).alias("is_dir"),
        F.col("max_heat").alias("heat_score"), F.lit(None).cast("string").alias("tier"),
        F.lit(0).cast("bigint").alias("lines"),
    )
    return files.unionByName(dirs).withColumns({
        "parent": paths.directory(path),
        "name": paths.base_name(path),
        "depth": F.size(F.split(path, "/")),
    })


def filter_tree(heat: DataFrame, tiers: list[str]) -> DataFrame:
    """The tree of the files in these tiers: empty directories go, scores follow."""
    return tree_nodes(heat.filter(F.col("tier").isin(*[check_tier(t) for t in tiers])))


def search_tree(heat: DataFrame, query: str) -> DataFrame:
    """Files and directories whose own name contains the query, in any case."""
    return tree_nodes(heat).filter(F.contains(F.lower("name"), F.lit(query.lower())))


def sort_tree(nodes: DataFrame, by: str = "heat") -> DataFrame:
    """Nodes grouped by parent, directories first, then by heat, name or size."""
    orders = {
        "heat": [F.col("heat_score").desc()],
        "name": [],
        "size": [F.col("lines").desc()],
    }
    if by not in orders:
        raise ValueError(f"sort must be one of {', '.join(orders)} (got {by!r})")
    return nodes.orderBy("repo_id", "parent", F.col("is_dir").desc(), *orders[by], "name")


def ranked_tree(nodes: DataFrame, by: str = "heat") -> DataFrame:
    """Nodes with their place among the children of their parent, in one of the orders of
    :func:`sort_tree`. A directory of any size lies in as many tasks as its children fill."""
    key = {"heat": "heat_score", "size": "lines"}.get(by)
    if key is None and by != "name":
        raise ValueError(f"sort must be heat, name or size (got {by!r})")
    order = [F.col("is_dir").desc(), *([F.col(key).desc()] if key else []), "name"]
    return ranked(nodes, ["repo_id", "parent"], order)


def explorer_listing(heat: DataFrame) -> DataFrame:
    """What an explorer lists below each directory: directories by their hottest file, then
    files by heat, each with its place and the number of files below."""
    dirs = explorer_dirs(heat).select(
        "repo_id", F.col("dir").alias("path"), F.lit(True).alias("is_dir"),
        F.col("max_heat").alias("heat_score"), "tier", "files", "parent")
    files = heat.select(
        "repo_id", "path", F.lit(False).alias("is_dir"), "heat_score", "tier",
        F.lit(1).cast("bigint").alias("files"), paths.directory(F.col("path")).alias("parent"))
    nodes = dirs.unionByName(files).withColumn("name", paths.base_name(F.col("path")))
    return ranked_tree(nodes)
