"""Lists, reports and lookups on the scored file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths, scores
from riskloom.operators.ordering import ranked
from riskloom.operators.skew import spread_join, top_k
from riskloom.schemas import IMPACTS
from riskloom.settings import TIER_RANK, TIERS, check_tier



def hottest_first() -> list[Column]:
    """Ranking order inside a repository; the path settles ties."""
    return [F.col("heat_score").desc(), F.col("path")]


def reason() -> Column:
    """The assessed summary, empty where the file was not assessed."""
    return F.when(F.col("assessed") & (F.col("summary") != ""), F.col("summary")).otherwise("")


def with_tier(heat: DataFrame, tier: str) -> DataFrame:
    return heat.filter(F.col("tier") == check_tier(tier))


def at_or_above(heat: DataFrame, tier: str) -> DataFrame:
    """Files of this tier and every hotter one."""
    lowest = TIER_RANK[check_tier(tier)]
    return heat.filter(F.col("tier").isin(*[t for t in TIERS if TIER_RANK[t] >= lowest]))


def list_files(heat: DataFrame, tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Each repository's files, hottest first, with the number listed and whether that is
    fewer than all files of the repository, whatever tier was asked for.

    Totals come from a counting aggregate that is joined back, so the ranking window
    stays limitable before its shuffle.
    """
    chosen = heat if tier is None else with_tier(heat, tier)
    rows = chosen.select("repo_id", "path", "heat_score", "tier", reason().alias("reason"))
    fits = F.lit(True) if tier is None else F.col("tier") == tier
    matching = heat.groupBy("repo_id").agg(
        F.count_if(fits).alias("matching"), F.count("*").alias("all"))
    bounded = limit is not None and limit > 0
    listed = top_k(rows, ["repo_id"], hottest_first(), limit, spread_on=["path"]).drop("rank") \
        if bounded else rows
    shown = F.least(F.lit(limit).cast("bigint"), F.col("matching")) if bounded \
        else F.col("matching")
    return (
        spread_join(listed, matching, ["repo_id"], ["path"])
        .withColumn("count", shown)
        .withColumn("truncated", F.col("all") > F.col("count"))
        .drop("matching", "all")
        .orderBy("repo_id", *hottest_first())
    )


def tier_counts(heat: DataFrame) -> DataFrame:
    """Files of each tier, zero where there is none: one row per repository."""
    return heat.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
    )


def review_hours(heat: DataFrame) -> DataFrame:
    minutes = F.sum("estimated_review_time_minutes")
    return heat.groupBy("repo_id").agg(
        minutes.alias("minutes"), (minutes.cast("double") / F.lit(60.0)).alias("hours"))


def tier_report(heat: DataFrame, limit: int = 10) -> DataFrame:
    """The hottest files of every tier and how many more the tier holds."""
    keys = ["repo_id", "tier"]
    rows = heat.select(*keys, "path", "heat_score", F.coalesce("summary", F.lit("")).alias("reason"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("tier_files"))
    if limit > 0:
        listed = top_k(rows, keys, hottest_first(), limit, spread_on=["path"]).drop("rank")
        more = F.greatest(F.lit(0).cast("bigint"), F.col("tier_files") - limit)
    else:
        listed, more = rows, F.lit(0).cast("bigint")
    return (
        spread_join(listed, totals, keys, ["path"])
        .withColumn("more", more)
        .withColumn("label", scores.tier_label(F.col("tier")))
        .orderBy("repo_id", scores.tier_rank(F.col("tier")).desc(), *hottest_first())
    )


def action_items(heat: DataFrame, n: int = 5) -> DataFrame:
    """The hottest files of each repository that a person has to review."""
    manual = heat.filter(~F.col("auto_merge")).select(
        "repo_id", "path", "heat_score", "tier", reason().alias("reason"))
    return top_k(manual, ["repo_id"], hottest_first(), n, spread_on=["path"])


def file_facts(heat: DataFrame) -> DataFrame:
    """Flat extract for BI: one row per file, small files shown with 10 lines."""
    assessed = F.col("assessed")
    return heat.select(
        "repo_id", "path",
        paths.directory(F.col("path")).alias("dir"),
        paths.base_name(F.col("path")).alias("name"),
        "heat_score", "tier",
        F.when(assessed, F.col("summary")).otherwise("").alias("reason"),
        F.when(assessed, F.col("critical_reason")).otherwise("").alias("crit_reason"),
        *[F.when(assessed, F.col(i)).otherwise(0).alias(i.removesuffix("_impact"))
          for i in IMPACTS],
        "auto_merge", F.col("min_reviewers").alias("reviewers"),
        F.greatest("lines", F.lit(10)).alias("lines"), "language",
        F.col("cyclomatic").alias("complexity"), F.col("import_count").alias("imported_by"),
    )


def ranked_facts(heat: DataFrame) -> DataFrame:
    """The BI extract with each file's place in its repository, hottest first."""
    return ranked(file_facts(heat), ["repo_id"], [F.desc("heat_score"), "path"])


def search_facts(
    facts: DataFrame, tier: str | None = None, query: str = "", under: str = ""
) -> DataFrame:
    """Facts of a tier whose path or reason contains the query, below a directory."""
    out = facts if tier is None else facts.filter(F.col("tier") == check_tier(tier))
    if query:
        needle = F.lit(query.lower())
        out = out.filter(
            F.contains(F.lower("path"), needle) | F.contains(F.lower("reason"), needle))
    if under:
        out = out.filter(F.startswith("dir", F.lit(under)) | (F.col("path") == under))
    return out


def get_file(heat: DataFrame, repo_id: str, path: str) -> DataFrame:
    """One file's row with its label, breakage impact and review verdict.

    Both filters reach the storage scan, which skips row groups by their key ranges.
    """
    return heat.filter((F.col("repo_id") == repo_id) & (F.col("path") == path)).select(
        "*", reason().alias("reason"), scores.tier_label(F.col("tier")).alias("label"),
        F.col("import_count").alias("breakage_impact"),
        (~F.col("auto_merge")).alias("needs_human_review"),
    )


def suggest_paths(heat: DataFrame, repo_id: str, fragment: str, n: int = 5) -> DataFrame:
    """Paths that contain what was asked for, in name order."""
    return (
        heat.filter((F.col("repo_id") == repo_id) & F.contains("path", F.lit(fragment)))
        .select("repo_id", "path").orderBy("path").limit(n)
    )


def breakage_impact(heat: DataFrame) -> DataFrame:
    """How many import lines break if a file changes."""
    return heat.filter(F.col("import_count") > 0).select(
        "repo_id", "path", F.col("import_count").alias("breakage_impact"))


def impact_bands(heat: DataFrame) -> DataFrame:
    """Display band of every impact dimension of the assessed files."""
    return heat.filter("assessed").select(
        "repo_id", "path",
        *[x for i in IMPACTS for x in (
            F.col(i), scores.impact_band(F.col(i)).alias(i.removesuffix("_impact") + "_band"))],
    )


def tier_bars(heat: DataFrame) -> DataFrame:
    """Bar width of every tier in percent of the largest, at least 8 when not empty."""
    counts = tier_counts(heat)
    largest = F.greatest(*[F.col(t) for t in TIERS], F.lit(1))
    per_tier = F.array(*[
        F.struct(F.lit(t).alias("tier"), F.col(t).alias("files")) for t in TIERS])
    share = F.col("files").cast("double") / F.col("largest").cast("double") * F.lit(100.0)
    return (
        counts.select("repo_id", largest.alias("largest"), F.inline(per_tier))
        .select("repo_id", "tier", "files",
                F.when(F.col("files") > 0, F.greatest(share, F.lit(8.0)))
                .otherwise(F.lit(0.0)).alias("width"))
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Of several runs of a repository the latest."""
    facts = ["repo_path", "commit_sha", "branch"]
    return runs.groupBy("repo_id").agg(F.max(F.struct("analyzed_at", *facts)).alias("r")).select(
        "repo_id", "r.repo_path", "r.analyzed_at", "r.commit_sha", "r.branch")


def dashboard_stats(heat: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals, tier counts, language counts and run facts: one row per repository."""
    languages = (
        heat.groupBy("repo_id", "language").agg(F.count("*").alias("files"))
        .groupBy("repo_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files"))))
             .alias("languages"))
    )
    return tier_counts(heat).join(languages, "repo_id").join(latest_runs(runs), "repo_id", "left")
