"""Commit rollups per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scores, texts
from riskloom.operators.skew import top_k
from riskloom.settings import Settings

CHANGE = ("date", "message", "author", "sha", "pr_number", "had_incident")


def instant(as_of: str) -> Column:
    """The moment a run counts from, e.g. ``2001-08-02`` or ``2001-08-02 10:00:00``."""
    return F.to_timestamp_ltz(F.lit(str(as_of)))


def days_before(as_of: str, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def file_history(commits: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Commit count, recent commits, distinct authors and churn score of each file.

    One scan and one grouping for all files; authors are deduplicated by Spark's
    two-step distinct, so a file with very many commits is reduced before it is merged.
    """
    recent = F.col("ts").cast("timestamp") > days_before(as_of, settings.recent_days)
    return (
        commits.groupBy("repo_id", "path")
        .agg(
            F.count("*").alias("commit_count"),
            F.count_if(recent).alias("commits_last_90d"),
            F.countDistinct("author").alias("unique_authors"),
        )
        .withColumn("churn_score", scores.churn_score(F.col("commits_last_90d")))
    )


def recent_changes(commits: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """The newest changes of each file inside the look-back window, ranked from 1."""
    ts, message = F.col("ts").cast("timestamp"), F.col("message")
    in_window = commits.filter(ts > days_before(as_of, settings.lookback_days))
    newest = top_k(
        in_window.select("repo_id", "path", "sha", "author", "ts", "message"),
        ["repo_id", "path"], [F.col("ts").desc(), F.col("sha")], settings.recent_changes,
        spread_on=["sha"],
    )
    return newest.select(
        "repo_id", "path", "rank", ts.alias("date"),
        texts.first_line(message).alias("message"), "author",
        texts.short_sha(F.col("sha")).alias("sha"),
        texts.pr_number(message).alias("pr_number"),
        texts.is_bug_fix(message).alias("had_incident"),
    )


def recent_changes_list(changes: DataFrame) -> DataFrame:
    """Ranked changes as one short array per file, newest first."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.struct(*CHANGE).alias("change"))))
    return (
        changes.groupBy("repo_id", "path").agg(ordered.alias("ranked"))
        .select("repo_id", "path", F.col("ranked.change").alias("recent_changes"))
    )


def latest_changes(changes: DataFrame, n: int = 5) -> DataFrame:
    """The first few ranked changes of each file, as a detail view shows them."""
    return changes.filter(F.col("rank") <= n)
