"""Commit counts kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.history import days_before
from riskloom.settings import Settings
from riskloom.sources.staging import stage
from riskloom.sources.keyed import KeyedTable


def daily_churn(commits: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Commits per file and day from a stream of (repo_id, path, ts).

    Days are tumbling: a commit updates one state row, where 90-day windows sliding by
    a day would update ninety. The sum over days is taken when the counts are read.
    """
    day = F.window("ts", "1 day")
    return (
        commits.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(day.alias("day"), "repo_id", "path")
        .agg(F.count("*").alias("commits"))
        .select("repo_id", "path", F.col("day.start").alias("day"), "commits")
    )


_DAYS = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("path", T.StringType()),
                      T.StructField("day", T.TimestampType()), T.StructField("commits", T.LongType())])
_KEY = ("repo_id", "path")


def _added(held: DataFrame, rows: DataFrame) -> DataFrame:
    return held.unionByName(rows).groupBy("repo_id", "path", "day").agg(F.sum("commits").alias("commits"))


def count_stream(commits: DataFrame, out: str, checkpoint: str, parts: int = 64, **trigger) -> StreamingQuery:
    """Counts per file and day, kept up to date from a stream of (repo_id, path, ts).

    Nothing waits for a watermark, so open days and events of any lateness count. The counts
    are a keyed table: a row per file and day however many batches there were, of which a
    batch rewrites the parts of its files. :func:`day_counts` reads it.
    """
    days = commits.select("repo_id", "path", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = stage(batch.groupBy("repo_id", "path", "day").agg(F.count("*").alias("commits")), "days")
        KeyedTable(batch.sparkSession, out, _DAYS, _KEY, parts).update(counts, batch_id, _added)

    return (
        days.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def day_counts(spark: SparkSession, out: str, parts: int = 64) -> DataFrame:
    """Commits per file and day over all batches so far."""
    return KeyedTable(spark, out, _DAYS, _KEY, parts).read()


def sliding_commits(daily: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Commits of the last ``recent_days`` days, that day included, on every day: a row for
    each span of days, from ``day`` and before ``until``, in which a file's sum is the same.
    The last span of a file has sum 0 and no end.

    A day's commits come in on that day and go out ``recent_days`` later; both are events of
    one table, and the running sum over a file's events is the window's sum on every day. A
    file brings two rows for each of its days, not one for each day of the window.
    """
    out = F.col("day") + F.make_dt_interval(F.lit(settings.recent_days))
    events = daily.select("repo_id", "path", F.explode(F.array(
        F.struct(F.col("day").alias("day"), F.col("commits").alias("n")),
        F.struct(out.alias("day"), (-F.col("commits")).alias("n")))).alias("event"))
    steps = events.groupBy("repo_id", "path", "event.day").agg(F.sum("event.n").alias("n"))
    file = Window.partitionBy("repo_id", "path").orderBy("day")
    return steps.select(
        "repo_id", "path", "day", F.lead("day").over(file).alias("until"),
        F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, 0)).alias("commits_last_90d"))


def on_days(spans: DataFrame) -> DataFrame:
    """A row per file and day of :func:`sliding_commits` with a count above 0."""
    last = F.col("until") - F.expr("INTERVAL 1 DAY")
    return spans.filter("until is not null and commits_last_90d > 0").select(
        "repo_id", "path", F.explode(F.sequence(F.col("day"), last, F.expr("INTERVAL 1 DAY"))).alias("day"), "commits_last_90d")


def recent_commits(daily: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Commits per file over the recent whole days before ``as_of``."""
    return (
        daily.filter(F.col("day") >= days_before(as_of, settings.recent_days))
        .groupBy("repo_id", "path").agg(F.sum("commits").alias("commits_last_90d"))
    )
