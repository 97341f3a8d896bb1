"""Incident validation, numbering and rollups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import scores
from riskloom.operators.history import instant
from riskloom.settings import SEVERITY_POINTS, Settings

# Copies of one incident row that are numbered by one row of a block.
_COPY_BLOCK = 10_000


def incident_rollup(
    incidents: DataFrame, as_of: str, settings: Settings = Settings()
) -> DataFrame:
    """Count, severities, last date and score of each file that has incidents."""
    date = F.col("date").cast("timestamp")
    since = instant(as_of) - F.make_dt_interval(hours=F.lit(24 * settings.recent_days))
    severity_points = reduce(
        add, [F.when(F.col("severity") == s, p).otherwise(0) for s, p in SEVERITY_POINTS.items()])
    return (
        incidents.groupBy("repo_id", F.col("file").alias("path"))
        .agg(
            F.count("*").alias("incident_count"),
            F.bool_or(date > since).alias("any_recent"),
            F.sum(severity_points).alias("severity_points"),
            F.max(date).alias("last_incident"),
            *[F.count_if(F.col("severity") == s).alias(f"sev_{s}") for s in SEVERITY_POINTS],
        )
        .withColumn("incident_score", scores.incident_score(
            F.col("incident_count"), F.col("any_recent"), F.col("severity_points")))
    )


def prepare_incidents(raw: DataFrame, as_of: str) -> DataFrame:
    """Parse and check new incident rows; ``error`` is null on the good ones.

    ``raw`` has repo_id, file, severity, description and a ``date`` string
    (``YYYY-MM-DD``; empty means the time of the run).
    """
    text = F.coalesce(F.col("date"), F.lit(""))
    well_formed = F.rlike(text, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    parsed = F.when(well_formed, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    date = F.when(text == "", instant(as_of)).otherwise(parsed)

    def missing(name: str):
        return F.coalesce(F.col(name), F.lit("")) == ""

    return raw.withColumn("date_text", text).withColumn("date", date).withColumn(
        "error",
        F.when(missing("file") | missing("severity") | missing("description"),
               "file, severity and description are required")
        .when(F.col("date").isNull(), "date must be YYYY-MM-DD")
        .when(~F.col("severity").isin(*SEVERITY_POINTS),
              "severity must be critical, high, medium or low"),
    )


def split_incidents(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their error."""
    good = prepared.filter(F.col("error").isNull()).drop("error", "date_text")
    bad = prepared.filter(F.col("error").isNotNull()).drop("date") \
        .withColumnRenamed("date_text", "date")
    return good, bad


def number_incidents(accepted: DataFrame, existing: DataFrame) -> DataFrame:
    """Give accepted incidents ids that continue each repository's numbering.

    Rows are ordered by date, then by a digest of the row. Numbers come from counts:
    equal rows are counted into one before they are shuffled, running totals over the
    counts per repository, date and digest prefix give each such slice its first number,
    and only the different rows of one slice are ranked together. Copies are written out
    again at the end, in blocks that are spread over the tasks.
    """
    columns = ["file", "date", "severity", "description"]
    slices = ["repo_id", "date", "slice"]
    digest = F.md5(F.concat_ws("\x1f", "file", "severity", "description"))
    rows = (
        accepted.groupBy("repo_id", *columns).agg(F.count("*").alias("copies"))
        .withColumn("digest", digest).withColumn("slice", F.substring("digest", 1, 2))
    )
    earlier = Window.partitionBy("repo_id").orderBy("date", "slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*slices).orderBy("digest") \
        .rowsBetween(Window.unboundedPreceding, -1)
    taken = existing.groupBy("repo_id").agg(F.count("*").alias("taken"))
    starts = (
        rows.groupBy(*slices).agg(F.sum("copies").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(taken, "repo_id", "left")
        .select(*slices, (F.col("start") + F.coalesce("taken", F.lit(0))).alias("start"))
    )
    first = F.col("start") + F.coalesce("in_slice", F.lit(0)) + 1
    block = F.lit(_COPY_BLOCK)
    from_copy = F.col("block") * block
    to_copy = F.least(F.col("copies"), from_copy + block) - 1
    number = F.col("first") + F.col("copy")
    return (
        rows.withColumn("in_slice", F.sum("copies").over(above)).join(starts, slices)
        .select(
            "repo_id", *columns, "copies", first.alias("first"),
            F.explode(F.sequence(F.lit(0).cast("bigint"),
                                 F.floor((F.col("copies") - 1) / block))).alias("block"),
        )
        .repartition("repo_id", *columns, "block")
        .withColumn("copy", F.explode(F.sequence(from_copy, to_copy)))
        .select(
            "repo_id",
            F.format_string("INC-%s-%03d", F.date_format("date", "yyyy"), number).alias("id"),
            *columns,
        )
    )


def for_file(incidents: DataFrame, repo_id: str, path: str) -> DataFrame:
    return incidents.filter((F.col("repo_id") == repo_id) & (F.col("file") == path))


def listed(incidents: DataFrame) -> DataFrame:
    """Incidents in the order they are listed: by id inside a repository, or by date where
    they have no ids yet."""
    order = ["id"] if "id" in incidents.columns else ["date", "file", "severity"]
    return incidents.orderBy("repo_id", *order)


def by_file(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("repo_id", "file").agg(F.count("*").alias("incidents"))


def counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("repo_id").agg(F.count("*").alias("incidents"))
