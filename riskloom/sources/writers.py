"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.operators.assessments import ASSESSMENT_COLUMNS, one_per_hash
from riskloom.operators.heat import nest_heat
from riskloom.operators.reports import latest_runs
from riskloom.operators.incidents import number_incidents, prepare_incidents, split_incidents
from riskloom.sources.keyed import KeyedTable
from riskloom.sources.staging import shuffles_removed, stage

# JSON lines repeat every field name. A compressed file is read by one task, so a file ends
# after so many rows.
_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 100_000}


def write_heat(heat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save the scored table, clustered by repository and path.

    Range partitioning cuts a large repository over many files and keeps small ones
    together, so there is neither a folder nor a file per repository; a reader of one
    repository or file skips the rest by the key ranges in the parquet footers.
    """
    (
        heat.repartitionByRange("repo_id", "path").sortWithinPartitions("repo_id", "path")
        .write.mode(mode).parquet(path)
    )


def write_heat_json(
    heat: DataFrame, path: str, changes: DataFrame | None = None, mode: str = "overwrite"
) -> None:
    """Save nested rows as JSON lines, one file of code per line."""
    nest_heat(heat, changes).write.mode(mode).json(path)


def write_result(
    path: str, heat: DataFrame, runs: DataFrame, *, changes: DataFrame | None = None,
    edges: DataFrame | None = None, incidents: DataFrame | None = None,
    annotations: DataFrame | None = None, version: str = "1.0.0", mode: str = "overwrite",
) -> None:
    """Save a whole result as compressed JSON lines: a folder each for the run of every
    repository (``metadata``), its ``files``, ``incidents``, ``annotations`` and ``dependencies``.

    All are keyed by repository (files and dependencies by path too). One object for each
    repository, as a single-repository tool writes it, would gather all files of a
    repository in one row, and all importers of a file in one list.
    """
    languages = (
        heat.groupBy("repo_id", "language").agg(F.count("*").alias("n")).groupBy("repo_id")
        .agg(F.sum("n").alias("total_files"), F.map_from_entries(F.array_sort(
            F.collect_list(F.struct("language", "n")))).alias("languages"))
    )
    metadata = latest_runs(runs).join(languages, "repo_id", "full_outer").select(
        "repo_id", F.lit(version).alias("version"), "repo_path", "analyzed_at", "commit_sha",
        "branch", F.coalesce("total_files", F.lit(0).cast("bigint")).alias("total_files"), "languages")
    parts = {"metadata": metadata, "files": nest_heat(heat, changes), "incidents": incidents,
             "annotations": annotations,
             "dependencies": None if edges is None else edges.select(
                 "repo_id", "path", "imported_by", "match")}
    with shuffles_removed(heat.sparkSession):
        for name, part in parts.items():
            if part is not None:
                part.write.mode(mode).options(**_PACKED).json(f"{path}/{name}")


def heat_json(heat: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Nested rows as JSON text next to their key."""
    nested = nest_heat(heat, changes)
    body = F.struct(*[c for c in nested.columns if c != "repo_id"])
    return nested.select("repo_id", "path", F.to_json(body).alias("json"))


def write_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save the flat BI extract as JSON lines."""
    facts.write.mode(mode).json(path)


def append_incidents(raw: DataFrame, log_path: str, existing: DataFrame, as_of: str) -> DataFrame:
    """Check, number and append new incidents; returns the rejected rows.

    The numbered batch is staged before it is appended: the append then writes fixed
    rows even if it reads the log it appends to.
    """
    good, bad = split_incidents(prepare_incidents(raw, as_of))
    stage(number_incidents(good, existing), "incidents").write.mode("append").parquet(log_path)
    return bad


def append_assessments(fresh: DataFrame, path: str, batch: int, parts: int = 64) -> None:
    """Merge the assessments of batch number ``batch``, higher than those before it, into the
    table at ``path``: a fresh assessment replaces the one of the same content.

    The table is keyed by content hash. A batch rewrites the parts that its contents fall
    into, and holds one row per content however many batches there were, so readers neither
    aggregate nor pass over history. ``parts`` stays the same for the life of a table."""
    def merge(held: DataFrame, rows: DataFrame) -> DataFrame:
        return held.join(rows.select("content_hash"), "content_hash", "left_anti").unionByName(rows)

    rows = stage(one_per_hash(fresh).select(*ASSESSMENT_COLUMNS), "assessments")
    KeyedTable(fresh.sparkSession, path, schemas.ASSESSMENTS, ("content_hash",), parts).update(rows, batch, merge)
