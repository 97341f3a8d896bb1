"""Static facts of source files: inventory, code metrics, import references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import code, paths, texts
from riskloom.settings import Settings


def analysable(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Files of a known language outside hidden and excluded directories.

    Both tests read only ``path``, so they run before any content is touched.
    """
    path = F.col("path")
    return (
        files.withColumn("language", paths.language(path))
        .filter(F.col("language") != "")
        .filter(~paths.in_excluded_dir(path, settings.exclude))
    )


def inventory(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Language, size and place of every analysable file."""
    path, content = F.col("path"), F.col("content")
    return analysable(files, settings).select(
        "repo_id", "path", "language",
        texts.line_count(content).alias("lines"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        paths.directory(path).alias("dir"),
        paths.base_name(path).alias("name"),
        paths.module(path).alias("module"),
    )


def source_metrics(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per analysable file: size, content hash, code metrics, imports.

    A single narrow pass over the contents; the text itself does not leave it.
    """
    language, content = F.col("language"), F.col("content")
    return (
        analysable(files, settings)
        .withColumn("prepared", code.prepared_text(language, content))
        .select(
            "repo_id", "path", "language",
            texts.line_count(content).alias("lines"),
            F.octet_length(content).cast("bigint").alias("bytes"),
            texts.content_hash(content).alias("content_hash"),
            code.metrics_struct(language, content, F.col("prepared")).alias("m"),
        )
        .select(
            "repo_id", "path", "language", "lines", "bytes", "content_hash",
            *[F.col(f"m.{name}") for name in code.METRICS], F.col("m.imports"),
        )
    )


def import_refs(metrics: DataFrame) -> DataFrame:
    """One row per import line: the importing file and the imported name."""
    # An inner explode would add a filter on the array, and pushing that filter down
    # would compute the metrics twice.
    refs = metrics.select("repo_id", "path", F.explode_outer("imports").alias("imp"))
    return refs.filter(F.col("imp").isNotNull())


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def repo_languages(files: DataFrame) -> DataFrame:
    """Total files and the file count of each language, one row per repository."""
    entries = F.sort_array(F.collect_list(F.struct("language", "files")))
    return (
        language_counts(files).groupBy("repo_id")
        .agg(F.sum("files").alias("total_files"), F.map_from_entries(entries).alias("languages"))
    )
