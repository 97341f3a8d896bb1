"""Readers. Every reader has a fixed schema; nothing is inferred."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas
from riskloom.functions import paths
from riskloom.operators.heat import flatten_heat
from riskloom.operators.pull_requests import parse_numstat
from riskloom.operators.sources import analysable
from riskloom.settings import Settings
from riskloom.sources.keyed import KeyedTable

_FAIL = {"multiLine": True, "mode": "FAILFAST"}
_BATCH_CHARS = 4_000_000
_LISTED = pa.schema([(name, pa.string()) for name in ("repo_id", "root", "path")])
_FILES = pa.schema([(name, pa.string()) for name in ("repo_id", "path", "content")])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table with one of the schemas of :mod:`riskloom.schemas`."""
    return spark.read.schema(schema).parquet(path)


def read_source_tree(
    spark: SparkSession, roots: Mapping[str, str], settings: Settings = Settings(),
    tasks: int | None = None,
) -> DataFrame:
    """Source files below checked-out trees, one root per repository.

    Trees are listed in parallel by repository and read in parallel by file, whatever
    repository the file is in. Spark's own file sources skip names that start with an
    underscore, such as ``__init__.py``; this listing keeps them, does not enter hidden
    or excluded directories, and passes on only files of a known language. ``tasks`` is the
    number of shuffle partitions unless it is given.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    skipped = re.compile(paths.excluded_dir_regex(settings.exclude))

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for folder, dirs, names in os.walk(row["root"]):
                    dirs[:] = sorted(d for d in dirs if not skipped.search(d + "/"))
                    rel = os.path.relpath(folder, row["root"])
                    prefix = "" if rel == "." else rel.replace(os.sep, "/") + "/"
                    yield pa.RecordBatch.from_pydict({
                        "repo_id": [row["repo_id"]] * len(names),
                        "root": [row["root"]] * len(names),
                        "path": [prefix + name for name in names],
                    }, _LISTED)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, size = [], 0
            for row in batch.to_pylist():
                with open(os.path.join(row["root"], row["path"]), "rb") as handle:
                    text = handle.read().decode("utf-8", errors="replace")
                read.append({"repo_id": row["repo_id"], "path": row["path"], "content": text})
                size += len(text)
                if size > _BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(read, _FILES)
                    read, size = [], 0
            yield pa.RecordBatch.from_pylist(read, _FILES)

    repos = spark.createDataFrame(list(roots.items()), "repo_id string, root string")
    listed = repos.repartition(tasks, "repo_id") \
        .mapInArrow(listing, "repo_id string, root string, path string")
    wanted = analysable(listed, settings).select("repo_id", "root", "path")
    return wanted.repartition(tasks, "repo_id", "path") \
        .mapInArrow(contents, schemas.SOURCE_FILES)


def _or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_incidents(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Incident logs in JSON; a missing log is empty, a broken one an error.

    Logs of many repositories lie in ``repo_id=<id>`` folders; for a single log give
    its ``repo_id``.
    """
    df = _or_empty(spark, schemas.INCIDENTS,
                   lambda: spark.read.schema(schemas.INCIDENTS).options(**_FAIL).json(path))
    df = df if repo_id is None else df.withColumn("repo_id", F.lit(repo_id))
    return df.select(*schemas.INCIDENTS.fieldNames())


def read_annotations(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Annotations in JSON: one array of objects, or one object keyed by path.

    Annotations of many repositories lie in ``repo_id=<id>`` folders; for a single file give
    its ``repo_id``.
    """
    body = T.StructType([f for f in schemas.ANNOTATIONS.fields if f.name not in ("repo_id", "path")])
    keyed = T.MapType(T.StringType(), body)

    def read() -> DataFrame:
        raw = spark.read.text(path, wholetext=True)
        rows = F.from_json("value", T.ArrayType(schemas.ANNOTATIONS))
        is_list = F.startswith(F.ltrim("value"), F.lit("["))
        folder = (F.col("repo_id") if "repo_id" in raw.columns else F.lit(None)).cast("string").alias("folder")
        lists = raw.filter(is_list).select(folder, F.inline(rows)).withColumn("repo_id", F.coalesce("repo_id", "folder"))
        maps = raw.filter(~is_list).select(folder, F.explode(F.from_json("value", keyed))).select(
            F.col("folder").alias("repo_id"), F.col("key").alias("path"), "value.*")
        return lists.drop("folder").unionByName(maps)

    df = _or_empty(spark, schemas.ANNOTATIONS, read)
    df = df if repo_id is None else df.withColumn("repo_id", F.lit(repo_id))
    return df.select(*schemas.ANNOTATIONS.fieldNames())


def read_numstat(
    spark: SparkSession, path: str, repo_id: str | None = None, pr_number: int | None = None
) -> DataFrame:
    """Changed files from saved ``git diff --numstat`` outputs.

    Outputs of many pull requests lie in ``repo_id=<id>/pr_number=<n>`` folders; for a
    single output give both.
    """
    lines = spark.read.text(path)
    if repo_id is not None:
        lines = lines.withColumn("repo_id", F.lit(repo_id))
    if pr_number is not None:
        lines = lines.withColumn("pr_number", F.lit(pr_number))
    lines = lines.withColumns({
        "repo_id": F.col("repo_id").cast("string"), "pr_number": F.col("pr_number").cast("bigint")})
    return parse_numstat(lines)


def read_assessment_cache(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON file per content hash; a broken file is left out."""
    corrupt = "_corrupt"
    body = T.StructType([
        *[f for f in schemas.ASSESSMENT_BODY.fields], T.StructField(corrupt, T.StringType())])

    def read() -> DataFrame:
        raw = spark.read.schema(body).json(
            path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "")
        return raw.select("*", name.alias("content_hash")).filter(F.col(corrupt).isNull())

    empty = T.StructType([*body.fields, T.StructField("content_hash", T.StringType())])
    df = _or_empty(spark, empty, read)
    zeros = {n: F.coalesce(n, F.lit(0)).cast("int") for n in schemas.IMPACTS}
    texts = {n: F.coalesce(n, F.lit("")) for n in ("blast_radius_summary", "critical_reason")}
    return df.withColumns({**zeros, **texts}).select(*schemas.ASSESSMENTS.fieldNames())


def read_heat(spark: SparkSession, path: str) -> DataFrame:
    """The scored table written by :func:`riskloom.sources.writers.write_heat`."""
    return spark.read.schema(schemas.HEAT).parquet(path)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`riskloom.sources.writers.append_assessments` keeps: the newest
    assessment of each content."""
    return KeyedTable(spark, path, schemas.ASSESSMENTS, ("content_hash",)).read()


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What :func:`riskloom.sources.writers.write_result` saved, part by part; a part that was
    not saved is empty. Files come back as flat rows of the scored table."""
    def part(name: str, schema: T.StructType) -> DataFrame:
        return _or_empty(spark, schema, lambda: spark.read.schema(schema).json(f"{path}/{name}", mode="FAILFAST"))

    return {
        "metadata": part("metadata", schemas.RUN_RESULT),
        "files": flatten_heat(part("files", schemas.FILE_HEAT)),
        "incidents": part("incidents", schemas.INCIDENTS),
        "annotations": part("annotations", schemas.ANNOTATIONS),
        "dependencies": part("dependencies", schemas.EDGES),
    }


def read_heat_document(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """Scored files of saved result documents (one JSON object per repository)."""
    documents = spark.read.schema(schemas.HEAT_DOCUMENT).options(**_FAIL).json(path)
    repo = F.col("metadata.repo_path") if repo_id is None else F.lit(repo_id)
    rows = documents.select(repo.alias("repo_id"), F.explode("files").alias("key", "file"))
    nested = rows.select("repo_id", F.coalesce("file.path", "key").alias("path"), *[
        F.col(f"file.{f.name}") for f in schemas.FILE_HEAT.fields
        if f.name not in ("repo_id", "path")])
    return flatten_heat(nested)
