"""Which contents need an assessment, and what the answers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths, responses, texts
from riskloom.schemas import ASSESSMENTS, IMPACTS
from riskloom.settings import Settings
from riskloom.operators.sources import analysable
from riskloom.sources.staging import stage

ASSESSMENT_COLUMNS = ASSESSMENTS.fieldNames()


def assessable(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Analysable files whose content is worth assessing."""
    return analysable(files, settings).filter(paths.is_assessable(F.col("path")))


def content_groups(hashed: DataFrame) -> DataFrame:
    """One row per distinct content: how many files share it and the first of them.

    A partial aggregate on narrow rows, so a content copied into very many files is
    counted before it is shuffled. The least struct is found by a sorted aggregate; its
    rows are a hash and a path, never contents.
    """
    return (
        hashed.groupBy("content_hash")
        .agg(F.count("*").alias("files"), F.min(F.struct("repo_id", "path")).alias("first"))
        .select("content_hash", "files", "first.repo_id", "first.path")
    )


def split_by_cache(
    groups: DataFrame, cache: DataFrame, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Contents already assessed and contents still to assess."""
    if force:
        return groups.limit(0), groups
    known = cache.select("content_hash")
    return (
        groups.join(known, "content_hash", "left_semi"),
        groups.join(known, "content_hash", "left_anti"),
    )


_BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def maybe_among(files: DataFrame, wanted: DataFrame, count: int, most_bits: int) -> DataFrame:
    """The rows of ``files`` whose (repo_id, path) may be among the ``count`` wanted ones.

    All wanted files are kept, and about an eighth of the others or fewer, more only where
    the bitmap would need over ``most_bits`` bits. The bitmap is built by partial aggregates
    and broadcast, a row for each 32,768 bits; nothing of ``files`` is shuffled."""
    bits = min(max(8 * count, _BUCKET), most_bits)
    bits = max(-(-bits // _BUCKET) * _BUCKET, _BUCKET)
    slot = F.pmod(F.xxhash64("repo_id", "path"), F.lit(bits)) + 1
    bitmaps = (
        wanted.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_bit"))
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = files.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "_bucket")
    return held.filter(F.getbit(byte.cast("bigint"), (bit % 8).cast("int")) == 1).select(*files.columns)


def plan_assessments(
    files: DataFrame, cache: DataFrame, settings: Settings = Settings(),
    force: bool = False, hashed: DataFrame | None = None, broadcast_rows: int = 500_000,
    filter_bits: int = 1 << 27,
) -> DataFrame:
    """One prompt per distinct content that the cache does not know.

    Only hashes travel through the grouping and the anti join. What the cache misses is
    staged; up to ``broadcast_rows`` rows of it are broadcast to the scan of the contents,
    which then are not shuffled at all. Beyond that a bitmap of the missed files, of at most
    ``filter_bits`` bits, is broadcast instead: the scan drops the files that are not in it, and
    the prompts of the others are shuffled to the exact join. Give ``hashed`` (repo_id, path,
    content_hash), as the metrics table has it, to spare a second hashing.
    """
    candidates = assessable(files, settings)
    if hashed is None:
        hashed = candidates.select(
            "repo_id", "path", texts.content_hash(F.col("content")).alias("content_hash"))
    else:
        hashed = hashed.filter(paths.is_assessable(F.col("path")))
    _, misses = split_by_cache(content_groups(hashed), cache, force)
    misses = stage(misses, "misses")
    missed = misses.count()
    if missed <= broadcast_rows:
        misses = F.broadcast(misses)
    else:
        candidates = maybe_among(candidates, misses, missed, filter_bits)
    prompt = texts.assessment_prompt(F.col("path"), F.col("content"), settings.prompt_lines)
    prompts = candidates.select("repo_id", "path", prompt.alias("prompt"))
    return prompts.join(misses, ["repo_id", "path"]).select(
        "content_hash", "repo_id", "path", "files", "prompt")


def unwrap_chat(raw: DataFrame) -> DataFrame:
    """Chat-completion bodies to response texts; a body without a choice has none."""
    return raw.select("content_hash", responses.chat_content(F.col("body")).alias("text"))


def parse_responses(answers: DataFrame) -> DataFrame:
    """Responses with their assessment columns and whether they could be read.

    Parsing takes far longer than reading, so the rows are dealt out first: a table of short
    responses may be a single piece of a file."""
    parts = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = answers.repartition(parts, "content_hash", "text")
    # Fields and struct are columns of their own, so that what follows shares one parse.
    read = answers.withColumn("fields", responses.assessment_fields(F.col("text")))
    kept = [c for c in answers.columns if c == "batch"]
    return (
        read.select("content_hash", "text", *kept, responses.assessment_body(F.col("fields")).alias("body"))
        .select(
            "content_hash", "text", *kept, F.col("body").isNotNull().alias("accepted"),
            *[v.alias(name) for name, v in responses.assessment_columns("body").items()],
        )
    )


def one_per_hash(assessments: DataFrame, only: Column | None = None) -> DataFrame:
    """One row per content hash: of repeated ones that of the highest ``batch`` (no batch is
    the oldest), then the one with the highest values, so that runs agree. Rows that are not
    ``only`` do not count; they are left out by the grouping, as a filter on a parsed column
    would be moved before the rows are dealt out, and parse them a second time."""
    if "batch" not in assessments.columns:
        assessments = assessments.withColumn("batch", F.lit(0).cast("bigint"))
    values = [c for c in ASSESSMENT_COLUMNS if c != "content_hash"]
    row = F.struct(F.coalesce("batch", F.lit(-1)).alias("batch"), *values)
    newest = F.max(row if only is None else F.when(only, row))
    return assessments.groupBy("content_hash").agg(newest.alias("a")).filter("a is not null").select(
        "content_hash", *[F.col(f"a.{c}") for c in values])


def accepted(parsed: DataFrame) -> DataFrame:
    """Readable responses, one for each content: the newest if answers carry a ``batch``."""
    return one_per_hash(parsed, F.col("accepted"))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("accepted")).select("content_hash", "text")


def merge_assessments(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and fresh assessments together, one for each content; a fresh one replaces a
    cached one."""
    both = one_per_hash(cached).withColumn("batch", F.lit(0).cast("bigint")).unionByName(
        one_per_hash(fresh).withColumn("batch", F.lit(1).cast("bigint")))
    return one_per_hash(both).select(*ASSESSMENT_COLUMNS)


def run_counters(groups: DataFrame, cache: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files answered from the cache, contents assessed, contents that failed: one row."""
    hits, _ = split_by_cache(groups, cache)
    return (
        hits.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("cached"))
        .join(parsed.agg(
            F.count_if("accepted").alias("assessed"),
            F.count_if(~F.col("accepted")).alias("failed"),
        ))
    )


def blast_columns() -> dict[str, Column]:
    """Blast-radius columns of a row that was left-joined to its assessment."""
    found = F.col("assessed")
    out = {"blast_score": F.when(found, responses.max_impact()).otherwise(0).cast("int")}
    for name in IMPACTS:
        out[name] = F.coalesce(F.col(name), F.lit(0)).cast("int")
    out["summary"] = F.coalesce(F.col("blast_radius_summary"), F.lit(""))
    out["critical_reason"] = F.coalesce(F.col("critical_reason"), F.lit(""))
    return out
