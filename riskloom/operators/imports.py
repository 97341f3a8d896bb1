"""Import resolution and dependency centrality.

An import resolves twice, and both hits count: exactly, to the first existing of six file
names built from it, and loosely, to the first other path that contains it.

Loose matching pairs nothing. The paths are numbered in name order, and the suffixes of all
paths of a repository are put in order; an import's matches are then the suffixes that begin
with it, which lie side by side. Two marks of every import, sorted in with the suffixes, give
its range. A task answers the ranges that lie in its piece of the order, from minima over spans of
1, 2, 4 and so on suffixes, however many suffixes a range holds; the few ranges that reach over
pieces are put together from their ends and the minima of the pieces between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import in_order, two_least_between_marks
from riskloom.operators.skew import spread_join
from riskloom.sources.staging import stage

# Endings of the file names an import may stand for, in the order they are tried;
# the last one is tried again behind the cleaned path.
EXACT_ENDINGS = (".py", ".go", ".ts", ".js", "/__init__.py")

_PACKAGE = "/__init__.py"
_IMPORT = ["repo_id", "imp"]


def distinct_imports(refs: DataFrame) -> DataFrame:
    """Imports of each repository with the number of lines that name them."""
    return refs.groupBy(*_IMPORT).agg(F.count("*").alias("refs"))


def exact_targets(files: DataFrame) -> DataFrame:
    """For every importable name the file it stands for: one row per (repo_id, imp)."""
    path = F.col("path")
    names = []
    for rank, ending in enumerate(EXACT_ENDINGS):
        stem = F.substring(path, F.lit(1), F.length(path) - len(ending))
        fits = F.endswith(path, F.lit(ending)) & (F.length(path) > len(ending))
        names.append(F.when(fits, F.struct(stem.alias("imp"), F.lit(rank).alias("rank"))))
    # The name and the rank give the path back, so only a number is aggregated.
    endings = F.array(*[F.lit(e) for e in EXACT_ENDINGS])
    return (
        files.select("repo_id", F.explode(F.array_compact(F.array(*names))).alias("target"))
        .groupBy("repo_id", F.col("target.imp").alias("imp"))
        .agg(F.min("target.rank").alias("rank"))
        .select(*_IMPORT, F.concat("imp", F.element_at(endings, F.col("rank") + 1)).alias("exact_path"))
    )


def cleaned(path: Column) -> Column:
    """A path without empty and ``.`` segments, and ``..`` taken together with the segment
    before it; ``.`` if nothing is left."""
    rooted = F.startswith(path, F.lit("/"))

    def step(kept: Column, segment: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        up = segment == ".."
        return (
            F.when(segment.isin("", "."), kept)
            .when(up & F.coalesce(last != "..", F.lit(False)), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when(up & rooted, kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    parts = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), parts)).when(parts == "", ".").otherwise(parts)


def package_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """The package file that an import stands for once its path is cleaned, where cleaning
    changes it: one row per (repo_id, imp)."""
    # Only an empty segment, ``.`` or ``..`` is cleaned away.
    unclean = F.rlike("imp", F.lit(r"(?:\A|/)\.{0,2}(?:/|\z)"))
    odd = imports.filter(unclean).select(*_IMPORT, cleaned(F.col("imp")).alias("clean"))
    clean = F.col("clean")
    # Elsewhere the cleaned name is that of the last ending.
    odd = odd.filter((clean != F.col("imp")) | clean.isin(".", "/"))
    named = F.when(clean == ".", _PACKAGE[1:]).when(clean == "/", _PACKAGE).otherwise(F.concat(clean, F.lit(_PACKAGE)))
    return odd.select(*_IMPORT, named.alias("path")).join(
        files.filter(F.endswith("path", F.lit(_PACKAGE[1:]))).select("repo_id", "path"), ["repo_id", "path"], "left_semi",
    ).select(*_IMPORT, F.col("path").alias("package_path"))


def loose_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """The first two paths, in name order, that contain each import.

    Two are enough: an importer that is itself the first is given the second. No suffix is
    kept beyond the length of the longest import.
    """
    numbered = in_order(files.distinct(), ["repo_id", "path"], "no", "paths")
    imports = imports.select(*_IMPORT).filter("repo_id is not null and imp is not null")
    asked = imports.agg(F.max(F.length("imp")), F.count("*")).first()
    longest = asked[0] or 0
    key = lambda text: F.encode(text, "UTF-8")
    suffixes = numbered.filter("path <> ''").select(
        "repo_id", "path", F.explode(F.sequence(F.lit(1), F.length("path"))).alias("start"), "no",
    ).select("repo_id", key(F.substring("path", F.col("start"), F.lit(longest))).alias("key"), F.lit(1).alias("kind"), "no")
    # No text has the byte 255, so the second mark stands behind all that begins with the import.
    marks = imports.select("repo_id", "imp", F.explode(F.array(F.lit(0), F.lit(2))).alias("kind")).select(
        "repo_id", F.when(F.col("kind") == 0, key(F.col("imp"))).otherwise(F.concat(key(F.col("imp")), F.lit(b"\xff"))).alias("key"),
        "kind", F.lit(None).cast("bigint").alias("no"))
    rows = 2 * asked[1] + (numbered.agg(F.sum(F.length("path"))).first()[0] or 0)
    least = two_least_between_marks(suffixes.unionByName(marks), ["repo_id", "key"], "kind", "no", rows).select(
        "repo_id", F.decode("key", "UTF-8").alias("imp"), F.get("least", F.lit(0)).alias("first"), F.get("least", F.lit(1)).alias("second"))
    path = lambda no, name: numbered.select(F.col("no").alias(no), F.col("path").alias(name))
    return (
        least.join(path("first", "loose_path"), "first").join(path("second", "loose_next"), "second", "left")
        .select(*_IMPORT, "loose_path", "loose_next")
    )


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """What each distinct import stands for; nulls where nothing matches."""
    files = files.select("repo_id", "path")
    return (
        imports.join(exact_targets(files), _IMPORT, "left")
        .join(package_targets(files, imports), _IMPORT, "left")
        .withColumn("exact_path", F.coalesce("exact_path", "package_path")).drop("package_path")
        .join(loose_targets(files, imports), _IMPORT, "left")
    )


def resolved_imports(files: DataFrame, refs: DataFrame) -> DataFrame:
    """The same for the imports of ``refs``, with their number of lines, as a written table:
    :func:`import_edges` and :func:`fan_in` both start from it."""
    return stage(resolve_imports(files, stage(distinct_imports(refs), "imports")), "resolved")


def import_edges(files: DataFrame, refs: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """One row per resolved import: target ``path`` and the importing file.

    Both hits of an import line are kept, so a target can appear twice. ``resolved`` is the
    table of :func:`resolved_imports`, if there is one already.
    """
    resolved = (resolved or resolved_imports(files, refs)).drop("refs")
    other = F.when(F.col("loose_path") != F.col("imported_by"), F.col("loose_path")) \
        .otherwise(F.col("loose_next"))
    refs = refs.withColumnRenamed("path", "imported_by")
    return (
        refs.join(resolved, _IMPORT)
        .select(
            "repo_id", "imported_by", "imp",
            F.inline(F.array_compact(F.array(
                F.when(F.col("exact_path").isNotNull(), F.struct(
                    F.col("exact_path").alias("path"), F.lit("exact").alias("match"))),
                F.when(other.isNotNull(), F.struct(
                    other.alias("path"), F.lit("loose").alias("match"))),
            ))),
        )
    )


def fan_in(files: DataFrame, refs: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Number of import lines that resolve to each file that has any.

    Counts the same edges as :func:`import_edges` without listing them: lines are
    counted per import before any shuffle, and only lines of a file that is its own
    first loose hit are looked at one by one.
    """
    resolved = resolved or resolved_imports(files, refs)
    own = (
        refs.filter(F.contains("path", "imp"))
        .groupBy("repo_id", "imp", F.col("path").alias("loose_path"))
        .agg(F.count("*").alias("own_refs"))
    )
    counted = resolved.join(own, ["repo_id", "imp", "loose_path"], "left") \
        .withColumn("own_refs", F.coalesce("own_refs", F.lit(0)))
    shares = F.array(
        F.struct(F.col("exact_path").alias("path"), F.col("refs").alias("n")),
        F.struct(F.col("loose_path").alias("path"),
                 (F.col("refs") - F.col("own_refs")).alias("n")),
        F.struct(F.col("loose_next").alias("path"), F.col("own_refs").alias("n")),
    )
    return (
        counted.select("repo_id", F.inline(shares))
        .filter(F.col("path").isNotNull() & (F.col("n") > 0))
        .groupBy("repo_id", "path").agg(F.sum("n").alias("import_count"))
    )


def centrality(fan_in_counts: DataFrame) -> DataFrame:
    """Fan-in over the largest fan-in of the repository, 0..1.

    The maximum is a partial aggregate joined back, not a window over a repository.
    """
    largest = fan_in_counts.groupBy("repo_id").agg(F.max("import_count").alias("max_count"))
    ratio = F.col("import_count").cast("double") / F.col("max_count").cast("double")
    return (
        spread_join(fan_in_counts, largest, ["repo_id"], ["path"])
        .select("repo_id", "path", "import_count", ratio.alias("centrality"))
    )
