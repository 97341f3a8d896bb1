"""Assembly of the scored file table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths, scores
from riskloom.operators.assessments import blast_columns, one_per_hash
from riskloom.schemas import IMPACTS, RECENT_CHANGES
from riskloom.settings import SEVERITY_POINTS, TIERS, ReviewRule, Settings

FILE = ["repo_id", "path"]

# Columns of the scored table, in order, all flat: readers prune what they do not use.
HEAT_COLUMNS = [
    *FILE, "language", "lines", "bytes", "heat_score", "tier",
    "centrality", "import_count", "exported_symbols",
    "incident_score", "incident_count", "last_incident",
    *[f"sev_{s}" for s in SEVERITY_POINTS],
    "churn_score", "commit_count", "commits_last_90d", "unique_authors",
    "user_impact_score", "user_facing", "affects_auth", "affects_data", "affects_payments",
    "sensitivity_score", "handles_pii", "handles_secrets", "handles_financial",
    "coverage_score", "coverage_percent", "test_count", "has_integration_tests",
    "complexity_score", "cyclomatic", "cognitive", "function_count",
    "blast_score", *IMPACTS, "summary", "critical_reason", "assessed",
    *ReviewRule.__dataclass_fields__,
]


# Columns of the joined rollups; a file that a rollup does not know has 0.
_ROLLUPS = [
    "centrality", "import_count", "incident_score", "incident_count",
    *[f"sev_{s}" for s in SEVERITY_POINTS],
    "churn_score", "commit_count", "commits_last_90d", "unique_authors",
]


def score_files(
    metrics: DataFrame,
    history: DataFrame,
    incidents: DataFrame,
    centrality: DataFrame,
    assessments: DataFrame | None = None,
    coverage: DataFrame | None = None,
    annotations: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Score every file of ``metrics``.

    ``history``, ``incidents`` and ``centrality`` are the per-file rollups. They share
    the key (repo_id, path) with one row each, so the left joins below use a single
    hash partitioning of the files. ``assessments`` is keyed by ``content_hash``, which
    very many files can share (empty files, copied licenses): adaptive execution splits
    the join of such a hash. Assessments may repeat a hash; the newest counts.
    Coverage defaults to 50 percent. An annotation's override replaces the tier.
    """
    files = metrics.drop("imports")
    if assessments is None:
        files = files.withColumn("assessed", F.lit(False)).withColumns(
            {name: F.lit(0) for name in IMPACTS}).withColumns(
            {"blast_radius_summary": F.lit(""), "critical_reason": F.lit("")})
    else:
        found = one_per_hash(assessments).withColumn("assessed", F.lit(True))
        files = files.join(found, "content_hash", "left").withColumn(
            "assessed",
            F.coalesce("assessed", F.lit(False)) & paths.is_assessable(F.col("path")))
        keep = [*IMPACTS, "blast_radius_summary", "critical_reason"]
        files = files.withColumns({c: F.when(F.col("assessed"), F.col(c)) for c in keep})

    df = files.join(history, FILE, "left").join(incidents, FILE, "left") \
        .join(centrality, FILE, "left")
    if coverage is None:
        df = df.withColumns({
            "coverage_percent": F.lit(50.0), "test_count": F.lit(0).cast("bigint"),
            "has_integration_tests": F.lit(False)})
    else:
        # Reports of one file count as the one with the highest coverage.
        best = coverage.groupBy(*FILE).agg(F.max(F.struct(
            "coverage_percent", "test_count", "has_integration_tests")).alias("c")).select(*FILE, "c.*")
        df = df.join(best, FILE, "left").withColumns({
            "coverage_percent": F.coalesce("coverage_percent", F.lit(50.0)),
            "test_count": F.coalesce("test_count", F.lit(0).cast("bigint")),
            "has_integration_tests": F.coalesce("has_integration_tests", F.lit(False))})

    path = F.col("path")
    df = df.na.fill(0, _ROLLUPS).withColumns({
        **paths.user_impact_flags(path),
        **paths.sensitivity_flags(path),
        **blast_columns(),
    })
    df = df.withColumns({
        "user_impact_score": scores.user_impact_score(
            F.col("user_facing"), F.col("affects_auth"),
            F.col("affects_data"), F.col("affects_payments")),
        "sensitivity_score": scores.data_sensitivity_score(
            F.col("handles_pii"), F.col("handles_secrets"), F.col("handles_financial")),
        "coverage_score": scores.coverage_score(
            F.col("coverage_percent"), F.col("has_integration_tests")),
        "complexity_score": scores.complexity_score(F.col("cyclomatic"), F.col("cognitive")),
    })
    df = df.withColumn("heat_score", scores.heat_score())
    df = df.withColumn("tier", scores.tier_of(F.col("heat_score"), settings.tiers))
    if annotations is not None:
        df = override_tiers(df, annotations)
    df = df.withColumns(scores.review_columns(settings))
    return df.select(*HEAT_COLUMNS)


def override_tiers(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """Replace the tier of annotated files; an unknown override is ignored."""
    overrides = annotations.filter(F.col("override_tier").isin(*TIERS)) \
        .groupBy(*FILE).agg(F.max_by("override_tier", scores.tier_rank(F.col("override_tier")))
                            .alias("override_tier"))
    return (
        df.join(overrides, FILE, "left")
        .withColumn("tier", F.coalesce("override_tier", "tier")).drop("override_tier")
    )


def nest_heat(heat: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The scored table as nested rows, the shape that is exported as JSON.

    ``changes`` is (repo_id, path, recent_changes). Importers stay a table of their own
    (:func:`riskloom.operators.imports.import_edges`): a list of all importers of a hot
    file has no bound.
    """
    c = F.col
    if changes is None:
        changes_column = F.lit(None).cast(RECENT_CHANGES)
    else:
        heat = heat.join(changes, FILE, "left")
        changes_column = c("recent_changes")
    severities = [x for s in SEVERITY_POINTS for x in (F.lit(s), c(f"sev_{s}").cast("bigint"))]
    factors = F.struct(
        F.struct(c("centrality").alias("score"), "import_count", "exported_symbols")
        .alias("dependency_centrality"),
        F.struct(c("incident_score").alias("score"), "incident_count", "last_incident",
                 F.create_map(*severities).alias("severity_breakdown"))
        .alias("incident_history"),
        F.struct(c("churn_score").alias("score"), "commit_count", "commits_last_90d",
                 "unique_authors").alias("change_frequency"),
        F.struct(c("user_impact_score").alias("score"), "user_facing", "affects_auth",
                 "affects_data", "affects_payments").alias("user_impact"),
        F.struct(c("sensitivity_score").alias("score"), "handles_pii", "handles_secrets",
                 "handles_financial").alias("data_sensitivity"),
        F.struct(c("coverage_score").alias("score"), "coverage_percent", "test_count",
                 "has_integration_tests").alias("test_coverage"),
        F.struct(c("complexity_score").alias("score"), "cyclomatic", "cognitive",
                 "function_count").alias("complexity"),
        F.struct(c("blast_score").alias("score"), *IMPACTS, "summary", "critical_reason",
                 "assessed").alias("blast_radius"),
    )
    return heat.select(
        "repo_id", "path", "heat_score", "tier", "language",
        F.struct("lines", "bytes").alias("size"),
        factors.alias("factors"),
        changes_column.alias("recent_changes"),
        F.struct(*ReviewRule.__dataclass_fields__).alias("review_requirements"),
    )


def flatten_heat(nested: DataFrame) -> DataFrame:
    """Flat columns of nested rows: the inverse of :func:`nest_heat`."""
    f = "factors."
    renamed = {
        "centrality": f + "dependency_centrality.score",
        "incident_score": f + "incident_history.score",
        "churn_score": f + "change_frequency.score",
        "user_impact_score": f + "user_impact.score",
        "sensitivity_score": f + "data_sensitivity.score",
        "coverage_score": f + "test_coverage.score",
        "complexity_score": f + "complexity.score",
        "blast_score": f + "blast_radius.score",
        "lines": "size.lines", "bytes": "size.bytes",
    }
    groups = {
        "dependency_centrality": ["import_count", "exported_symbols"],
        "incident_history": ["incident_count", "last_incident"],
        "change_frequency": ["commit_count", "commits_last_90d", "unique_authors"],
        "user_impact": ["user_facing", "affects_auth", "affects_data", "affects_payments"],
        "data_sensitivity": ["handles_pii", "handles_secrets", "handles_financial"],
        "test_coverage": ["coverage_percent", "test_count", "has_integration_tests"],
        "complexity": ["cyclomatic", "cognitive", "function_count"],
        "blast_radius": [*IMPACTS, "summary", "critical_reason", "assessed"],
    }
    for group, names in groups.items():
        renamed.update({name: f"{f}{group}.{name}" for name in names})
    renamed.update({n: f"review_requirements.{n}" for n in ReviewRule.__dataclass_fields__})
    breakdown = F.col(f + "incident_history.severity_breakdown")
    columns = {name: F.col(source) for name, source in renamed.items()}
    columns.update({
        f"sev_{s}": F.coalesce(F.try_element_at(breakdown, F.lit(s)), F.lit(0))
        for s in SEVERITY_POINTS})
    defaults = {"summary": "", "critical_reason": "", "language": "", "assessed": False}
    out = []
    for name in HEAT_COLUMNS:
        value = columns.get(name, F.col(name) if name not in columns else None)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        elif name not in (*FILE, "tier", "last_incident"):
            zero = False if name.startswith(("affects", "handles", "has_", "user_f",
                                             "requires", "auto")) else 0
            value = F.coalesce(value, F.lit(zero))
        out.append(value.alias(name))
    return nested.select(*out)
