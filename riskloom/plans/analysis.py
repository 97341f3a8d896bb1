"""The main job: score every file of every repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskloom.operators import history as hist
from riskloom.operators import imports
from riskloom.operators.heat import score_files
from riskloom.operators.incidents import incident_rollup
from riskloom.operators.sources import import_refs, source_metrics
from riskloom.settings import Settings
from riskloom.sources.staging import stage


@dataclass(frozen=True)
class Analysis:
    """Result tables of one run. Metrics, resolved imports and commit rollups are written while
    the plan is built; heat, edges and changes are lazy and start from them."""

    metrics: DataFrame
    heat: DataFrame
    edges: DataFrame
    changes: DataFrame


def score_metrics(
    metrics: DataFrame, refs: DataFrame, commits: DataFrame, incidents: DataFrame, as_of: str,
    settings: Settings = Settings(), resolved: DataFrame | None = None, **extra: DataFrame | None,
) -> DataFrame:
    """Scored table from a metrics table and import references; ``resolved`` are those
    imports where they have been resolved already. The commits, the most rows, are rolled up
    and written first, so that what they shuffle is gone when the rest is joined."""
    return score_files(
        metrics,
        stage(hist.file_history(commits, as_of, settings), "history"),
        incident_rollup(incidents, as_of, settings).drop("any_recent", "severity_points"),
        imports.centrality(imports.fan_in(metrics, refs, resolved)),
        settings=settings,
        **extra,
    )


def analyze(
    files: DataFrame, commits: DataFrame, incidents: DataFrame, as_of: str,
    settings: Settings = Settings(),
    assessments: DataFrame | None = None,
    coverage: DataFrame | None = None,
    annotations: DataFrame | None = None,
) -> Analysis:
    """Scan the sources once and score them.

    The contents are read by one narrow pass whose result, a small row per file, is
    staged: import resolution, scoring and assessment planning all start from it. Imports are
    resolved once, for both the scores and the edges.
    """
    metrics = stage(source_metrics(files, settings), "metrics")
    refs = import_refs(metrics)
    resolved = imports.resolved_imports(metrics, refs)
    heat = score_metrics(
        metrics, refs, commits, incidents, as_of, settings, resolved,
        assessments=assessments, coverage=coverage, annotations=annotations,
    )
    return Analysis(
        metrics=metrics,
        heat=heat,
        edges=imports.import_edges(metrics, refs, resolved),
        changes=hist.recent_changes(commits, as_of, settings),
    )
