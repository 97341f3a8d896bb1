"""Dependency lists with the heat of the file at the other end."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dependency_heat(edges: DataFrame, heat: DataFrame) -> DataFrame:
    """Import edges with the heat of importer and target.

    Edges stay rows: the importers of a hot file are never gathered into one list, and
    adaptive execution splits the join of its rows.
    """
    scored = heat.select("repo_id", "path", "heat_score")
    importer = scored.withColumnsRenamed({"path": "imported_by", "heat_score": "importer_heat"})
    named = edges.select("repo_id", "imported_by", "path", "match")
    with_target = named.join(scored, ["repo_id", "path"], "left")
    return (
        with_target.join(importer, ["repo_id", "imported_by"], "left")
        .na.fill(0, ["heat_score", "importer_heat"])
    )
