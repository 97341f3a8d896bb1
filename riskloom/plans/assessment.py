"""Impact assessment around a model call that happens outside the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskloom.operators import assessments as ops
from riskloom.sources.staging import stage


@dataclass(frozen=True)
class Ingested:
    assessments: DataFrame
    rejects: DataFrame
    parsed: DataFrame


def ingest_responses(answers: DataFrame, cache: DataFrame) -> Ingested:
    """Read the model's answers and merge them with the cache.

    Parsing is staged once: accepted, rejected and counters read the same rows.
    """
    parsed = stage(ops.parse_responses(answers), "parsed")
    return Ingested(
        assessments=ops.merge_assessments(cache, ops.accepted(parsed)),
        rejects=ops.rejected(parsed),
        parsed=parsed,
    )
