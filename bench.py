"""Headline queries on one folder of tables; prints one JSON line.

The engine's inputs (commit log, file metrics, pull-request files, ...) are derived from
the given tables first and written as tables; that step is reported apart, as
``bind_inputs_sec``, because it is not the engine's work.
Reports, rollups and pull requests read a saved scored table, as they do in use; the
queries that compute it are timed by themselves (``file_heat``, ``source_heat``, ...).
Every query runs once to warm up and once timed, written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from riskloom.sources.staging import stage
from verification.bindings import staged_view
from verification.queries import Inputs, all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INPUTS = ["source_files", "code_files", "doc_commits", "doc_incidents", "commit_files", "incidents",
          "file_metrics", "import_refs", "pr_files", "responses", "numstat"]
HEADLINE = ["language_counts", "path_risk_flags", "text_metrics_python", "text_metrics_js",
            "text_metrics_generic", "text_metrics_go", "file_history", "recent_changes",
            "incident_rollup", "import_edges", "centrality", "file_heat", "file_heat_assessed",
            "source_heat", "list_files", "tier_report", "action_items", "pr_file_risk", "pr_risk",
            "assessment_plan", "assessments", "dir_rollup", "module_rollup", "numstat"]


_saved = {}


def saved(inputs: Inputs, name: str, build):
    if name not in _saved:
        _saved[name] = stage(build(), name)
    return _saved[name]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    Inputs.bind = staticmethod(staged_view)
    Inputs.saved = saved
    start = time.perf_counter()
    for name in INPUTS:
        getattr(Inputs(spark, SF_DIR), name)
    bound = round(time.perf_counter() - start, 3)
    known = all_queries()
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "bind_inputs_sec": bound, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
