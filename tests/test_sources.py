import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.operators import assessments as ops
from riskloom.plans.analysis import analyze
from riskloom.plans.assessment import ingest_responses
from riskloom.sources import readers, writers
from riskloom.sources.staging import shared_dir, stage


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    for name, text in {
        "a/main.go": "package main\n\nfunc main() {}\n", "a/pkg/__init__.py": "import os\n",
        "a/pkg/_util.py": "from pkg import x\n", "a/.hidden/skip.go": "package x\n", "a/.dot.py": "x\n",
        "a/README.md": "# x\n", "a/node_modules/m.js": "x", "a/env1/e.py": "x",
        "b/src/lib.rs": "pub fn f() {}\n",
    }.items():
        put(root / name, text)
    return {"A": str(root / "a"), "B": str(root / "b")}


def test_source_tree(spark, trees):
    files = readers.read_source_tree(spark, trees, tasks=3)
    assert files.schema == schemas.SOURCE_FILES
    got = {(r.repo_id, r.path): r.content for r in files.collect()}
    assert set(got) == {("A", "main.go"), ("A", "pkg/__init__.py"), ("A", "pkg/_util.py"), ("A", ".dot.py"),
                        ("B", "src/lib.rs")}
    assert got["A", "pkg/__init__.py"] == "import os\n"


def test_analyze_from_tree(spark, trees, tmp_path):
    files = readers.read_source_tree(spark, trees, tasks=2)
    commits = spark.createDataFrame([], schemas.COMMIT_FILES)
    incidents = spark.createDataFrame([], schemas.INCIDENTS)
    result = analyze(files, commits, incidents, "2024-01-01")
    rows = {r.path: r for r in result.heat.collect()}
    assert rows["pkg/__init__.py"].import_count == 2 and rows["pkg/__init__.py"].centrality == 1.0
    assert rows["main.go"].function_count == 1 and rows["main.go"].commit_count == 0
    assert {(r.path, r.imported_by) for r in result.edges.collect()} \
        == {("pkg/__init__.py", "pkg/_util.py")}

    path = str(tmp_path / "heat")
    writers.write_heat(result.heat, path)
    assert sorted(readers.read_heat(spark, path).collect()) == sorted(result.heat.collect())
    writers.write_heat_json(result.heat, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {x["path"] for x in lines} == set(rows)
    assert lines[0]["factors"]["incident_history"]["severity_breakdown"] \
        == {"critical": 0, "high": 0, "medium": 0, "low": 0}
    texts = writers.heat_json(result.heat).collect()
    assert {json.loads(r.json)["path"] for r in texts} == set(rows)


def test_incident_log(spark, tmp_path):
    log = tmp_path / "incidents.json"
    assert readers.read_incidents(spark, str(log), "r").count() == 0
    put(log, json.dumps([
        {"id": "INC-2031-007", "file": "a.go", "date": "2031-02-03", "severity": "high",
         "description": "x", "users_affected": 12, "unknown": 1},
        {"id": "INC-2031-008", "file": "a.go", "date": "2031-04-05T06:07:08Z", "severity": "low",
         "description": "y"}], indent=2))
    rows = readers.read_incidents(spark, str(log), "r").orderBy("id").collect()
    assert [(r.repo_id, str(r.date), r.users_affected) for r in rows] \
        == [("r", "2031-02-03 00:00:00", 12), ("r", "2031-04-05 06:07:08", None)]
    put(log, "not json")
    with pytest.raises(Exception):
        readers.read_incidents(spark, str(log), "r").collect()


def test_incident_append(spark, tmp_path):
    log = str(tmp_path / "log")
    raw = "repo_id string, file string, severity string, description string, date string"
    first = spark.createDataFrame([("r", "a", "high", "x", "2024-01-01"), ("r", "b", "extreme", "x", "")], raw)
    rejected = writers.append_incidents(
        first, log, spark.createDataFrame([], schemas.INCIDENTS), "2024-06-30")
    assert [r.file for r in rejected.collect()] == ["b"]
    second = spark.createDataFrame([("r", "c", "low", "x", ""), ("r", "a", "low", "z", "2023-01-01")], raw)
    writers.append_incidents(second, log, spark.read.parquet(log), "2024-06-30")
    got = {(r.file, r.severity): r.id for r in spark.read.parquet(log).collect()}
    assert got == {("a", "high"): "INC-2024-001", ("a", "low"): "INC-2023-002", ("c", "low"): "INC-2024-003"}


def test_annotations(spark, tmp_path):
    assert readers.read_annotations(spark, str(tmp_path / "none.json"), "r").count() == 0
    put(tmp_path / "map.json", json.dumps({"a.go": {"override_tier": "high", "tags": ["x", "y"]}}))
    put(tmp_path / "list.json", json.dumps([{"repo_id": "q", "path": "b.go", "owner": "o"}]))
    one = readers.read_annotations(spark, str(tmp_path / "map.json"), "r").collect()
    assert [(r.repo_id, r.path, r.override_tier, r.tags) for r in one] == [("r", "a.go", "high", ["x", "y"])]
    two = readers.read_annotations(spark, str(tmp_path / "list.json")).collect()
    assert [(r.repo_id, r.path, r.owner) for r in two] == [("q", "b.go", "o")]


def test_numstat_folders(spark, tmp_path):
    put(tmp_path / "repo_id=r" / "pr_number=7" / "diff.txt", "1\t2\ta.go\n-\t-\tb.png\n")
    got = {tuple(r) for r in readers.read_numstat(spark, str(tmp_path)).select(
        "repo_id", "pr_number", "path", "lines_added", "lines_deleted").collect()}
    assert got == {("r", 7, "a.go", 1, 2), ("r", 7, "b.png", 0, 0)}
    single = readers.read_numstat(spark, str(tmp_path / "repo_id=r" / "pr_number=7"), "q", 1)
    assert {(r.repo_id, r.pr_number) for r in single.collect()} == {("q", 1)}


def test_assessment_cache(spark, tmp_path):
    assert readers.read_assessment_cache(spark, str(tmp_path / "none")).count() == 0
    cache = tmp_path / "cache"
    put(cache / "abc123.json", json.dumps({"security_impact": 85, "data_impact": 60,
                                           "blast_radius_summary": "Auth", "content_hash": "abc123"}, indent=2))
    put(cache / "corrupt.json", "not json")
    put(cache / "badtype.json", '{"security_impact": "x"}')
    rows = readers.read_assessment_cache(spark, str(cache)).collect()
    assert [(r.content_hash, r.security_impact, r.user_impact, r.blast_radius_summary) for r in rows] \
        == [("abc123", 85, 0, "Auth")]


def test_ingest(spark, tmp_path):
    cache = spark.createDataFrame([("x", 1, 1, 1, 1, "old", "")], schemas.ASSESSMENTS)
    answers = spark.createDataFrame([("x", '{"security_impact":7}'), ("y", "?"), ("z", '{"user_impact":3}')],
                                    "content_hash string, text string")
    done = ingest_responses(answers, cache)
    assert {r.content_hash: r.security_impact for r in done.assessments.collect()} == {"x": 7, "z": 0}
    assert [r.content_hash for r in done.rejects.collect()] == ["y"]
    path = str(tmp_path / "assessments")
    writers.append_assessments(ops.accepted(done.parsed), path, batch=1)
    assert readers.read_assessments(spark, path).count() == 2
    again = answers.withColumn("text", F.lit('{"security_impact":8}'))
    writers.append_assessments(ops.accepted(ops.parse_responses(again)), path, batch=2)
    assert {r.content_hash: r.security_impact for r in readers.read_assessments(spark, path).collect()} == {"x": 8, "y": 8, "z": 8}
    # One row per content and no aggregate over batches; an older batch cannot come later.
    read = readers.read_assessments(spark, path)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 3 and "Aggregate" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        writers.append_assessments(ops.accepted(done.parsed), path, batch=1)
    # The same batch again changes nothing.
    writers.append_assessments(ops.accepted(ops.parse_responses(again)), path, batch=2)
    assert readers.read_assessments(spark, path).count() == 3


def test_heat_document(spark, tmp_path):
    path = tmp_path / "doc.json"
    put(path, json.dumps({
        "version": "1.0.0", "metadata": {"repo_path": "/x", "total_files": 1, "languages": {"Go": 1}},
        "files": {"main.go": {
            "path": "main.go", "heat_score": 75, "tier": "high", "language": "Go",
            "size": {"lines": 10, "bytes": 100},
            "factors": {"incident_history": {"score": 40, "incident_count": 1,
                                             "severity_breakdown": {"high": 1}},
                        "blast_radius": {"score": 80, "summary": "s", "assessed": True}},
            "review_requirements": {"min_reviewers": 2}}},
        "incidents": [], "annotations": {}}, indent=1))
    rows = readers.read_heat_document(spark, str(path), "r").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.repo_id, r.path, r.heat_score, r.tier, r.lines, r.sev_high, r.sev_low, r.summary,
            r.min_reviewers, r.commit_count) == ("r", "main.go", 75, "high", 10, 1, 0, "s", 2, 0)
    with pytest.raises(AnalysisException):
        readers.read_heat_document(spark, str(tmp_path / "none.json"), "r")
    put(path, "not json")
    with pytest.raises(Exception):
        readers.read_heat_document(spark, str(path), "r").collect()


def test_facts(spark, tmp_path):
    facts = spark.range(3).withColumn("tier", F.lit("low"))
    writers.write_facts(facts, str(tmp_path / "facts"))
    assert spark.read.schema(facts.schema).json(str(tmp_path / "facts")).count() == 3


def test_staging(spark):
    stage(spark.range(1), "first")
    before = set(os.listdir(shared_dir(spark)))
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark))


def test_staging_keeps_no_shuffle_files(spark):
    """What a written table shuffled is gone when it is written, and the setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before = shuffled()
    rows = stage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")), "grouped")
    assert not shuffled() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert sorted(map(tuple, rows.collect())) == [(k, 100) for k in range(10)]


def test_a_saved_result_is_compressed(spark, tmp_path):
    """A part of a result takes a fraction of its JSON lines, in files of bounded rows, and
    reads back whole."""
    path = str(tmp_path / "result")
    heat = spark.createDataFrame([], schemas.HEAT)
    runs = spark.createDataFrame([("r", "/r", None, "c", "main")], "repo_id string, repo_path string, analyzed_at timestamp, commit_sha string, branch string")
    edges = spark.range(0, 250_000, 1, 1).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("src/p"), "id").alias("path"), F.lit("src/a.go").alias("imported_by"), F.lit("exact").alias("match"))
    writers.write_result(path, heat, runs, edges=edges)
    parts = [p for p in (tmp_path / "result" / "dependencies").iterdir() if p.name.startswith("part-")]
    size = edges.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert len(parts) == 3 and sum(p.stat().st_size for p in parts) < size / 5
    back = readers.read_result(spark, path)
    assert back["dependencies"].exceptAll(edges).isEmpty() and back["dependencies"].count() == 250_000
    assert [r.repo_id for r in back["metadata"].collect()] == ["r"] and back["files"].isEmpty()
