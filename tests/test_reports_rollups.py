import pytest
from pyspark.sql import functions as F

from riskloom.operators import reports, rollups
from riskloom.operators.heat import HEAT_COLUMNS, flatten_heat, nest_heat, score_files
from riskloom.settings import Settings, TierThresholds

TREE = [("cmd/main.go", 10, "low", 50), ("internal/auth/jwt.go", 95, "critical", 200),
        ("internal/auth/session.go", 72, "high", 150), ("internal/api/handler.go", 45, "medium", 100),
        ("pkg/utils/format.go", 5, "low", 30)]


@pytest.fixture(scope="module")
def heat(spark):
    rows = [("r", *t, t[1] > 50, "sum" if t[1] > 90 else "", t[2] == "low", 5 if t[2] == "low" else 60)
            for t in TREE]
    rows.append(("q", "main.go", 50, "medium", 1, False, "", False, 20))
    return spark.createDataFrame(rows, (
        "repo_id string, path string, heat_score int, tier string, lines bigint, assessed boolean,"
        " summary string, auto_merge boolean, estimated_review_time_minutes int")).withColumns({
            "language": F.lit("Go"), "import_count": F.lit(3).cast("bigint"),
            "security_impact": F.col("heat_score"), "data_impact": F.lit(0),
            "availability_impact": F.lit(0), "user_impact": F.lit(0), "critical_reason": F.lit(""),
            "min_reviewers": F.lit(1), "cyclomatic": F.lit(2).cast("bigint")})


def paths_of(df):
    return [r.path for r in df.collect()]


def test_lists(heat):
    rows = reports.list_files(heat, limit=2).collect()
    assert [(r.repo_id, r.path, r["count"], r.truncated) for r in rows] == [
        ("q", "main.go", 1, False), ("r", "internal/auth/jwt.go", 2, True),
        ("r", "internal/auth/session.go", 2, True)]
    assert rows[1].reason == "sum"
    assert len(reports.list_files(heat).collect()) == 6
    assert paths_of(reports.list_files(heat, tier="low")) == ["cmd/main.go", "pkg/utils/format.go"]
    with pytest.raises(ValueError):
        reports.list_files(heat, tier="warm")


def test_reports(heat):
    counts = {r.repo_id: r for r in reports.tier_counts(heat).collect()}
    assert (counts["r"].critical, counts["r"].low, counts["q"].high, counts["q"].total) == (1, 2, 0, 1)
    hours = {r.repo_id: (r.minutes, r.hours) for r in reports.review_hours(heat).collect()}
    assert hours == {"r": (190, 190 / 60), "q": (20, 20 / 60)}
    rows = [(r.tier, r.path, r.more) for r in reports.tier_report(heat, 1).filter("repo_id = 'r'").collect()]
    assert rows[0] == ("critical", "internal/auth/jwt.go", 0) and rows[-1] == ("low", "cmd/main.go", 1)
    assert reports.tier_report(heat, 0).count() == 6
    assert {r.path for r in reports.action_items(heat, 2).filter("repo_id = 'r'").collect()} \
        == {"internal/auth/jwt.go", "internal/auth/session.go"}
    bars = {(r.repo_id, r.tier): r.width for r in reports.tier_bars(heat).collect()}
    assert bars["r", "low"] == 100.0 and bars["r", "high"] == 50.0 and bars["q", "low"] == 0.0


def test_lookups(heat):
    one = reports.get_file(heat, "r", "internal/auth/jwt.go").collect()[0]
    assert (one.label, one.breakage_impact, one.needs_human_review, one.reason) == ("CRITICAL", 3, True, "sum")
    assert reports.get_file(heat, "q", "internal/auth/jwt.go").count() == 0
    assert paths_of(reports.suggest_paths(heat, "r", "auth")) \
        == ["internal/auth/jwt.go", "internal/auth/session.go"]
    facts = reports.file_facts(heat)
    assert {r.path: r.lines for r in facts.collect()}["main.go"] == 10
    assert paths_of(reports.search_facts(facts, query="SUM")) == ["internal/auth/jwt.go"]
    assert paths_of(reports.search_facts(facts, tier="high", under="internal")) \
        == ["internal/auth/session.go"]
    assert len(paths_of(reports.at_or_above(heat, "high"))) == 2
    bands = {r.path: r.security_band for r in reports.impact_bands(heat).collect()}
    assert bands == {"internal/auth/jwt.go": "critical", "internal/auth/session.go": "high"}


def test_tree(heat):
    tree = heat.filter("repo_id = 'r'")
    nodes = rollups.tree_nodes(tree)
    assert nodes.count() == 11 and nodes.filter("is_dir").count() == 6
    assert all(r.depth == len(r.path.split("/")) for r in nodes.collect())
    top = [r.name for r in rollups.sort_tree(nodes.filter("parent = '.'")).collect()]
    assert top == ["internal", "cmd", "pkg"]
    assert [r.name for r in rollups.sort_tree(nodes.filter("parent = '.'"), "name").collect()] \
        == ["cmd", "internal", "pkg"]
    assert [r.name for r in rollups.sort_tree(nodes.filter("parent = 'internal/auth'"), "size").collect()] \
        == ["jwt.go", "session.go"]
    with pytest.raises(ValueError):
        rollups.sort_tree(nodes, "age")
    assert {r.dir: r.max_heat for r in rollups.dir_rollup(tree).collect()}["internal"] == 95
    kept = rollups.filter_tree(tree, ["critical"])
    assert sorted(paths_of(kept)) == ["internal", "internal/auth", "internal/auth/jwt.go"]
    assert rollups.filter_tree(tree.filter("tier = 'low'"), ["critical"]).count() == 0
    assert paths_of(rollups.search_tree(tree, "JWT")) == ["internal/auth/jwt.go"]
    assert [(r.name, r.is_dir) for r in rollups.search_tree(tree, "auth").collect()] == [("auth", True)]
    assert rollups.search_tree(tree, "nonexistent").count() == 0
    assert [r.path for r in rollups.tree_nodes(heat.filter("repo_id = 'q'")).collect()] == ["main.go"]


def test_rollups(heat):
    counts = {r.dir: r for r in rollups.dir_tier_counts(heat).filter("repo_id = 'r'").collect()}
    assert (counts["internal"].critical, counts["internal"].high, counts["internal"].tier) == (1, 1, "critical")
    explorer = {r.dir: (r.tier, r.files, r.parent) for r in rollups.explorer_dirs(heat).collect()}
    assert explorer["internal/auth"] == ("critical", 2, "internal")
    modules = rollups.module_rollup(heat.filter("repo_id = 'r'")).collect()
    assert [(r.module, r.total_weight) for r in modules][0] == ("internal/auth", 350.0)
    inside = rollups.module_rollup(heat, weight="heat", under="internal/auth").collect()
    assert [(r.module, r.total_weight, r.tier) for r in inside] \
        == [("internal/auth", 902.5 + 518.4, "critical")]
    cold = rollups.module_rollup(heat.withColumns({"heat_score": F.lit(0), "tier": F.lit("high")}))
    assert {r.tier for r in cold.collect()} == {"low"}


@pytest.fixture(scope="module")
def scored(spark):
    metrics = spark.sql("""SELECT 'r' AS repo_id, p AS path, 'Go' AS language, 10L AS lines, 99L AS bytes,
        p AS content_hash, 1L AS function_count, 2L AS exported_symbols, 20L AS cyclomatic, 0L AS cognitive
        FROM VALUES ('src/auth/a.go'), ('b.go'), ('c_test.go') AS t(p)""")
    history = spark.sql("SELECT 'r' AS repo_id, 'b.go' AS path, 3L AS commit_count, 0L AS commits_last_90d,"
                        " 1L AS unique_authors, 0 AS churn_score")
    incidents = spark.sql("SELECT 'r' AS repo_id, 'b.go' AS path, 1L AS incident_count, 40 AS incident_score,"
                          " timestamp'2024-01-01' AS last_incident, 0L AS sev_critical, 0L AS sev_high,"
                          " 0L AS sev_medium, 1L AS sev_low")
    centrality = spark.sql("SELECT 'r' AS repo_id, 'b.go' AS path, 9L AS import_count, 1.0D AS centrality")
    assessed = spark.sql("SELECT p AS content_hash, 90 AS security_impact, 1 AS data_impact,"
                         " 2 AS availability_impact, 3 AS user_impact, 's' AS blast_radius_summary,"
                         " 'c' AS critical_reason FROM VALUES ('b.go'), ('c_test.go') AS t(p)")
    annotations = spark.sql("SELECT 'r' AS repo_id, p AS path, o AS override_tier FROM VALUES"
                            " ('c_test.go', 'critical'), ('b.go', 'odd') AS t(p, o)")
    return lambda **extra: score_files(metrics, history, incidents, centrality, **extra), assessed, annotations


def test_assembly(scored):
    score, assessed, annotations = scored
    plain = {r.path: r for r in score().collect()}
    # centrality 100*20, complexity 50*15, coverage 50*10, incidents 40*25, churn 0*10 of 115
    assert plain["b.go"].heat_score == int((2000 + 750 + 500 + 1000) / 115)
    assert plain["src/auth/a.go"].heat_score == int((30 * 20 + 40 * 15 + 750 + 500) / 80)
    full = {r.path: r for r in score(assessments=assessed, annotations=annotations).collect()}
    # blast 90*40, centrality 1500, complexity 750, coverage 500, incidents 400, churn 0 of 100
    assert (full["b.go"].heat_score, full["b.go"].tier, full["b.go"].summary) == (67, "high", "s")
    assert not full["c_test.go"].assessed and full["c_test.go"].tier == "critical"
    assert full["c_test.go"].min_reviewers == 2 and full["c_test.go"].security_impact == 0
    low = {r.tier for r in score(settings=Settings(tiers=TierThresholds(101, 101, 101))).collect()}
    assert low == {"low"}


def test_coverage(spark, scored):
    score, *_ = scored
    coverage = spark.sql("SELECT 'r' AS repo_id, 'b.go' AS path, 90.0D AS coverage_percent, 4L AS test_count,"
                         " false AS has_integration_tests")
    got = {r.path: (r.coverage_score, r.test_count) for r in score(coverage=coverage).collect()}
    assert got == {"b.go": (10, 4), "src/auth/a.go": (50, 0), "c_test.go": (50, 0)}


def test_nested_round_trip(scored):
    score, assessed, _ = scored
    heat = score(assessments=assessed)
    assert flatten_heat(nest_heat(heat)).columns == HEAT_COLUMNS
    assert sorted(flatten_heat(nest_heat(heat)).collect()) == sorted(heat.collect())
