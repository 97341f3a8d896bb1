import pytest

from riskloom.operators import pull_requests as prs
from riskloom.plans.review import score_prs
from riskloom.settings import BreakerLimits, Settings

HEAT = "repo_id string, path string, heat_score int, tier string, language string, assessed boolean, summary string"
CHANGES = "repo_id string, pr_number bigint, path string, lines_added bigint, lines_deleted bigint"


@pytest.fixture(scope="module")
def heat(spark):
    return spark.createDataFrame([
        ("r", "src/auth/jwt.go", 95, "critical", "Go", True, "tokens"),
        ("r", "src/api/handler.go", 45, "medium", "Go", False, ""),
        ("r", "src/utils/format.go", 5, "low", "Go", False, ""),
        ("r", "a.py", 10, "low", "Python", False, ""), ("r", "a.ts", 10, "low", "TypeScript", False, ""),
        ("r", "a.rs", 70, "high", "Rust", False, ""),
    ], HEAT)


def verdicts(spark, heat, rows, settings=Settings(), descriptions=None):
    changes = spark.createDataFrame([("r", *row) for row in rows], CHANGES)
    return {r.pr_number: r for r in score_prs(changes, heat, settings, descriptions).verdicts.collect()}


def test_verdicts_and_signals(spark, heat):
    got = verdicts(spark, heat, [
        (1, "src/auth/jwt.go", 10, 5), (1, "src/utils/format.go", 3, 1),
        (2, "src/utils/format.go", 10, 5),
        (3, "unknown.go", 10, 5),
        (4, "src/utils/format.go", 300, 250),
        (5, "src/api/handler.go", 100, 0), (5, "handler_test.go", 50, 0),
        (6, "src/api/handler.go", 100, 0),
        (7, "a_test.go", 100, 0), (8, "a.png", 0, 0),
        (9, "a.py", 1, 0), (9, "a.ts", 1, 0), (9, "a.rs", 1, 0), (9, "src/auth/jwt.go", 1, 0),
        (9, "test_x.py", 4, 0),
        (10, "src/api/handler.go", 10, 0), (10, "test_x.py", 3, 0),
    ])
    assert (got[1].heat_score, got[1].tier, got[1].min_reviewers, got[1].blocked) == (95, "critical", 2, True)
    assert (got[2].tier, got[2].auto_merge, got[2].blocked) == ("low", True, False)
    assert (got[3].heat_score, got[3].tier) == (0, "low")
    assert got[4].signals == ["Large diff (>500 lines)", "Low test ratio (<0.3)"]
    assert got[5].signals == [] and got[6].signals == ["Low test ratio (<0.3)"]
    assert got[7].signals == [] and got[8].signals == []
    assert got[9].signals == ["Many languages (>3)"] and got[9].languages == 4
    assert got[10].signals == []  # 3/10 is not below 0.3


def test_files(spark, heat):
    changes = spark.createDataFrame([("r", 1, "src/auth/jwt.go", 1, 2), ("r", 1, "new.go", 3, 4)], CHANGES)
    rows = prs.hottest_first(score_prs(changes, heat).files).collect()
    assert [(r.path, r.heat_score, r.tier, r.reason, r.needs_attention, r.is_new) for r in rows] \
        == [("src/auth/jwt.go", 95, "critical", "tokens", True, False), ("new.go", 0, "low", "", False, False)]


def test_descriptions_and_limits(spark, heat):
    descriptions = spark.createDataFrame(
        [("r", 1, "why"), ("r", 2, "  "), ("r", 3, None)],
        "repo_id string, pr_number bigint, description string")
    rows = [(1, "a.py", 20, 0), (2, "a.py", 1, 0), (4, "a.py", 1, 0)]
    got = verdicts(spark, heat, rows, Settings(breakers=BreakerLimits(10, 3, 0.0, True)), descriptions)
    assert got[1].signals == ["Large diff (>10 lines)"]
    assert got[2].signals == ["No description"] == got[4].signals
    assert (got[3].files_changed, got[3].tier, got[3].signals) == (0, "low", ["No description"])
    quiet = Settings(breakers=BreakerLimits(1000, 3, 0.0, False))
    assert verdicts(spark, heat, rows, quiet, descriptions)[2].signals == []


def test_numstat(spark):
    lines = ["10\t5\tsrc/a.go", "-\t-\timage.png", "bad", "", "1 2", "  3   4  b c.go  ", "x\t7\tq.go"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in prs.parse_numstat(df).collect()]
    assert got == [("src/a.go", 10, 5), ("image.png", 0, 0), ("b", 3, 4), ("q.go", 0, 7)]


def test_signal_rows(spark, heat):
    changes = spark.createDataFrame([("r", 4, "a.py", 600, 0)], CHANGES)
    rows = prs.pr_signals(score_prs(changes, heat).verdicts).collect()
    assert sorted((r.pos, r.signal) for r in rows) \
        == [(0, "Large diff (>500 lines)"), (1, "Low test ratio (<0.3)")]


def test_hot_file_and_hot_pr(spark, heat):
    """One file in every pull request, one pull request with most of the rows."""
    rows = [(n, "src/auth/jwt.go", 1, 0) for n in range(100)]
    rows += [(7, f"gen/f{i}.go", 1, 1) for i in range(2000)]
    got = verdicts(spark, heat, rows)
    assert len(got) == 100 and all(r.heat_score == 95 for r in got.values())
    assert (got[7].files_changed, got[7].total_lines) == (2001, 4001)
