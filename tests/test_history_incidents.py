import random
from datetime import datetime, timedelta

from riskloom.operators import history, incidents
from riskloom.settings import Settings

COMMITS = "repo_id string, sha string, path string, author string, ts timestamp, message string"
INCIDENTS = "repo_id string, file string, date timestamp, severity string"
NOW = datetime(2024, 6, 30)


def commit(path, sha, days, author="a", message="m", repo="r"):
    return (repo, sha, path, author, NOW - timedelta(days=days), message)


def test_history(spark):
    rows = [commit("a", "1", 1), commit("a", "2", 89, "b"), commit("a", "3", 90), commit("a", "4", 400, "b"),
            commit("b", "5", 1000), commit("a", "6", 1, repo="q")]
    got = {(r.repo_id, r.path): (r.commit_count, r.commits_last_90d, r.unique_authors, r.churn_score)
           for r in history.file_history(spark.createDataFrame(rows, COMMITS), "2024-06-30").collect()}
    assert got == {("r", "a"): (4, 2, 2, 1), ("r", "b"): (1, 0, 1, 0), ("q", "a"): (1, 1, 1, 0)}


def test_recent_changes(spark):
    rows = [commit("a", f"{i:02d}abcdefgh", i) for i in range(15)]
    rows += [commit("b", "x", 366), commit("c", "bb", 5, message="Fix (#7)\nbody"), commit("c", "aa", 5)]
    changes = history.recent_changes(spark.createDataFrame(rows, COMMITS), "2024-06-30")
    got = {}
    for r in sorted(changes.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.path, []).append(r)
    assert [r.sha for r in got["a"]] == [f"{i:02d}abcde" for i in range(10)]
    assert "b" not in got
    assert [(r.sha, r.pr_number, r.had_incident, r.message) for r in got["c"]] \
        == [("aa", None, False, "m"), ("bb", 7, True, "Fix (#7)")]
    lists = {r.path: r.recent_changes for r in history.recent_changes_list(changes).collect()}
    assert [c.sha for c in lists["a"]] == [r.sha for r in got["a"]]
    assert history.latest_changes(changes).filter("path = 'a'").count() == 5


def test_many_recent_changes_of_one_file(spark):
    """More ranks than are limited before a shuffle: cut in hashed parts first."""
    rows = [commit("a", f"{i:05d}", i % 300) for i in range(3000)]
    settings = Settings(recent_changes=1500)
    changes = history.recent_changes(spark.createDataFrame(rows, COMMITS), "2024-06-30", settings)
    got = [r.date for r in changes.orderBy("rank").collect()]
    assert len(got) == 1500
    assert got == sorted((r[4] for r in rows), reverse=True)[:1500]


def score(spark, rows):
    df = spark.createDataFrame([("r", "f", d, s) for d, s in rows], INCIDENTS)
    return incidents.incident_rollup(df, "2024-06-30").collect()[0]


def test_incident_rollup(spark):
    day = timedelta(days=1)
    r = score(spark, [(NOW - 30 * day, "high"), (NOW - 60 * day, "high")])
    assert (r.incident_score, r.incident_count, r.sev_high, r.last_incident) \
        == (70, 2, 2, NOW - 30 * day)
    assert score(spark, [(NOW - 30 * day, "medium")]).incident_score == 42
    assert score(spark, [(NOW - 180 * day, "medium")]).incident_score == 22
    assert score(spark, [(NOW - 90 * day, "low")]).incident_score == 20
    assert score(spark, [(NOW - 90 * day + timedelta(seconds=1), "low")]).incident_score == 40
    assert score(spark, [(NOW + 5 * day, "odd")]).incident_score == 40
    assert score(spark, [(NOW, "critical")] * 20).incident_score == 100


RAW = "repo_id string, file string, severity string, description string, date string"


def test_prepare_and_number(spark):
    rows = [("r", "a", "high", "x", "2024-05-01"), ("r", "b", "extreme", "x", "2024-05-01"),
            ("r", "c", "low", "x", "May 1"), ("r", "d", "low", "", "2024-05-01"),
            ("r", "e", "low", "x", ""), ("r", "f", "low", "x", None), ("q", "g", "low", "x", "2023-02-03"),
            ("r", "h", "low", "x", "2024-02-31"), ("r", "i", None, "x", "2024-05-01")]
    good, bad = incidents.split_incidents(
        incidents.prepare_incidents(spark.createDataFrame(rows, RAW), "2024-06-30"))
    assert {r.file: r.error.split()[0] for r in bad.collect()} \
        == {"b": "severity", "c": "date", "d": "file,", "h": "date", "i": "file,"}
    existing = spark.createDataFrame([("r", "x", NOW, "low")] * 7, INCIDENTS)
    got = {r.file: r.id for r in incidents.number_incidents(good, existing).collect()}
    assert got["a"] == "INC-2024-008" and got["g"] == "INC-2023-001"
    assert {got["e"], got["f"]} == {"INC-2024-009", "INC-2024-010"}


def test_numbers_are_complete(spark):
    """A repository with most rows, equal dates and exact copies still counts 1..n."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"r{rng.randint(0, 5)}", f"f{rng.randint(0, 9)}", "low",
             "same" if rng.random() < 0.5 else str(i), f"2024-01-0{rng.randint(1, 3)}")
            for i in range(2000)]
    prepared = incidents.prepare_incidents(spark.createDataFrame(rows, RAW), "2024-06-30")
    good, _ = incidents.split_incidents(prepared)
    numbered = incidents.number_incidents(good, spark.createDataFrame([], INCIDENTS)).collect()
    by_repo = {}
    for r in numbered:
        by_repo.setdefault(r.repo_id, []).append((int(r.id.rsplit("-", 1)[1]), r.date))
    assert len(numbered) == len(rows)
    for found in by_repo.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1))
        dates = [d for _, d in found]
        assert dates == sorted(dates)


def test_lookups(spark):
    df = spark.createDataFrame([("r", "a", NOW, "low"), ("r", "a", NOW, "high"), ("r", "b", NOW, "low"),
                                ("q", "a", NOW, "low")], INCIDENTS)
    assert incidents.for_file(df, "r", "a").count() == 2
    assert {r.repo_id: r.incidents for r in incidents.counts(df).collect()} == {"r": 3, "q": 1}
    assert [r.repo_id for r in incidents.listed(df).collect()] == ["q", "r", "r", "r"]
