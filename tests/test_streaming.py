from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.pull_requests import parse_numstat
from riskloom.sources import keyed as state
from riskloom.streaming import churn, review
from verification import queries

START = datetime(2024, 1, 1)


def test_daily_churn(spark, tmp_path):
    rows = [("r", f"f{i % 2}", START + timedelta(hours=i)) for i in range(24 * 5 + 1)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "repo_id string, path string, ts timestamp").write.parquet(source)
    stream = spark.readStream.schema("repo_id string, path string, ts timestamp").parquet(source)
    out = str(tmp_path / "out")
    churn.daily_churn(stream).writeStream.format("parquet") \
        .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True) \
        .start(out).awaitTermination()
    daily = spark.read.schema("repo_id string, path string, day timestamp, commits bigint").parquet(out)
    # The last event is at the start of day 5; a day less for lateness closes days 0 to 3.
    assert sorted((r.day, r.path, r.commits) for r in daily.collect()) \
        == sorted((START + timedelta(days=d), f"f{k}", 12) for d in range(4) for k in range(2))
    recent = {r.path: r.commits_last_90d for r in churn.recent_commits(daily, "2024-04-01").collect()}
    assert recent == {"f0": 36, "f1": 36}  # 90 days before is 2 January


def test_open_days_and_late_commits_count(spark, tmp_path):
    schema = "repo_id string, path string, ts timestamp"
    feed, out, log = (str(tmp_path / n) for n in ("feed", "out", "log"))

    def push(hours):
        rows = [("r", f"f{i % 2}", START + timedelta(hours=i)) for i in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        churn.count_stream(spark.readStream.schema(schema).parquet(feed), out, log).awaitTermination()
        return {(r.day, r.path): r.commits for r in churn.day_counts(spark, out).collect()}

    got = push(range(24 * 5 + 1))
    assert got == {(START + timedelta(days=d), f"f{k}"): 12 for d in range(5) for k in range(2)} | {(START + timedelta(days=5), "f0"): 1}
    # A second batch, with one more commit of the open day and one that is four days late.
    got = push([24 * 5 + 2, 2])
    assert got[START + timedelta(days=5), "f0"] == 2 and got[START, "f0"] == 13 and sum(got.values()) == 123
    recent = {r.path: r.commits_last_90d for r in churn.recent_commits(churn.day_counts(spark, out), "2024-04-01").collect()}
    assert recent == {"f0": 50, "f1": 48}


def test_pull_requests_across_batches(spark, tmp_path):
    heat = spark.createDataFrame(
        [("r", "hot.go", 90, "critical", "Go", False, "")],
        "repo_id string, path string, heat_score int, tier string, language string,"
        " assessed boolean, summary string")
    schema = "repo_id string, pr_number bigint, value string"
    feed, out, log = (str(tmp_path / n) for n in ("feed", "out", "log"))

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        lines = spark.readStream.schema(schema).parquet(feed)
        review.score_stream(parse_numstat(lines), lambda s: heat, out, log).awaitTermination()

    push([("r", 1, "1\t1\tcold.go"), ("r", 2, "600\t0\thot.go")])
    push([("r", 1, "1\t1\thot.go")])
    verdicts = review.verdicts(spark, out)
    got = {r.pr_number: (r.tier, r.signals) for r in verdicts.collect()}
    assert {r.pr_number: r.files_changed for r in verdicts.collect()} == {1: 2, 2: 1}
    assert got[1] == ("critical", ["Low test ratio (<0.3)"])
    assert got[2] == ("critical", ["Large diff (>500 lines)", "Low test ratio (<0.3)"])
    assert verdicts.filter(F.col("blocked")).count() == 2
    # The other half of a diff, and a file that comes again with other numbers.
    push([("r", 2, "900\t0\tcold_test.go"), ("r", 1, "2\t0\thot.go")])
    got = {r.pr_number: (r.total_lines, r.signals) for r in review.verdicts(spark, out).collect()}
    assert got[2] == (1500, ["Large diff (>500 lines)"]) and got[1][0] == 4


def test_a_batch_reads_and_rewrites_its_own_parts(spark, tmp_path, monkeypatch):
    """Twenty batches: each reads one version of each part that its keys fall into."""
    schema, asked = T.StructType.fromDDL("k bigint, n bigint"), []
    real = state.KeyedTable._rows
    monkeypatch.setattr(state.KeyedTable, "_rows", lambda self, newest: (asked.append(newest), real(self, newest))[1])
    table = state.KeyedTable(spark, str(tmp_path / "t"), schema, ("k",), 8)
    add = lambda held, rows: held.unionByName(rows).groupBy("k").agg(F.sum("n").alias("n"))
    want = {}
    for batch in range(20):
        keys = [batch % 7, 3]
        rows = spark.createDataFrame([(k, 1) for k in set(keys)], schema)
        for k in set(keys):
            want[k] = want.get(k, 0) + 1
        touched = table.update(rows, batch, add)
        assert len(touched) <= 2 and set(asked[-1]) <= set(touched) and all(v < batch for v in asked[-1].values())
    assert {r.k: r.n for r in table.read().collect()} == want
    assert all(len(versions) <= 2 for versions in table.versions().values())
    # A batch that runs again changes nothing.
    table.update(spark.createDataFrame([(k, 1) for k in {19 % 7, 3}], schema), 19, add)
    assert {r.k: r.n for r in table.read().collect()} == want


def test_sliding_counts(spark):
    rows = [("r", "a", 0, 2), ("r", "a", 1, 1), ("r", "a", 95, 4), ("q", "a", 0, 1), ("r", "b", 40, 1), ("r", "b", 130, 2)]
    daily = spark.createDataFrame([(r, p, START + timedelta(days=d), n) for r, p, d, n in rows], "repo_id string, path string, day timestamp, commits bigint")
    got = {(r.repo_id, r.path, (r.day - START).days): r.commits_last_90d for r in churn.on_days(churn.sliding_commits(daily)).collect()}
    want = {}
    for r, p, d, n in rows:
        for day in range(d, d + 90):
            want[r, p, day] = want.get((r, p, day), 0) + n
    assert got == want


def test_every_part_has_a_writer_of_its_own(spark, tmp_path):
    """Parts are dealt to as many tasks, however few there are; the file names tell the tasks."""
    schema = T.StructType.fromDDL("k bigint, n bigint")
    table = state.KeyedTable(spark, str(tmp_path / "t"), schema, ("k",), 64)
    whole = lambda held, rows: held.unionByName(rows)
    for batch, keys in enumerate((range(2000), range(20))):
        touched = table.update(spark.createDataFrame([(k, 1) for k in keys], schema), batch, whole)
        tasks = [f.name.split("-")[1] for f in (tmp_path / "t").glob(f"part=*/batch={batch}/part-*")]
        assert len(tasks) == len(set(tasks)) == len(touched)
    assert table.read().groupBy().sum("n").first()[0] == 2020


def test_a_batch_of_diffs_is_parsed_by_several_tasks(spark, monkeypatch):
    """The feed has more files with more tasks, and still four batches."""
    tables = {
        "fx_numstat": ([("r", n, f"{n}\t2\tf{m}.go") for n in range(40) for m in range(3)], "repo_id string, pr_number bigint, value string"),
        "scored": ([("r", "f1.go", 90, "critical", "Go", False, "")], "repo_id string, path string, heat_score int, tier string, language string, assessed boolean, summary string"),
    }
    batches, read, score = [], [], review.score_prs
    monkeypatch.setattr(queries.Inputs, "bind", staticmethod(lambda spark, d, name: spark.createDataFrame(*tables[name])))
    monkeypatch.setattr(queries.Inputs, "scored", lambda t: t.bind(spark, "", "scored"))
    monkeypatch.setattr(review, "score_prs", lambda *a: batches.append(1) or score(*a))
    paths = queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda s, name: read.append(paths(s, name)) or read[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = {r.pr_number: (r.files_changed, r.tier) for r in queries.pr_stream(spark, "").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {n: (3, "critical") for n in range(40)}
    feed = spark.read.parquet(read[0])
    assert len(feed.inputFiles()) > 8 and len(batches) <= 4 and feed.count() == 120
