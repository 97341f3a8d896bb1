import pytest
from pyspark.sql import functions as F

from riskloom.functions import responses, texts
from riskloom.operators import assessments as ops

CLEAN = ('{"security_impact": 12, "data_impact": 64, "availability_impact": 7, "user_impact": 31,'
         ' "blast_radius_summary": "Ledger rows doubled", "critical_reason": "Posts money"}')
FENCED = ('I looked at the loader.\n~~~\n{"security_impact": 3, "data_impact": 77,'
          ' "availability_impact": 58, "user_impact": 20, "blast_radius_summary": "ni\nght job",'
          ' "critical_reason": ""}\n~~~\nAsk me for more.')
CUT_VALUE = ('{"security_impact":41,"data_impact":2,"availability_impact":66,"user_impact":19,'
             '"blast_radius_summary":"Queue stalls, mails wait","critical_reason":"Only wor')
CUT_KEY = ('{"security_impact":5,"data_impact":6,"availability_impact":71,"user_impact":8,'
           '"blast_radius_summary":"Cache cold","crit')

CASES = [
    (CLEAN, (12, 64, 7, 31, "Ledger rows doubled", "Posts money")),
    (FENCED, (3, 77, 58, 20, "ni ght job", "")),
    (CUT_VALUE, (41, 2, 66, 19, "Queue stalls, mails wait", "")),
    (CUT_KEY, (5, 6, 71, 8, "Cache cold", "")),
    ("no object in here", None),
    ('{"Security_Impact": 85, "DATA_IMPACT": 4}', (85, 4, 0, 0, "", "")),
    ('{"security_impact": 85, "security_impact": 3}', (3, 0, 0, 0, "", "")),
    ('{"security_impact": 85, "SECURITY_IMPACT": 4, "User_Impact": 6}', (4, 0, 0, 6, "", "")),
    ('{"security_impact": 5, "Data_Impact": "x"}', (5, 0, 0, 0, "", "")),
    (" null ", (0, 0, 0, 0, "", "")),
    ("{}", (0, 0, 0, 0, "", "")),
    ('{"security_impact": 150, "data_impact": -10, "availability_impact": 50, "user_impact": 200}',
     (100, 0, 50, 100, "", "")),
    ('{"security_impact": 85.5, "data_impact": 10}', None),
    ('{"security_impact": 85, "data_impact": 10.5}', (85, 0, 0, 0, "", "")),
    ('{"security_impact":9,"blast_radius_summary":"a, b', (9, 0, 0, 0, "a, b", "")),
    ('{"security_impact":9,"blast_radius_summary":"a \\"q, b', (9, 0, 0, 0, 'a "q, b', "")),
    ('{"security_impact":9} trailing words', (9, 0, 0, 0, "", "")),
    ('{"security_impact":9} and {x} ok', None),
    ('{"security_impact":9}{"security_impact":8}', None),
    ('{"security_impact":"9"}', None),
    ("{'security_impact':9}", None),
    ('[{"security_impact":9}]', (9, 0, 0, 0, "", "")),
    ('{"security_impact":9,"extra":{"a":[1,2]}}', (9, 0, 0, 0, "", "")),
    ('{"security_impact":null,"data_impact":3}', (0, 3, 0, 0, "", "")),
    (None, None),
    ("", None),
]


def test_ladder(spark):
    rows = [(str(i), text) for i, (text, _) in enumerate(CASES)]
    parsed = ops.parse_responses(spark.createDataFrame(rows, "content_hash string, text string"))
    got = {int(r.content_hash): r for r in parsed.collect()}
    for i, (text, expected) in enumerate(CASES):
        r = got[i]
        found = tuple(r[c] for c in ops.ASSESSMENT_COLUMNS[1:]) if r.accepted else None
        assert (text, found) == (text, expected)
    assert ops.accepted(parsed).count() + ops.rejected(parsed).count() == len(CASES)


def test_max_impact(spark):
    rows = [(90, 50, 30, 70), (10, 80, 30, 70), (0, 0, 0, 0), (50, 50, 50, 50)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in responses.IMPACTS))
    assert [r[0] for r in df.select(responses.max_impact()).collect()] == [90, 80, 0, 50]


@pytest.mark.parametrize("raw, expected", [
    ('{"choices":[{"message":{"content":"hi"}},{"message":{"content":"no"}}]}', "hi"),
    ('{"choices":[]}', None), ('{"error":"x"}', None), ("not json", None),
    ('{"choices":[{"message":{}}]}', ""),
])
def test_envelope(apply, raw, expected):
    assert apply("raw string", [(raw,)], responses.chat_content(F.col("raw"))) == [expected]


ASSESSMENT = ("content_hash string, security_impact int, data_impact int, availability_impact int,"
              " user_impact int, blast_radius_summary string, critical_reason string")


def test_plan_merge_and_counters(spark):
    files = spark.createDataFrame([
        ("r", "b.go", "same"), ("r", "a.go", "same"), ("q", "z.go", "same"), ("r", "c.go", "other"),
        ("r", "d_test.go", "test"), ("r", "vendor/e.go", "vendored"), ("r", "f.go", "known"),
        ("q", "g.go", "known"), ("r", "readme.md", "text"),
    ], "repo_id string, path string, content string")
    hashed = ops.assessable(files).selectExpr(
        "repo_id", "path", "substr(sha2(content, 256), 1, 32) AS content_hash")
    known = spark.sql("SELECT substr(sha2('known', 256), 1, 32) AS content_hash")
    plan = ops.plan_assessments(files, known)
    assert sorted((r.repo_id, r.path, r.files) for r in plan.collect()) \
        == [("q", "z.go", 3), ("r", "c.go", 1)]
    assert all(r.path in r.prompt for r in plan.collect())
    assert ops.plan_assessments(files, known, force=True).count() == 3
    assert ops.plan_assessments(files, known, hashed=hashed).count() == 2
    hits, misses = ops.split_by_cache(ops.content_groups(hashed), known)
    assert hits.count() + misses.count() == hashed.select("content_hash").distinct().count()
    parsed = ops.parse_responses(spark.createDataFrame(
        [("x", CLEAN), ("y", "no")], "content_hash string, text string"))
    counters = ops.run_counters(ops.content_groups(hashed), known, parsed).collect()[0]
    assert (counters.cached, counters.assessed, counters.failed) == (2, 1, 1)
    cached = spark.createDataFrame([("x", 1, 1, 1, 1, "old", ""), ("w", 2, 2, 2, 2, "old", "")],
                                   ASSESSMENT)
    merged = {r.content_hash: r.blast_radius_summary
              for r in ops.merge_assessments(cached, ops.accepted(parsed)).collect()}
    assert ops.merge_assessments(cached.union(cached), ops.accepted(parsed)).count() == 2
    assert merged == {"x": "Ledger rows doubled", "w": "old"}


def test_repeated_responses_give_one_assessment(spark):
    rows = [("h", '{"data_impact": 9}', 1), ("h", '{"data_impact": 2}', 3), ("h", '{"data_impact": 7}', 2), ("h", "no", 9)]
    got = ops.accepted(ops.parse_responses(spark.createDataFrame(rows, "content_hash string, text string, batch bigint")))
    assert [(r.content_hash, r.data_impact) for r in got.collect()] == [("h", 2)]


def test_bitmap_keeps_the_missed_files_out_of_the_scan_of_all(spark):
    files = spark.range(20_000).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("repo_id"), F.concat(F.lit("f"), F.col("id"), F.lit(".py")).alias("path"),
        F.concat(F.lit("text "), F.col("id") % 9_000).alias("content"))
    hashed = files.select("repo_id", "path", texts.content_hash(F.col("content")).alias("content_hash"))
    known = hashed.filter("crc32(content_hash) % 10 > 0").select("content_hash").distinct()
    want = {tuple(r) for r in ops.plan_assessments(files, known).collect()}
    assert 800 < len(want) < 1_000
    got = ops.plan_assessments(files, known, broadcast_rows=0)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    wanted = got.select("repo_id", "path")
    kept = ops.maybe_among(files, wanted, len(want), 1 << 20)
    assert kept.columns == files.columns and kept.join(wanted, ["repo_id", "path"], "left_semi").count() == len(want)
    assert kept.count() < len(want) + 0.15 * 20_000
    # Before the exact join the scan's rows only meet the broadcast bitmap.
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    # A bitmap that is much too small lets all through, and the result is the same.
    assert {tuple(r) for r in ops.plan_assessments(files, known, broadcast_rows=0, filter_bits=1).collect()} == want
