from datetime import date

from riskloom.llm.url_filter import intervals, url_filter

ENTRIES = [
    ("host", "a.example.com", "spam", "add", date(2021, 3, 1)), ("host", "a.example.com", "spam", "remove", date(2022, 3, 1)),
    ("host", "a.example.com", "spam", "add", date(2024, 1, 1)), ("domain", "example.org", "ads", "add", date(2020, 1, 1)),
    ("prefix", "b.example.com/x/", "adult", "add", date(2021, 1, 1)), ("domain", "example.net", "ads", "add", date(2021, 5, 5)),
    ("domain", "example.net", "ads", "remove", date(2021, 5, 5)), ("host", None, "spam", "add", date(2020, 1, 1)),
    ("host", "c.example.com", "spam", "add", None), ("domain", "example.org", "spam", "add", date(2021, 1, 1)),
    ("domain", "example.org", "ads", "add", date(2020, 1, 1))]
SCHEMA = "kind string, pattern string, category string, action string, effective date"


def test_captures_as_of_their_day(spark):
    asks = [
        (1, "http://a.example.com/p", date(2021, 2, 28), ""), (2, "http://a.example.com/p", date(2021, 3, 1), "spam"),
        (3, "https://A.Example.com:80/?q", date(2022, 2, 28), "spam"), (4, "http://a.example.com/p", date(2022, 3, 1), ""),
        (5, "http://u@a.example.com/p", date(2030, 1, 1), "spam"), (6, "http://z.y.example.org./", date(2020, 6, 1), "ads"),
        (7, "http://example.org", date(2021, 6, 1), "ads,spam"), (8, "http://notexample.org", date(2021, 6, 1), ""),
        (9, "http://b.example.com/x/y?z", date(2021, 6, 1), "adult"), (10, "http://b.example.com/X/y", date(2021, 6, 1), ""),
        (11, "http://b.example.com/x", date(2021, 6, 1), ""), (12, "http://q.example.net", date(2021, 5, 5), "ads"),
        (13, None, date(2021, 6, 1), ""), (14, "http://a.example.com/p", None, ""), (15, "", date(2021, 6, 1), ""),
        (16, "http://c.example.com", date(2021, 6, 1), ""), (17, "http://a.example.com/" + "k/" * 3000, date(2021, 6, 1), "spam"), (2, "http://a.example.com/p", date(2021, 3, 1), "spam")]
    captures = spark.createDataFrame([(i, u, d, "old") for i, u, d, _ in asks], "page_id long, url string, fetched_on date, blocked string")
    got = url_filter(captures, spark.createDataFrame(ENTRIES, SCHEMA))
    assert sorted((r["page_id"], r["categories"], r["blocked"]) for r in got.collect()) == sorted((i, c, c != "") for i, _, _, c in asks)
    nothing = url_filter(captures, spark.createDataFrame([], SCHEMA)).collect()
    assert len(nothing) == len(asks) and not any(r["blocked"] for r in nothing)
    assert url_filter(captures.limit(0), spark.createDataFrame(ENTRIES, SCHEMA)).count() == 0


def test_intervals(spark):
    got = {(r["pattern"], r["category"], r["valid_from"], r["valid_to"]) for r in intervals(spark.createDataFrame(ENTRIES, SCHEMA)).collect()}
    assert ("a.example.com", "spam", date(2021, 3, 1), date(2022, 3, 1)) in got and ("a.example.com", "spam", date(2024, 1, 1), None) in got


def test_columns_of_any_name_stay(spark):
    captures = spark.createDataFrame([(1, "http://q.example.net", date(2021, 5, 5), 7, "eight", "p", "k", 9)],
                                     "page_id long, url string, fetched_on date, u int, D string, pattern string, kind string, year int")
    got = url_filter(captures, spark.createDataFrame([*ENTRIES, ("host", "q.example.net", "odd", None, date(2020, 1, 1))], SCHEMA)).collect()
    assert [(r["u"], r["D"], r["pattern"], r["kind"], r["year"], r["blocked"]) for r in got] == [(7, "eight", "p", "k", 9, True)]
    assert set(captures.columns) < set(got[0].asDict())
