"""Score formulas. Every score is an integer cut (not rounded) from doubles.

Sums of doubles keep a fixed left-to-right order: a result that sits on an integer
boundary is cut down, so the order of the additions can show in the score.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.settings import TIER_RANK, TIERS, ReviewRule, Settings, TierThresholds


def points(flags: dict[Column, int] | list[tuple[Column, int]], cap: int = 100) -> Column:
    """Capped sum of the points of the flags that are set."""
    total = reduce(add, [F.when(flag, F.lit(p)).otherwise(F.lit(0)) for flag, p in flags])
    return F.least(F.lit(cap), total).cast("int")


def user_impact_score(user_facing: Column, auth: Column, data: Column, payments: Column) -> Column:
    return points([(user_facing, 40), (auth, 30), (data, 20), (payments, 30)])


def data_sensitivity_score(pii: Column, secrets: Column, financial: Column) -> Column:
    return points([(pii, 50), (secrets, 40), (financial, 50)])


def incident_score(count: Column, any_recent: Column, severity_points: Column) -> Column:
    """20 per incident up to 80, 20 more if one is recent, plus severity points."""
    raw = F.least(F.lit(80), count * 20) + F.when(any_recent, 20).otherwise(0) + severity_points
    return F.when(count > 0, F.least(F.lit(100), raw)).otherwise(0).cast("int")


def churn_score(commits_recent: Column) -> Column:
    """One commit a day over 90 days is worth 50 points."""
    rate = commits_recent.cast("double") / F.lit(90.0)
    return F.least(F.lit(100), (rate * F.lit(50.0)).cast("int")).cast("int")


def coverage_score(percent: Column, has_integration_tests: Column) -> Column:
    """Risk left by missing coverage; integration tests take 20 off."""
    left = (F.lit(100.0) - percent.cast("double")).cast("int")
    return F.greatest(F.lit(0), left - F.when(has_integration_tests, 20).otherwise(0)).cast("int")


def complexity_score(cyclomatic: Column, cognitive: Column) -> Column:
    cyc = F.least(F.lit(1.0), cyclomatic.cast("double") / F.lit(20.0))
    cog = F.least(F.lit(1.0), cognitive.cast("double") / F.lit(30.0))
    return (cyc * F.lit(50.0) + cog * F.lit(50.0)).cast("int")


def _weighted(parts: list[tuple[str, float, str | None]]) -> str:
    """SQL text of the weighted mean over the active parts, in the listed order."""
    weights = [f"{w}D" if active is None else f"IF({active}, {w}D, 0D)" for _, w, active in parts]
    total = " + ".join(weights)
    terms = [
        f"CAST({score} AS DOUBLE) * ({w} / ({total}) * 100D) / 100D"
        for (score, _, _), w in zip(parts, weights)
    ]
    return f"CAST(greatest(0D, least(100D, {' + '.join(terms)})) AS INT)"


def heat_score() -> Column:
    """Heat of a row that carries the flat factor columns.

    An assessed file leans on its assessed impact; the others on path and code signals.
    Incidents and churn only take part when the file has any.
    """
    has_incidents = "(incident_count > 0 OR incident_score > 0)"
    has_commits = "(commit_count > 0 OR churn_score > 0)"
    assessed = _weighted([
        ("blast_score", 40, None),
        ("centrality * 100D", 15, None),
        ("complexity_score", 15, None),
        ("coverage_score", 10, None),
        ("incident_score", 10, has_incidents),
        ("churn_score", 10, has_commits),
    ])
    static = _weighted([
        ("centrality * 100D", 20, None),
        ("user_impact_score", 20, None),
        ("sensitivity_score", 15, None),
        ("complexity_score", 15, None),
        ("coverage_score", 10, None),
        ("incident_score", 25, has_incidents),
        ("churn_score", 10, has_commits),
    ])
    return F.expr(f"IF(assessed, {assessed}, {static})")


def tier_of(score: Column, thresholds: TierThresholds) -> Column:
    """Tier of a score in 0..100.

    A lookup by score, not a chain of comparisons: a filter on the tier is pushed below
    the projection that computes the score, and would repeat the whole score formula
    for every comparison.
    """
    def name(value: int) -> str:
        for tier in ("critical", "high", "medium"):
            if value >= getattr(thresholds, tier):
                return tier
        return "low"

    by_score = F.split(F.lit(",".join(name(value) for value in range(101))), ",")
    return F.element_at(by_score, F.greatest(F.lit(0), F.least(F.lit(100), score)) + 1)


_COLDEST_FIRST = ",".join(sorted(TIERS, key=TIER_RANK.__getitem__))


def tier_rank(tier: Column) -> Column:
    """4 for critical down to 1 for low; 0 for anything else."""
    return F.array_position(F.split(F.lit(_COLDEST_FIRST), ","), tier).cast("int")


def tier_of_rank(rank: Column) -> Column:
    return F.try_element_at(F.split(F.lit(_COLDEST_FIRST), ","), rank)


def tier_label(tier: Column) -> Column:
    return F.upper(tier)


def review_columns(settings: Settings) -> dict[str, Column]:
    """The six review-rule columns of column ``tier``.

    Four constant rows need no join, and a lookup reads the tier once (see
    :func:`tier_of`).
    """
    def lookup(name: str) -> Column:
        values = {t: str(getattr(settings.rules[t], name)).lower() for t in TIERS}
        entries = ", ".join(f"'{t}', {v}" for t, v in values.items())
        return F.expr(f"coalesce(try_element_at(map({entries}), tier), {values['low']})")

    return {name: lookup(name) for name in ReviewRule.__dataclass_fields__}


def impact_band(value: Column) -> Column:
    """Display band of one impact dimension."""
    return (
        F.when(value >= 80, "critical").when(value >= 60, "high")
        .when(value >= 40, "medium").otherwise("low")
    )


def treemap_tenths(heat: Column, lines: Column, by: str) -> Column:
    """Area of a file in a treemap, by heat or by size, in tenths.

    Whole tenths add up the same in any order, which sums of doubles would not.
    """
    if by == "heat":
        return F.greatest(heat.cast("bigint") * heat, F.lit(50).cast("bigint"))
    if by == "lines":
        return F.greatest(lines.cast("bigint"), F.lit(10).cast("bigint")) * 10
    raise ValueError(f"weight must be 'heat' or 'lines' (got {by!r})")


def treemap_weight(heat: Column, lines: Column, by: str) -> Column:
    return treemap_tenths(heat, lines, by).cast("double") / F.lit(10.0)
