"""Job parameters: tier limits, review rules, breaker limits, exclusions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Tiers from hottest to coolest, with the rank used by "at or above".
TIERS = ("critical", "high", "medium", "low")
TIER_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Accepted incident severities and the points each adds to a score.
SEVERITY_POINTS = {"critical": 10, "high": 5, "medium": 2, "low": 0}


@dataclass(frozen=True)
class TierThresholds:
    """Lowest score of each tier; anything below ``medium`` is low."""

    critical: int = 86
    high: int = 61
    medium: int = 31


@dataclass(frozen=True)
class ReviewRule:
    """What a reviewer of a file in a tier has to do."""

    min_reviewers: int
    requires_senior: bool
    requires_security_scan: bool
    requires_integration_tests: bool
    auto_merge: bool
    estimated_review_time_minutes: int


# Review rule of each tier.
DEFAULT_RULES = {
    "critical": ReviewRule(2, True, True, True, False, 60),
    "high": ReviewRule(2, False, False, True, False, 45),
    "medium": ReviewRule(1, False, False, False, False, 20),
    "low": ReviewRule(0, False, False, False, True, 5),
}


@dataclass(frozen=True)
class BreakerLimits:
    """Limits whose breach raises a warning signal on a pull request."""

    max_diff_lines: int = 500
    max_languages: int = 3
    min_test_ratio: float = 0.3
    require_pr_description: bool = True


# Directory names and directory globs that are never analysed.
EXCLUDED_DIRS = (
    "node_modules", "vendor", "__pycache__", ".venv", "venv", ".cache", "dist", "build",
    ".tox", ".mypy_cache", ".pytest_cache", "target", ".eggs", "site-packages",
    "third_party", "third-party", "external", "deps",
)
EXCLUDED_PATTERNS = ("distribution-*", "env*", "*.egg-info")


@dataclass(frozen=True)
class Exclusions:
    dirs: tuple[str, ...] = EXCLUDED_DIRS
    patterns: tuple[str, ...] = EXCLUDED_PATTERNS


@dataclass(frozen=True)
class Settings:
    """All parameters of a run. Anything not given keeps its default."""

    version: str = "1.0.0"
    tiers: TierThresholds = TierThresholds()
    rules: Mapping[str, ReviewRule] = field(default_factory=lambda: dict(DEFAULT_RULES))
    breakers: BreakerLimits = BreakerLimits()
    exclude: Exclusions = Exclusions()
    blocking_tiers: tuple[str, ...] = ("critical", "high")
    recent_days: int = 90
    lookback_days: int = 365
    recent_changes: int = 10
    # Lines of a file that an assessment prompt shows; None shows the whole file.
    prompt_lines: int | None = None

    @staticmethod
    def from_dict(values: Mapping[str, Any]) -> "Settings":
        """Build settings from a nested mapping; missing entries take defaults."""
        known = {f.name for f in fields(Settings)}
        unknown = set(values) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        merged = dict(values)
        base = Settings()
        for name in ("tiers", "breakers", "exclude"):
            if isinstance(merged.get(name), Mapping):
                given = {
                    k: tuple(v) if isinstance(v, list) else v
                    for k, v in merged[name].items()
                }
                merged[name] = replace(getattr(base, name), **given)
        if "rules" in merged:
            rules = dict(DEFAULT_RULES)
            for tier, rule in merged["rules"].items():
                if tier not in TIER_RANK:
                    raise ValueError(f"unknown tier: {tier!r}")
                rules[tier] = replace(rules[tier], **rule) if isinstance(rule, Mapping) else rule
            merged["rules"] = rules
        if "blocking_tiers" in merged:
            merged["blocking_tiers"] = tuple(merged["blocking_tiers"])
        return replace(base, **merged)


def check_tier(tier: str) -> str:
    """Return ``tier`` or raise if it is not one of the four."""
    if tier not in TIER_RANK:
        raise ValueError(f"tier must be one of {', '.join(TIERS)} (got {tier!r})")
    return tier
