"""Expressions on file paths: language, test flag, risk keywords, exclusions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.settings import Exclusions

# Language of each lower-cased file extension.
LANGUAGES = {
    "go": "Go",
    "ts": "TypeScript", "tsx": "TypeScript",
    "js": "JavaScript", "jsx": "JavaScript",
    "py": "Python",
    "java": "Java",
    "rb": "Ruby",
    "rs": "Rust",
    "cpp": "C++", "cc": "C++", "cxx": "C++",
    "c": "C",
    "cs": "C#",
}

# File-name endings of tests; a leading "test_" marks one too.
TEST_SUFFIXES = ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "_test.py")
TEST_PREFIX = "test_"

# Names that are never sent for assessment, besides the tests above.
UNASSESSED_SUFFIXES = TEST_SUFFIXES + (
    "_test.rs", ".pb.go",
    ".md", ".yaml", ".yml", ".toml", ".json", ".lock", ".sum", ".mod",
)
GENERATED_MARK = ".generated."

# Path keywords of each user-impact and data-sensitivity flag.
USER_FACING = ("api/", "handler", "route", "controller", "endpoint")
AFFECTS_AUTH = ("auth", "jwt", "session", "token", "login", "permission")
AFFECTS_DATA = ("db/", "database", "model", "schema", "migration", "sql")
AFFECTS_PAYMENTS = ("payment", "billing", "checkout", "stripe", "paypal", "transaction")
HANDLES_PII = ("user", "profile", "personal", "customer", "account")
HANDLES_SECRETS = ("auth", "secret", "crypto", "key", "token", "credential")
HANDLES_FINANCIAL = ("payment", "billing", "price", "invoice", "transaction")


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the lower-cased text contains any of the words; never for an empty list."""
    if not words:
        return F.lit(False)
    return F.rlike(F.lower(text), F.lit("|".join(map(re.escape, words))))


def _named_like(path: Column, suffixes: tuple[str, ...], also: str) -> Column:
    """Whether the base name ends in a suffix or matches another pattern.

    One pattern over the path, so that a filter built on it stays one short expression.
    """
    endings = "|".join(map(re.escape, suffixes))
    return F.rlike(path, F.lit(rf"(?:{endings})\z|{also}"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash, ``.`` for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")) \
        .otherwise(F.lit("."))


def module(path: Column) -> Column:
    """The first two path segments."""
    return F.substring_index(path, "/", 2)


def language(path: Column) -> Column:
    """Language of the file extension, empty when it is not a source file."""
    ext = F.regexp_extract(F.lower(path), r"\.([^./]*)\z", 1)
    known = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*known), ext), F.lit(""))


_TEST_NAME = rf"(?:\A|/){TEST_PREFIX}[^/]*\z"
_GENERATED_NAME = rf"{re.escape(GENERATED_MARK)}[^/]*\z"


def is_test(path: Column) -> Column:
    return _named_like(path, TEST_SUFFIXES, _TEST_NAME)


def is_assessable(path: Column) -> Column:
    """Whether the file's content is worth an impact assessment."""
    return ~_named_like(path, UNASSESSED_SUFFIXES, f"{_TEST_NAME}|{_GENERATED_NAME}")


def user_impact_flags(path: Column) -> dict[str, Column]:
    return {
        "user_facing": contains_any(path, USER_FACING),
        "affects_auth": contains_any(path, AFFECTS_AUTH),
        "affects_data": contains_any(path, AFFECTS_DATA),
        "affects_payments": contains_any(path, AFFECTS_PAYMENTS),
    }


def sensitivity_flags(path: Column) -> dict[str, Column]:
    return {
        "handles_pii": contains_any(path, HANDLES_PII),
        "handles_secrets": contains_any(path, HANDLES_SECRETS),
        "handles_financial": contains_any(path, HANDLES_FINANCIAL),
    }


def glob_to_regex(pattern: str) -> str:
    """Regex of a shell glob over one path segment (``*``, ``?``, ``[..]``, ``\\x``)."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1:end].replace("[", r"\[").replace("&", r"\&")
            out.append(f"[{body}]")
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def excluded_dir_regex(exclude: Exclusions) -> str:
    """Regex that finds a hidden or excluded directory anywhere in a path."""
    names = [re.escape(d) for d in exclude.dirs] + [glob_to_regex(p) for p in exclude.patterns]
    return "(?:^|/)(?:" + "|".join([r"\.[^/]*", *names]) + ")/"


def in_excluded_dir(path: Column, exclude: Exclusions) -> Column:
    """Only directories count: a hidden *file* in a visible directory is kept."""
    return F.rlike(path, F.lit(excluded_dir_regex(exclude)))


def ancestors(path: Column) -> Column:
    """Array of every directory above the file, outermost first; empty at the root."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0,
        F.transform(
            F.sequence(F.lit(1), depth),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
