"""Expressions on file contents and commit messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.paths import contains_any

# Code points of every white-space character except the newline.
_SPACE_CODES = (
    0x09, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACES = "".join(map(chr, _SPACE_CODES))
SPACE_CLASS = "".join(f"\\x{{{code:x}}}" for code in _SPACE_CODES)

# Words that mark a commit as a bug fix.
FIX_WORDS = ("fix", "bug", "patch", "hotfix", "repair", "correct", "resolve")

# The limit of an excerpt, where one is asked for, and the mark of a cut.
PROMPT_LINES = 300
TRUNCATION_MARK = "\n... (truncated)"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, newlines included."""
    return F.btrim(text, F.lit(SPACES + "\n"))


def count_literal(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, without a regex."""
    removed = F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    width = len(needle.encode())
    gone = F.octet_length(text) - removed
    return (gone if width == 1 else F.floor(gone / width)).cast("bigint")


def line_count(content: Column) -> Column:
    """Newlines, plus one for a last line that does not end in one."""
    open_end = (content != "") & ~F.endswith(content, F.lit("\n"))
    return count_literal(content, "\n") + open_end.cast("bigint")


def content_hash(content: Column) -> Column:
    """First 16 bytes of the SHA-256 digest, in hex."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 32)


def trim_lines(content: Column) -> Column:
    """The text with every line trimmed on both sides."""
    pattern = f"(?dm)^[{SPACE_CLASS}]++|(?<![{SPACE_CLASS}])[{SPACE_CLASS}]++$"
    return F.regexp_replace(content, pattern, "")


def prompt_excerpt(content: Column, lines: int | None) -> Column:
    """The first lines and a mark when there are more; all of them without a limit."""
    if lines is None:
        return content
    too_long = count_literal(content, "\n") >= lines
    head = F.substring_index(content, "\n", lines)
    return F.when(too_long, F.concat(head, F.lit(TRUNCATION_MARK))).otherwise(content)


def assessment_prompt(path: Column, content: Column, lines: int | None = None) -> Column:
    """Text that asks a model for the four impacts of one file, as JSON.

    The whole content is shown unless ``lines`` limits it."""
    fields = {
        "security_impact": "could someone read, forge or escalate what they must not?",
        "data_impact": "could stored or transferred data be lost, changed or exposed?",
        "availability_impact": "could a service slow down, hang or stop for others?",
        "user_impact": "would people who use the product notice, and how badly?",
    }
    questions = "\n".join(f"- {name}: {question}" for name, question in fields.items())
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Source file "), path, F.lit(":")),
        prompt_excerpt(content, lines),
        F.lit("Suppose a change to this file goes wrong and nobody notices before release. Give "
              "four whole numbers from 0 (no effect at all) to 100 (the worst that this kind of "
              "system can suffer); 50 is harm that needs a rollback the same day.\n" + questions),
        F.lit("Add blast_radius_summary, at most 80 characters on what else would break, and "
              "critical_reason, at most 40 characters, empty unless a number is above 85. Reply "
              "with these six fields as a single JSON object, on one line, without other text."),
    )


def pr_number(message: Column) -> Column:
    """Pull-request number named by a commit message, or null."""
    after_hash = F.regexp_extract(message, r"\A[^#]*#\s*([+-]?[0-9]+)", 1)
    merged = F.when(
        F.contains(message, F.lit("Merge pull request #")),
        F.nullif(after_hash, F.lit("")).try_cast("bigint"),
    )
    tail = F.substr(message, F.instr(message, "(#") + F.lit(2))
    in_parens = F.when(
        F.contains(message, F.lit("(#")),
        F.nullif(F.regexp_extract(tail, r"\A *([+-]?[0-9]+)[^)]*\)", 1), F.lit(""))
        .try_cast("bigint"),
    )
    return F.coalesce(merged, in_parens)


def is_bug_fix(message: Column) -> Column:
    return contains_any(message, FIX_WORDS)


def first_line(message: Column) -> Column:
    return strip(F.substring_index(message, "\n", 1))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)
