"""Expressions that recover an assessment from a model's free-text response.

A response is tried as four candidate texts, most faithful first: from the first
brace, up to the last brace, with the incomplete last field cut off, and with open
quotes and braces closed. The first candidate that is one valid JSON object of the
right types wins; otherwise the response is rejected. Field names are matched in any case, and of
a name that is given more than once the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.texts import count_literal, strip
from riskloom.schemas import ASSESSMENT_BODY, IMPACTS

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_KINDS = {f.name: "BIGINT" if isinstance(f.dataType, T.IntegralType) else "STRING"
          for f in ASSESSMENT_BODY.fields}
_ENVELOPE = "choices array<struct<message struct<content string>>>"


_ENTRIES = "array<struct<key string, value variant>>"


def _fields(candidate: Column) -> Column:
    """The fields of one JSON object with nothing after it, repeats kept; else null."""
    # Wrapped in brackets, text behind the object makes the whole array invalid.
    wrapped = F.concat(F.lit("["), candidate, F.lit("]"))
    objects = F.from_json(wrapped, "array<map<string,variant>>", _STRICT)
    return F.when(F.startswith(candidate, F.lit("{")) & (F.size(objects) == 1), F.map_entries(F.get(objects, 0)))


def _well_typed(entries: Column) -> Column:
    """Every field of a known name has that field's type or is null."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])

    def fits(e: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))
        wanted = F.try_element_at(kinds, F.lower(e["key"]))
        return wanted.isNull() | (kind == "VOID") | (kind == wanted)

    return entries.isNotNull() & F.forall(entries, fits)


def candidates(text: Column) -> list[Column]:
    """The candidate texts in the order they are tried."""
    one_line = F.translate(text, "\n", " ")
    opened = strip(F.regexp_extract(one_line, r"(?s)\{.*", 0))
    closed = F.regexp_extract(opened, r"(?s)\A.*\}", 0)
    cut = F.concat(F.regexp_replace(opened, r"(?s)[,{][^,{]*\z", ""), F.lit("}"))
    quotes = F.regexp_count(F.regexp_replace(opened, r"(?s)\\.", ""), F.lit('"'))
    missing = (count_literal(opened, "{") - count_literal(opened, "}")).cast("int")
    mended = F.concat(
        opened,
        F.when(quotes % 2 == 1, '"').otherwise(""),
        F.repeat(F.lit("}"), F.greatest(F.lit(0), missing)),
    )
    return [opened, closed, cut, mended]


def assessment_fields(text: Column) -> Column:
    """The fields of the first valid candidate, or null when the response is rejected.

    A candidate is parsed only where those before it are not valid."""
    tried = [F.get(F.filter(F.array(_fields(c)), _well_typed), F.lit(0)) for c in candidates(text)]
    nothing = F.array().cast(_ENTRIES)
    return F.when(strip(text) == "null", nothing).otherwise(F.coalesce(*tried))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value, F.lit(0)))).cast("int")


def assessment_body(entries: Column) -> Column:
    """The fields as one struct: the last value of each name, in whatever case."""
    def last(name: str) -> Column:
        named = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        return F.try_element_at(named, F.lit(-1))["value"]

    return F.when(entries.isNotNull(), F.struct(*[
        F.try_variant_get(last(f.name), "$", f.dataType.simpleString()).alias(f.name)
        for f in ASSESSMENT_BODY.fields]))


def assessment_columns(body: str) -> dict[str, Column]:
    """Clamped impacts and texts of the struct column ``body``; missing fields are zero."""
    out = {name: clamp(F.col(f"{body}.{name}")) for name in IMPACTS}
    for name in ("blast_radius_summary", "critical_reason"):
        out[name] = F.coalesce(F.col(f"{body}.{name}"), F.lit(""))
    return out


def max_impact() -> Column:
    return F.greatest(*[F.col(name) for name in IMPACTS])


def chat_content(raw: Column) -> Column:
    """Text of the first choice of a chat-completion body; null when there is none."""
    choices = F.from_json(raw, _ENVELOPE)["choices"]
    first = F.try_element_at(choices, F.lit(1))
    return F.when(F.size(choices) > 0, F.coalesce(first["message"]["content"], F.lit("")))
