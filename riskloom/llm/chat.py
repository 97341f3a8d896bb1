"""Chat formatting: records of several layouts become turns, turns become marked text.

A record is a JSON object. The sorted paths of its nested fields (``messages[].role``) are
hashed to a fingerprint, which selects a declarative mapping from that layout to turns of
role and text; no field is guessed. The template writes a turn as

    ### role: text </turn>

with a line break behind it. Inside roles and texts a backslash is put before ``\\``, ``###``
and ``</turn>`` (in roles before ``:`` too), so a mark in a text is never a mark of the
template and everything can be read back. The loss mask is a list of code-point ranges of
the formatted text that hold the texts of assistant turns.

Defined cases: null or missing texts and roles are empty; a record whose fingerprint no
mapping has, or that is no JSON object, gets a null layout and no turns; an empty messages
list is a record without turns; repeated records are formatted each by itself; turns keep
the order of their list. Extra columns are kept unless they carry the name of a result.

Work is per record, so the size of a record bounds the memory of a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "### ", " </turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)
ESCAPED = re.compile(r"\\|###|</turn>")
TRAINED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """``each`` names a list of objects with ``role`` and ``text`` fields, or ``fixed`` lists
    (role, field); ``roles`` renames roles."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple = ()
    roles: dict = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [f"{self.each}[].{x}" for x in (self.role, self.text)] if self.each else [f for _, f in self.fixed]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if not self.each:
            return [(role, record[f] or "") for role, f in self.fixed]
        pairs = [(m[self.role] or "", m[self.text] or "") for m in record[self.each]]
        return [(self.roles.get(r, r), t) for r, t in pairs]


MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def escape(text: str, role: bool = False) -> str:
    out = ESCAPED.sub(lambda m: "\\" + m[0], text)
    return out.replace(":", "\\:") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the ranges under the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chats(records: DataFrame, *, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """The rows of ``records`` with layout, formatted and loss (array of start, end)."""
    known = {fingerprint(m.paths()): m for m in mappings}
    known |= {fingerprint([f"{m.each}[]"]): m for m in mappings if m.each}

    def one(text) -> tuple:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return None, None, None
        mapping = known.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
        if mapping is None:
            return None, None, None
        try:
            return mapping.name, *render(mapping.turns(value))
        except (AttributeError, TypeError, KeyError):  # a field of the right name with another type
            return None, None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(x) for x in f[record]]
            yield f.assign(layout=[x[0] for x in made], formatted=[x[1] for x in made], loss=[
                None if x[2] is None else [{"start": a, "end": b} for a, b in x[2]] for x in made])

    kept = records.drop(*[c for c in records.columns if c.lower() in ("layout", "formatted", "loss")])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("layout", T.StringType()),
                           T.StructField("formatted", T.StringType()), T.StructField("loss", span)])
    return kept.mapInPandas(run, schema)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What reading the formatted text back gives, as counts and digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, text, loss in zip(f[key], f["formatted"], f["loss"]):
                turns = read_back(text or "")
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescape(text[s["start"]:s["end"]]) for s in ([] if loss is None else loss))
                rows.append((k, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                             hashlib.sha256(learned.encode()).hexdigest(), len(text or "")))
            yield pd.DataFrame(rows, columns=names).astype({key: "Int64"})

    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.select(key, "formatted", "loss").mapInPandas(
        run, f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id and a JSON record per conversation, in the layout that its roles allow: user
    and assistant as prompt and response, with a system turn before them as an instruction,
    others as messages or, from six turns on, as conversations with their own role names.
    Rows are put in order by turn, then role and text; a conversation has to fit a row."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    roles, said = F.col("t.role"), lambda i: F.get("t", i)["text"]
    named = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    # As arrays: a role may be any text, also one with a line break in it.
    are = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    is_prompt, is_instruction = are("user", "assistant"), are("system", "user", "assistant")
    clash = F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    record = F.when(is_prompt, F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response")))).when(
        is_instruction, F.to_json(F.struct(said(0).alias("system"), said(1).alias("instruction"), said(2).alias("output")))).when(
        (F.size("t") >= 6) & ~clash, F.to_json(F.struct(F.transform("t", lambda x: F.struct(
            named(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))).otherwise(
        F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    return turns.select("conv_id", record.alias("record"))
