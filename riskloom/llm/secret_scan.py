"""Secret scan: fixed patterns, and character Markov models for strings without a pattern.

Three base kinds have patterns of their own (``assign``, ``access``, ``hex``). The fourth,
``markov``, looks at every run of at least ``SHORTEST`` characters of ``CHARS``: two
first-order Markov models, one trained on labelled random strings and one on labelled
ordinary identifiers, give its log-likelihood ratio per transition, and a run above
``threshold`` is a finding unless it overlaps a base finding, which stays as it is.

Training counts character transitions of all labelled rows; add-one smoothing covers unseen
ones. The model is a table of 66 x 66 ratios, whatever the input.

Offsets count code points, ends are exclusive. Defined cases: null text is empty; an empty
text has no findings; rows that repeat a doc_id with the same text give each the same
answer, and texts that share a doc_id are scanned apart; a null doc_id is a key like any
other; an untrained model (no samples) finds nothing by ratio.

Scale: patterns run as expressions over whole texts without a shuffle. Only findings (kind,
lengths, value) are shuffled; positions come from running sums per text and kind. No Python
runs in tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small_side, unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
SHORTEST = 20
RUN = rf"(?<![A-Za-z0-9+/_=])[A-Za-z0-9+/_=]{{{SHORTEST},}}"
KINDS = ["assign", "access", "hex", "markov"]
BASE = len(CHARS) + 1


def transitions(value):
    """Array of the pairs of a string as numbers; characters outside CHARS count as one."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(CHARS), c))
    # Without a let, the codes would be found again for every pair.
    return F.get(F.transform(F.array(codes), lambda a: F.zip_with(
        F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))),
        lambda x, y: x * BASE + y)), 0)


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two models for every transition. ``samples``: text, random (boolean).

    What comes to the driver is one count per transition and label, 2 x 67 x 67 at most."""
    pairs = samples.dropna(subset=["text", "random"]).filter("text != ''").select(
        "random", F.explode(transitions(F.col("text"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({k for k, _ in counts}) < 2:
        return [0.0] * (BASE * BASE)
    totals = {(k, a): sum(counts.get((k, a * BASE + b), 0) for b in range(BASE)) for k in (True, False) for a in range(BASE)}
    log = lambda k, a, b: math.log((counts.get((k, a * BASE + b), 0) + 1) / (totals[k, a] + BASE))
    return [round(log(True, a, b) - log(False, a, b), 4) for a in range(BASE) for b in range(BASE)]


def ratio(value, model: list[float]):
    """Mean log-likelihood ratio of a string's transitions."""
    table = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<double>")
    pairs = transitions(value)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1)) / F.greatest(F.size(pairs), F.lit(1))


def matches(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, end, value: every match of the four patterns that is
    long enough; ``value`` is what the match assigns, or all of it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(t).alias("text_key"), t.alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": RUN}
    found = docs.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    found = found.filter(" or ".join(f"size({k}) > 0" for k in patterns))
    # What stands before each match, by length only; null where a kind has no match.
    gaps = found.select("doc_id", "text_key", *patterns, *[
        F.when(F.size(k) > 0, F.transform(F.split("t", p, -1), lambda x: F.char_length(x))).alias(f"{k}_gaps")
        for k, p in patterns.items()])
    once = gaps.dropDuplicates(["doc_id", "text_key"])
    rows = once.select("doc_id", "text_key", F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.col(k).alias("found"), F.col(f"{k}_gaps").alias("gaps")) for k in patterns])).alias("x"))
    rows = rows.filter(F.size("x.found") > 0).select("doc_id", "text_key", "x.kind", "x.gaps", F.posexplode("x.found").alias("i", "match"))
    rows = rows.withColumn("gap", F.get("gaps", F.col("i"))).drop("gaps")
    so_far = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(so_far))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    return ends.select("doc_id", "text_key", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", value.alias("value")).filter(
        (F.col("kind") != "assign") | (F.char_length("value") >= 12))


def find_secrets(documents: DataFrame, model: list[float], *, threshold: float = 0.0) -> DataFrame:
    """doc_id, text_key, kind, start, end: base findings and runs that look random."""
    found = matches(documents)
    scored = found.filter((F.col("kind") != "markov") | (ratio(F.col("value"), model) > threshold)).drop("value")
    base = F.col("kind") != "markov"
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind")
    left = F.max(F.when(base, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(before.rowsBetween(1, Window.unboundedFollowing))
    apart = F.coalesce(left <= F.col("start"), F.lit(True)) & F.coalesce(right >= F.col("end"), F.lit(True))
    return scored.withColumn("apart", base | apart).filter("apart").drop("apart")


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(
        F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, model: list[float], **options) -> DataFrame:
    """Every row of documents as doc_id with n_assign, n_access, n_hex, n_markov, base_sha256
    and spans (``kind:start:end`` by start, then kind in the order of KINDS)."""
    found = find_secrets(documents, model, **options)
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", kind.alias("kind"), "end"))).alias("all"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "all")
    docs = documents.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["d"]) & (docs["text_key"] == spans["k"]), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    joined = joined.select("doc_id", every.alias("all"))
    count = lambda i: F.size(F.filter("all", lambda s: s["kind"] == i)).cast("long")
    return joined.select(
        "doc_id", *[count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.filter("all", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redact(documents: DataFrame, model: list[float], **options) -> DataFrame:
    """Documents with every finding replaced by ``<secret>``; other columns stay, and
    ``n_chars``, if there, is counted again. Findings that overlap are cut as one."""
    found = find_secrets(documents, model, **options)
    # Names that no column of the documents has.
    cuts, cut_id, cut_key, cut_text = unused(documents.columns, "cuts", "cut_id", "cut_key", "cut_text")
    spans = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    spans = small_side(spans.select(F.col("doc_id").alias(cut_id), F.col("text_key").alias(cut_key), cuts), "spans")
    key = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    joined = documents.join(spans, documents["doc_id"].eqNullSafe(spans[cut_id]) & (key == spans[cut_key]), "left")
    # Pieces of the text are collected with the end of the last cut.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("text")
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
            F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("<secret>")))).alias("out"))
    done = F.aggregate(cuts, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    cut = F.when(F.col(cuts).isNull(), text).otherwise(done)
    # In a step of its own: beside the new text, "text" would name that one.
    done = joined.withColumn(cut_text, cut)
    new = {"text": F.col(cut_text)} | ({"n_chars": F.length(cut_text).cast("long")} if "n_chars" in documents.columns else {})
    return done.select(*[new[c].alias(c) if c in new else documents[c] for c in documents.columns])


def samples_of(documents: DataFrame, *, shortest: int = 10) -> DataFrame:
    """Labelled samples for ``train``: values that the base patterns found and digests of
    the ids as random strings, words of at least ``shortest`` letters as identifiers."""
    found = matches(documents).filter("kind != 'markov'").select(F.col("value").alias("text"), F.lit(True).alias("random"))
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    made = documents.select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(
        F.conv(F.substring(digest, 1, 15), 16, 36)))).alias("text"), F.lit(True).alias("random"))
    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-z][a-z]{{{shortest - 1},}}"), F.lit(0))).alias("text"), F.lit(False).alias("random"))
    return found.unionByName(made).unionByName(words)
