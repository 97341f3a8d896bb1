"""Benchmark decontamination by spaced seeds.

Texts are sequences of lower-case words (runs of letters and digits). A document overlaps a
benchmark item where ``WINDOW`` consecutive words of both agree in all but two places,
position by position. A shorter item is a window of its own length: 8 to 12 words must occur
with one substitution at most, fewer words unchanged (``allowed``). Items with the same text
are one class, reported under its smallest id with its size; ``equal_items`` names the members.

Method: a mask fixes which consecutive words are hashed and which are ignored. Long items
have two masks of span 8, a lossless pair: however 2 substitutions fall on 13 words, some
placement of one mask avoids both. An item of 8 to 12 words has three masks as long as it is,
each of which ignores every third word, so that one substitution leaves a mask untouched; a
shorter one has a single mask that ignores nothing. No overlap is missed; ``tests/llm``
enumerates all placements. Only masks of lengths that the benchmark holds are laid over
documents. Hashes of documents and items are joined, and around every hit the windows that
hold the seed are compared word by word, so a hit by chance adds nothing.

Defined cases: null and empty texts have no words and overlap nothing; null ids are kept as
a null key; rows that share a doc_id give one joint answer, and texts that share an item_id
too (``n_items`` is then that of the largest class); an empty benchmark gives no rows. Other
columns are not read.

Scale: documents are read once and stay where they are; a document's words become one array
of hashes, seeds are generated code over it, and only verified hits are shuffled, combined
on the map side. The item side is broadcast while it has at most ``broadcast_seeds`` rows
(counted first; about 250 bytes each); beyond that Spark's shuffled join gives the same rows,
and every seed of a document travels with at most 18 words around it. No Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_side

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
TOLERANCE = 2
SHORT = 8
BEFORE = WINDOW - SPAN
WORD = r"[\p{L}\p{N}]+"


def word_hashes(text):
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def masks(w: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Span and masks for items of ``w`` words; ``WINDOW`` stands for all longer ones."""
    if w >= WINDOW:
        return SPAN, MASKS
    return w, tuple(tuple(i for i in range(w) if i % 3 != k) for k in range(3)) if w >= SHORT else (tuple(range(w)),)


def allowed(w):
    """Substitutions in a window of ``w`` words."""
    return F.when(w >= WINDOW, TOLERANCE).when(w >= SHORT, 1).otherwise(0)


def seeds(df: DataFrame, lengths: list[int], *, of_items: bool = False) -> DataFrame:
    """A row per mask and position ``p`` of the word hashes ``h``, which stay beside it. An
    item has the masks of its own length only.

    The outer form of posexplode keeps Spark from adding a filter on the size of ``h``, for
    which the words would be found and hashed a second time."""
    kept = df.columns
    at = df.select(*kept, F.posexplode_outer("h").alias("p", "word"))
    room, keys = F.size("h") - F.col("p"), []
    for w in lengths:
        span, family = masks(w)
        fits = room >= span
        if of_items:
            fits &= F.size("h") >= w if w == WINDOW else F.size("h") == w
        for k, mask in enumerate(family):
            tag = [F.lit(k)] if w == WINDOW else [F.lit(w), F.lit(k)]
            key = F.xxhash64(*tag, *[F.get("h", F.col("p") + i) for i in mask])
            keys.append(key if lengths == [WINDOW] and not of_items else F.when(fits, key))
    rows = at.filter(room >= min(masks(w)[0] for w in lengths)).select(*kept, "p", F.explode(F.array(*keys)).alias("seed"))
    return rows.filter("seed is not null")


def _around(p, n):
    """First position and count of the words that windows around a seed at ``p`` can hold."""
    first = F.greatest(p - BEFORE, F.lit(0))
    return first, F.least(p + WINDOW, n) - first


def _classes(benchmark: DataFrame) -> DataFrame:
    return benchmark.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(
        F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


def equal_items(benchmark: DataFrame) -> DataFrame:
    """Every row of the benchmark as item_id and class_id, the item that ``overlaps`` reports
    for it."""
    classes = _classes(benchmark).select("text", F.col("item_id").alias("class_id"))
    own = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.join(classes, "text").select("item_id", "class_id")


def overlaps(documents: DataFrame, benchmark: DataFrame, *, broadcast_seeds: int = 200_000) -> DataFrame:
    """doc_id, item_id, n_items (items with that text), overlap_tokens (longest stretch of
    words, first to last qualifying window on one alignment) and matches (most equal words in
    a window), a row for every document and class of items that overlap."""
    items = _classes(benchmark).select("item_id", "n_items", word_hashes(F.col("text")).alias("h"))
    # At most WINDOW numbers.
    w = F.least(F.lit(WINDOW), F.size("h"))
    lengths = sorted(r["w"] for r in items.select(w.alias("w")).distinct().collect() if r["w"]) or [WINDOW]
    first, count = _around(F.col("p"), F.size("h"))
    theirs = seeds(items, lengths, of_items=True).select(
        "seed", "item_id", "n_items", F.col("p").alias("item_p"), first.alias("item_first"),
        w.alias("w"), F.slice("h", first + 1, count).alias("item_words"))
    ours = seeds(documents.select("doc_id", word_hashes(F.col("text")).alias("h")), lengths)
    # Both sides cut to the stretch that they share around the seed.
    first, count = _around(F.col("p"), F.size("h"))
    if theirs.count() <= broadcast_seeds:
        hits, words, begin = ours.join(F.broadcast(theirs), "seed"), "h", F.lit(0)
    else:
        # A seed that is shuffled takes the words around it along, not its document's.
        ours = ours.select("seed", "doc_id", "p", first.alias("first"), count.alias("count"), F.slice("h", first + 1, count).alias("words"))
        hits, words, begin = ours.join(theirs, "seed"), "words", F.col("first")
        first, count = F.col("first"), F.col("count")
    lead = F.least(F.col("p") - first, F.col("item_p") - F.col("item_first"))
    tail = F.least(first + count - F.col("p"), F.col("item_first") + F.size("item_words") - F.col("item_p"))
    # As a generator: the comparison below, which is not generated code, must not be pushed
    # into the join, or every seed would be written out with all words of its document.
    hits = hits.select(F.inline(F.array(F.struct(
        "doc_id", "item_id", "n_items", "w", (F.col("p") - F.col("item_p")).alias("diagonal"), (F.col("item_p") - lead).alias("begin"),
        F.slice(words, F.col("p") - begin - lead + 1, lead + tail).alias("a"),
        F.slice("item_words", F.col("item_p") - F.col("item_first") - lead + 1, lead + tail).alias("b")))))
    equal = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    needed = F.col("w") - allowed(F.col("w"))
    windows = F.get(F.transform(F.array(equal), lambda e: F.filter(
        F.transform(F.sequence(F.lit(0), F.size(e) - F.col("w")), lambda s: F.struct(
            F.aggregate(F.slice(e, s + 1, F.col("w")), F.lit(0), lambda t, x: t + x).alias("matches"), s.alias("s"))),
        lambda x: x["matches"] >= needed)), 0)
    found = hits.filter(F.size("a") >= F.col("w")).select("doc_id", "item_id", "n_items", "diagonal", "w", "begin", windows.alias("found"))
    found = found.filter(F.size("found") > 0)
    lines = found.groupBy("doc_id", "item_id", "diagonal").agg(
        F.min(F.col("begin") + F.get("found", 0)["s"]).alias("start"),
        F.max(F.col("begin") + F.get("found", F.size("found") - 1)["s"] + F.col("w")).alias("end"),
        F.max(F.array_max("found")["matches"]).alias("matches"), F.max("n_items").alias("n_items"))
    return lines.groupBy("doc_id", "item_id").agg(
        F.max("n_items").alias("n_items"),
        F.max(F.col("end") - F.col("start")).cast("long").alias("overlap_tokens"),
        F.max("matches").cast("long").alias("matches"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, shortest: int = 4, **options) -> DataFrame:
    """The documents that overlap no item of ``shortest`` words or more, with all their
    columns. Clean texts hold shorter items, single words and names, as a matter of course."""
    long = benchmark.filter(F.size(word_hashes(F.col("text"))) >= shortest)
    hit = small_side(overlaps(documents, long, **options).select(F.col("doc_id").alias("hit_id")).distinct(), "hits")
    return documents.join(hit, documents["doc_id"].eqNullSafe(hit["hit_id"]), "left_anti")
