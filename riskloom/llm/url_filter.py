"""URL filter: dated list entries become validity intervals, captures are joined as of.

A list entry says that from a day on a pattern is on the list of a category (``add``) or off
it (``remove``). Per pattern and category the entries, in day order, become half-open
intervals during which the pattern is listed. A capture is blocked if any of its patterns is
listed on the day it was fetched, whatever happened to the list later.

Patterns: ``host`` (the whole host), ``domain`` (the host or any host below it) and
``prefix`` (host and path, ending at a slash or at the path's end; query and fragment never
count). All are compared in lower case but for the path.

Defined cases: several entries of one pattern, category and day count as listed if any of
them adds; an entry with a null in any column is ignored; a capture without a URL, host or
day is never blocked; equal captures get equal answers and each keeps its own row; an empty
list blocks nothing; columns of the captures that carry the names of results are replaced.

Scale: after entries are combined by day, a pattern has at most one row for a day and
category. Intervals are cut at year ends and the year is part of the join key, so a capture
meets only the intervals of its own year, at most 183 for a pattern and category. The join
of hot hosts is left to adaptive skew splitting; answers are computed once for a distinct
(url, day) before they go back to the captures. No Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import unused

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
RESULTS = ["blocked", "n_entries", "categories"]


def host_of(url):
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, year, valid_from, valid_to (exclusive; null: still listed).

    ``entries``: kind, pattern, category, action (add or remove), effective (date)."""
    key = ["kind", "pattern", "category"]
    daily = (entries.select(*key, "action", F.col("effective").cast("date").alias("day"))
             .dropna().groupBy(*key, "day").agg(F.max(F.col("action") == "add").alias("listed")))
    turn = Window.partitionBy(*key).orderBy("day")
    return daily.select(*key, F.col("day").alias("valid_from"), F.lead("day").over(turn).alias("valid_to"),
                        "listed").filter("listed").drop("listed")


def _by_year(spans: DataFrame, last: DataFrame) -> DataFrame:
    """Intervals repeated for every year they touch, up to the last year of a capture."""
    bounded = spans.withColumn("last_year", last.scalar())
    end = F.coalesce(F.year(F.date_sub("valid_to", 1)), F.col("last_year"))
    return bounded.withColumn("until", F.least(end, "last_year")).filter(
        F.year("valid_from") <= F.col("until")).select(
        "kind", "pattern", "category", "valid_from", "valid_to",
        F.explode(F.sequence(F.year("valid_from"), F.col("until"))).alias("year"))


def patterns_of(url):
    """Array of (kind, pattern) that a listed entry could name to match this URL."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    labels = F.split(host, r"\.")
    parts = F.split(path, "/")
    count = lambda a: F.sequence(F.lit(1), F.size(a))
    domains = F.transform(count(labels), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(count(parts), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"),
                 F.when(i < F.size(parts), "/").otherwise("")).alias("pattern")))
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.array_distinct(F.concat(whole, domains, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Every capture with blocked, n_entries (listed patterns times categories that match)
    and categories (sorted, comma-joined; empty if none)."""
    captures = captures.drop(*[c for c in captures.columns if c.lower() in RESULTS])
    asked = captures.select(F.col(url).alias("u"), F.col(fetched).cast("date").alias("d")).dropna().distinct()
    asked = asked.filter(host_of(F.col("u")) != "")
    last = captures.agg(F.max(F.year(F.col(fetched).cast("date"))).alias("last_year"))
    probes = asked.select("u", "d", F.year("d").alias("year"), F.inline(patterns_of(F.col("u"))))
    met = probes.join(_by_year(intervals(entries), last), ["kind", "pattern", "year"]).filter(
        (F.col("valid_from") <= F.col("d")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to"))))
    answers = met.groupBy("u", "d").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    # Captures may have columns of any name, also of these.
    u, d = unused(captures.columns, "u", "d")
    answers = answers.withColumnsRenamed({"u": u, "d": d})
    on = (captures[url] == answers[u]) & (captures[fetched].cast("date") == answers[d])
    return captures.join(answers, on, "left").drop(u, d).withColumns({
        "blocked": F.col("n_entries").isNotNull(), "n_entries": F.coalesce("n_entries", F.lit(0)),
        "categories": F.coalesce("categories", F.lit(""))})
