"""One query per operator, each over whole given tables through the bindings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import paths, responses, scores, texts
from riskloom.operators import assessments as assess
from riskloom.operators import dependencies, history, imports, incidents
from riskloom.operators import pull_requests as prs
from riskloom.operators import reports, rollups, sources
from riskloom.operators.heat import flatten_heat, nest_heat
from riskloom.plans.analysis import analyze, score_metrics
from riskloom.plans.review import score_prs

from riskloom import schemas
from riskloom.settings import BreakerLimits, Settings, TierThresholds
from riskloom.sources import readers, writers
from riskloom.sources.staging import new_path, stage
from riskloom.streaming.churn import count_stream, daily_churn, day_counts, on_days, recent_commits, sliding_commits
from riskloom.streaming.review import score_stream, verdicts
from verification.bindings import AS_OF, DOC_AS_OF, view

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that fill all four tiers on the given tables.
STATIC = Settings(tiers=TierThresholds(50, 40, 25))
ASSESSED = Settings(tiers=TierThresholds(75, 61, 31))

_ALL: dict[str, Query] = {}


def query(function: Query) -> Query:
    _ALL[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Time stamps without a zone, as the given tables have them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name) for f in df.schema.fields])


class Inputs:
    """The bound input tables of one folder."""

    bind = staticmethod(view)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.bind(self.spark, self.sf_dir, f"fx_{name}")

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps of a query read, written when the first one does."""
        if name not in self._written:
            self._written[name] = stage(build(), name)
        return self._written[name]

    def code(self) -> tuple[DataFrame, DataFrame]:
        """Files and import lines, which resolving, counting and scoring all read."""
        return self.once("file_metrics", lambda: self.file_metrics), self.once("import_refs", lambda: self.import_refs)

    def resolved(self) -> DataFrame:
        if "resolved" not in self._written:
            self._written["resolved"] = imports.resolved_imports(*self.code())
        return self._written["resolved"]

    def edges(self) -> DataFrame:
        return imports.import_edges(*self.code(), self.resolved())

    def heat(self, settings: Settings = STATIC, **extra) -> DataFrame:
        return score_metrics(
            *self.code(), self.commit_files, self.incidents, AS_OF, settings, self.resolved(), **extra)

    def assessments(self) -> DataFrame:
        return assess.accepted(assess.parse_responses(self.responses))

    def assessed_heat(self) -> DataFrame:
        return self.saved("assessed_heat", lambda: self.heat(
            ASSESSED, assessments=self.assessments()))

    def saved(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Computed anew for every query; a benchmark reads the saved table instead."""
        return build()

    def scored(self, settings: Settings = STATIC) -> DataFrame:
        """The full scored table."""
        return self.saved("scored", lambda: self.heat(settings))


# --- source files -----------------------------------------------------------------


@query
def source_inventory(spark, d):
    return sources.inventory(Inputs(spark, d).source_files)


@query
def language_counts(spark, d):
    return sources.language_counts(sources.analysable(Inputs(spark, d).source_files))


@query
def repo_totals(spark, d):
    df = sources.repo_languages(sources.analysable(Inputs(spark, d).source_files))
    return df.select("repo_id", "total_files", F.size("languages").alias("languages"))


@query
def repo_language_map(spark, d):
    """The language counts of every repository, entry by entry."""
    df = sources.repo_languages(sources.analysable(Inputs(spark, d).source_files))
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    entries = F.array_sort(F.map_entries("languages"))
    return df.select("repo_id", F.array_join(F.transform(entries, entry), ",").alias("by_language"))


@query
def test_files(spark, d):
    return Inputs(spark, d).source_files.select(
        "repo_id", "path", paths.is_test(F.col("path")).alias("is_test"))


@query
def assessable_files(spark, d):
    return assess.assessable(Inputs(spark, d).source_files).select("repo_id", "path")


@query
def excluded_files(spark, d):
    path = F.col("path")
    return Inputs(spark, d).source_files.select(
        "repo_id", "path", paths.in_excluded_dir(path, Settings().exclude).alias("excluded"))


@query
def path_risk_flags(spark, d):
    path = F.col("path")
    df = Inputs(spark, d).source_files.select("repo_id", "path").withColumns(
        {**paths.user_impact_flags(path), **paths.sensitivity_flags(path)})
    return df.withColumns({
        "user_impact_score": scores.user_impact_score(
            F.col("user_facing"), F.col("affects_auth"), F.col("affects_data"),
            F.col("affects_payments")),
        "sensitivity_score": scores.data_sensitivity_score(
            F.col("handles_pii"), F.col("handles_secrets"), F.col("handles_financial")),
    })


def _metrics(spark, d, *languages):
    df = sources.source_metrics(Inputs(spark, d).code_files)
    return df.filter(F.col("language").isin(*languages)).select(
        "repo_id", "path", "lines", "bytes", "function_count", "exported_symbols",
        "cyclomatic", "cognitive",
        scores.complexity_score(F.col("cyclomatic"), F.col("cognitive")).alias("complexity_score"))


@query
def text_metrics_python(spark, d):
    return _metrics(spark, d, "Python")


@query
def text_metrics_js(spark, d):
    return _metrics(spark, d, "TypeScript", "JavaScript")


@query
def text_metrics_generic(spark, d):
    return _metrics(spark, d, "Rust", "Java")


@query
def text_metrics_go(spark, d):
    return _metrics(spark, d, "Go")


@query
def text_metrics_html(spark, d):
    """Script metrics of web pages, taken as JavaScript files."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select(
        F.lit("site").alias("repo_id"),
        F.concat(F.lit("pages/p"), F.col("page_id"), F.lit(".js")).alias("path"),
        F.col("html").alias("content"))
    return sources.source_metrics(pages).drop("imports", "content_hash")


@query
def source_imports(spark, d):
    refs = sources.import_refs(sources.source_metrics(Inputs(spark, d).code_files))
    return refs.groupBy("repo_id", "path", "imp").agg(F.count("*").alias("n"))


@query
def content_hashes(spark, d):
    return Inputs(spark, d).source_files.select(
        "repo_id", "path", texts.content_hash(F.col("content")).alias("content_hash"))


# --- history and incidents -----------------------------------------------------------


@query
def file_history(spark, d):
    return history.file_history(Inputs(spark, d).commit_files, AS_OF)


@query
def recent_changes(spark, d):
    return plain(history.recent_changes(Inputs(spark, d).commit_files, AS_OF))


@query
def latest_changes(spark, d):
    changes = history.recent_changes(Inputs(spark, d).commit_files, AS_OF)
    return plain(history.latest_changes(changes).select("repo_id", "path", "rank", "date", "message"))


@query
def commit_messages(spark, d):
    message = F.col("message")
    return Inputs(spark, d).commit_files.select(
        "repo_id", "path", "sha", texts.pr_number(message).alias("pr_number"),
        texts.is_bug_fix(message).alias("bug_fix"), texts.first_line(message).alias("subject"),
        texts.short_sha(F.col("sha")).alias("short_sha"))


@query
def incident_rollup(spark, d):
    return plain(incidents.incident_rollup(Inputs(spark, d).incidents, AS_OF))


@query
def incidents_by_file(spark, d):
    return incidents.by_file(Inputs(spark, d).incidents)


@query
def incidents_of_one_file(spark, d):
    return plain(incidents.for_file(Inputs(spark, d).incidents, "r1", "src/core/p30.rs"))


@query
def incident_counts(spark, d):
    return incidents.counts(Inputs(spark, d).incidents)


@query
def incident_append(spark, d):
    t = Inputs(spark, d)
    good, _ = incidents.split_incidents(incidents.prepare_incidents(t.new_incidents, AS_OF))
    return plain(incidents.number_incidents(good, t.incidents))


@query
def incident_log(spark, d):
    """New incidents appended to a log, and once more behind them; the log read back by id."""
    new, log = Inputs(spark, d).new_incidents, new_path(spark, "incident-log")
    fields = [f for f in schemas.INCIDENTS.fields if f.name in ("repo_id", "id", "file", "date", "severity", "description")]
    schema = T.StructType(fields)
    writers.append_incidents(new, log, spark.createDataFrame([], schema), AS_OF)
    writers.append_incidents(new, log, spark.read.schema(schema).parquet(log), AS_OF)
    return plain(incidents.listed(spark.read.schema(schema).parquet(log)))


def _saved_documents(df: DataFrame, document: Callable[[list[str]], F.Column], name: str) -> str:
    """Folder of JSON documents below ``repo_id=<id>`` folders, some hundred rows in each."""
    path = new_path(df.sparkSession, name)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(df.count() // 2000 + 1))
    columns = [c for c in df.columns if c != "repo_id"]
    df.groupBy("repo_id", part.alias("part")).agg(document(columns).alias("value")).select("repo_id", "value") \
        .write.partitionBy("repo_id").option("maxRecordsPerFile", 1).text(path)
    return path


@query
def incident_files(spark, d):
    """Incident logs saved as JSON arrays, read back."""
    path = _saved_documents(Inputs(spark, d).incidents, lambda c: F.to_json(F.collect_list(F.struct(*c))), "incident-files")
    return plain(readers.read_incidents(spark, path).select("repo_id", "file", "date", "severity"))


@query
def annotation_files(spark, d):
    """Annotations saved as JSON objects keyed by path, read back."""
    keyed = lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "path", F.struct("override_tier", "owner")))))
    owned = Inputs(spark, d).annotations.withColumn("owner", F.concat(F.lit("team "), "path"))
    return readers.read_annotations(spark, _saved_documents(owned, keyed, "annotation-files")).select("repo_id", "path", "override_tier", "owner")


@query
def incident_rejects(spark, d):
    _, bad = incidents.split_incidents(
        incidents.prepare_incidents(Inputs(spark, d).new_incidents, AS_OF))
    return bad.select("repo_id", "file", "severity", "description", "date", "error")


# --- imports --------------------------------------------------------------------------


@query
def import_edges(spark, d):
    t = Inputs(spark, d)
    return t.edges()


@query
def import_edges_cleaned(spark, d):
    """Imports of packages by paths with empty segments, ``.`` and ``..``."""
    t = Inputs(spark, d)
    return imports.import_edges(t.odd_files, t.odd_refs).drop("imp")


@query
def fan_in(spark, d):
    t = Inputs(spark, d)
    return imports.fan_in(*t.code(), t.resolved())


@query
def centrality(spark, d):
    t = Inputs(spark, d)
    return imports.centrality(stage(imports.fan_in(*t.code(), t.resolved()), "fan-in"))


@query
def dependency_heat(spark, d):
    t = Inputs(spark, d)
    return dependencies.dependency_heat(t.edges(), t.once("scored", t.scored))


# --- heat -----------------------------------------------------------------------------


@query
def file_heat(spark, d):
    return plain(Inputs(spark, d).heat())


@query
def file_heat_assessed(spark, d):
    t = Inputs(spark, d)
    return plain(t.heat(ASSESSED, assessments=t.assessments()))


@query
def file_heat_nested(spark, d):
    """The nested shape, flattened again."""
    return plain(flatten_heat(nest_heat(Inputs(spark, d).scored())))


@query
def source_heat(spark, d):
    """The whole job from file contents: metrics, imports, history, incidents, score."""
    t = Inputs(spark, d)
    result = analyze(t.code_files, t.doc_commits, t.doc_incidents, DOC_AS_OF, STATIC)
    return result.heat.select(
        "repo_id", "path", "language", "heat_score", "tier", "centrality", "import_count",
        "incident_score", "churn_score", "commit_count", "unique_authors", "complexity_score",
        "user_impact_score", "sensitivity_score", "coverage_score", "min_reviewers")


@query
def tier_override(spark, d):
    t = Inputs(spark, d)
    heat = t.heat(annotations=t.annotations)
    return heat.select("repo_id", "path", "heat_score", "tier", "min_reviewers", "auto_merge")


@query
def coverage_heat(spark, d):
    t = Inputs(spark, d)
    return t.heat(coverage=t.coverage).select(
        "repo_id", "path", "coverage_percent", "test_count", "has_integration_tests",
        "coverage_score", "heat_score", "tier")


# --- reports --------------------------------------------------------------------------


@query
def list_files(spark, d):
    return reports.list_files(Inputs(spark, d).assessed_heat(), limit=25)


@query
def list_medium_files_limited(spark, d):
    return reports.list_files(Inputs(spark, d).assessed_heat(), tier="medium", limit=3)


@query
def list_high_files(spark, d):
    return reports.list_files(Inputs(spark, d).assessed_heat(), tier="high")


@query
def tier_report(spark, d):
    return reports.tier_report(Inputs(spark, d).assessed_heat(), 20)


@query
def tier_counts(spark, d):
    return reports.tier_counts(Inputs(spark, d).heat())


@query
def tier_bars(spark, d):
    return reports.tier_bars(Inputs(spark, d).heat())


@query
def review_hours(spark, d):
    return reports.review_hours(Inputs(spark, d).heat())


@query
def action_items(spark, d):
    return reports.action_items(Inputs(spark, d).assessed_heat())


@query
def file_facts(spark, d):
    return reports.file_facts(Inputs(spark, d).assessed_heat())


@query
def ranked_facts(spark, d):
    return reports.ranked_facts(Inputs(spark, d).assessed_heat()).select(
        "repo_id", "path", "heat_score", "rank")


@query
def file_search(spark, d):
    facts = reports.file_facts(Inputs(spark, d).assessed_heat())
    return reports.search_facts(facts, tier="medium", query="S1", under="src/a") \
        .select("repo_id", "path", "heat_score", "reason")


@query
def file_detail(spark, d):
    detail = reports.get_file(Inputs(spark, d).assessed_heat(), "r2", "src/db/p2.go")
    return plain(detail.select(
        "repo_id", "path", "heat_score", "tier", "label", "reason", "breakage_impact",
        "needs_human_review", "security_impact", "data_impact", "availability_impact",
        "user_impact", "commits_last_90d", "cyclomatic", "min_reviewers"))


@query
def path_suggestions(spark, d):
    return reports.suggest_paths(Inputs(spark, d).file_metrics, "r1", "auth/p1")


@query
def breakage_impact(spark, d):
    return reports.breakage_impact(Inputs(spark, d).heat())


@query
def impact_bands(spark, d):
    return reports.impact_bands(Inputs(spark, d).assessed_heat())


@query
def dashboard_stats(spark, d):
    t = Inputs(spark, d)
    stats = reports.dashboard_stats(t.once("scored", t.heat), t.runs)
    return stats.select(
        "repo_id", "total", "critical", "high", "medium", "low",
        F.size("languages").alias("languages"),
        F.coalesce(F.try_element_at("languages", F.lit("Go")), F.lit(0)).alias("go_files"),
        "repo_path", "commit_sha", "branch")


# --- pull requests ----------------------------------------------------------------------


@query
def numstat(spark, d):
    return prs.parse_numstat(Inputs(spark, d).numstat)


@query
def pr_file_risk(spark, d):
    t = Inputs(spark, d)
    return prs.pr_file_risk(t.pr_files, t.assessed_heat())


@query
def pr_files_ranked(spark, d):
    t = Inputs(spark, d)
    return prs.hottest_first(prs.pr_file_risk(t.pr_files, t.once("assessed", t.assessed_heat))).select(
        "repo_id", "pr_number", "path", "heat_score", "rank")


@query
def pr_risk(spark, d):
    t = Inputs(spark, d)
    verdicts = score_prs(t.pr_files, t.saved("heat", t.heat), STATIC).verdicts
    return verdicts.withColumn("signals", F.array_join("signals", "; "))


@query
def pr_signals(spark, d):
    t = Inputs(spark, d)
    return prs.pr_signals(score_prs(t.pr_files, t.scored(), STATIC).verdicts)


@query
def pr_described(spark, d):
    """Verdicts with descriptions and other limits; includes pull requests without files."""
    t = Inputs(spark, d)
    settings = Settings(tiers=STATIC.tiers, breakers=BreakerLimits(800, 2, 0.25, True))
    verdicts = score_prs(t.pr_files, t.scored(settings), settings, t.descriptions).verdicts
    return verdicts.select(
        "repo_id", "pr_number", "files_changed", "heat_score", "tier", "blocked",
        F.array_join("signals", "; ").alias("signals"))


# --- assessments ------------------------------------------------------------------------


def _hash_cache(t: Inputs) -> DataFrame:
    """Hashes of every third document, as if those had been assessed before."""
    return t.source_files.filter("doc_id % 3 = 0").select(
        texts.content_hash(F.col("content")).alias("content_hash")).distinct()


@query
def assessment_plan(spark, d):
    t = Inputs(spark, d)
    return assess.plan_assessments(t.source_files, _hash_cache(t)) \
        .select("content_hash", "repo_id", "path", "files")


@query
def assessment_excerpts(spark, d):
    t = Inputs(spark, d)
    return assess.assessable(t.code_files).select(
        "repo_id", "path",
        F.md5(texts.prompt_excerpt(F.col("content"), texts.PROMPT_LINES)).alias("excerpt_md5"))


@query
def assessment_prompts(spark, d):
    t = Inputs(spark, d)
    prompt = texts.assessment_prompt(F.col("path"), F.col("content"))
    return assess.assessable(t.code_files).select(
        "repo_id", "path", F.md5(prompt).alias("prompt_md5"))


@query
def assessments(spark, d):
    return Inputs(spark, d).assessments().withColumn("max_impact", responses.max_impact())


@query
def assessments_of_odd_responses(spark, d):
    """Answers with line breaks inside strings, and answers cut inside a string or behind a comma."""
    return assess.accepted(assess.parse_responses(Inputs(spark, d).odd_responses))


@query
def assessment_rejects(spark, d):
    return assess.rejected(assess.parse_responses(Inputs(spark, d).responses))


@query
def chat_envelopes(spark, d):
    return assess.unwrap_chat(Inputs(spark, d).chat_bodies)


@query
def assessment_merge(spark, d):
    """Cached and fresh assessments in one table, fresh ones first."""
    done = Inputs(spark, d).assessments()
    number = F.substring("content_hash", 2, 20).cast("bigint")
    cached = done.filter(number % 2 == 0).withColumn("critical_reason", F.lit("cached"))
    return assess.merge_assessments(cached, done.filter(number % 3 == 0))


@query
def assessment_merge_whole(spark, d):
    """As before, with all assessments in the cache and every third one fresh as well."""
    done = Inputs(spark, d).assessments()
    number = F.substring("content_hash", 2, 20).cast("bigint")
    cached = done.withColumn("critical_reason", F.lit("cached"))
    return assess.merge_assessments(cached, done.filter(number % 3 == 0))


@query
def assessment_reassessed(spark, d):
    """Every response three times, in batches that differ; the newest readable one wins."""
    answers = Inputs(spark, d).responses
    batches = [(0, F.lit('{"user_impact": 1}')), (1, F.col("text")), (2, F.lit("not readable"))]
    repeated = reduce(DataFrame.unionByName, [
        answers.select("content_hash", text.alias("text"), F.lit(n).cast("bigint").alias("batch"))
        for n, text in batches])
    return assess.accepted(assess.parse_responses(repeated)).select(
        "content_hash", "security_impact", "user_impact")


@query
def assessment_counters(spark, d):
    t = Inputs(spark, d)
    hashed = assess.assessable(t.source_files).select(
        "repo_id", "path", texts.content_hash(F.col("content")).alias("content_hash"))
    return assess.run_counters(
        assess.content_groups(hashed), _hash_cache(t), assess.parse_responses(t.responses))


# --- rollups ----------------------------------------------------------------------------


@query
def dir_rollup(spark, d):
    return rollups.dir_rollup(Inputs(spark, d).scored())


@query
def dir_tier_counts(spark, d):
    return rollups.dir_tier_counts(Inputs(spark, d).scored(), STATIC)


@query
def explorer_dirs(spark, d):
    return rollups.explorer_dirs(Inputs(spark, d).scored())


@query
def module_rollup(spark, d):
    return rollups.module_rollup(Inputs(spark, d).scored())


@query
def module_rollup_by_heat(spark, d):
    return rollups.module_rollup(Inputs(spark, d).scored(), weight="heat")


@query
def treemap_weights(spark, d):
    heat, lines = F.col("heat_score"), F.col("lines")
    return Inputs(spark, d).scored().select(
        "repo_id", "path", scores.treemap_weight(heat, lines, "heat").alias("by_heat"),
        scores.treemap_weight(heat, lines, "lines").alias("by_lines"))


@query
def tree_nodes(spark, d):
    t = Inputs(spark, d)
    return rollups.sort_tree(rollups.tree_nodes(t.once("scored", t.scored)))


@query
def tree_by_name(spark, d):
    t = Inputs(spark, d)
    return rollups.ranked_tree(rollups.tree_nodes(t.once("scored", t.scored)), "name").select(
        "repo_id", "path", "is_dir", "rank")


@query
def tree_by_size(spark, d):
    t = Inputs(spark, d)
    return rollups.ranked_tree(rollups.tree_nodes(t.once("scored", t.scored)), "size").select(
        "repo_id", "path", "is_dir", "rank")


@query
def tree_by_heat(spark, d):
    t = Inputs(spark, d)
    return rollups.ranked_tree(rollups.tree_nodes(t.once("scored", t.scored))).select(
        "repo_id", "path", "is_dir", "rank")


@query
def explorer_listing(spark, d):
    t = Inputs(spark, d)
    return rollups.explorer_listing(t.once("scored", t.scored))


@query
def tree_filter(spark, d):
    t = Inputs(spark, d)
    return rollups.filter_tree(t.once("scored", t.scored), ["critical", "high"])


@query
def tree_search(spark, d):
    t = Inputs(spark, d)
    heat = t.once("scored", t.scored)
    return rollups.search_tree(heat, "AUTH").unionByName(rollups.search_tree(heat, "p77"))


@query
def at_or_above(spark, d):
    return reports.at_or_above(Inputs(spark, d).scored(), "medium").select(
        "repo_id", "path", "tier", scores.tier_rank(F.col("tier")).alias("tier_rank"))


# --- streams ----------------------------------------------------------------------------


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet") \
        .parquet(d).select(
            F.lit("r").alias("repo_id"), F.col("event_type").alias("path"), "ts")


def _daily(spark, d):
    out = new_path(spark, "churn")
    run = daily_churn(_events(spark, d)).writeStream.format("parquet") \
        .option("checkpointLocation", new_path(spark, "churn-log")) \
        .trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("repo_id string, path string, day timestamp, commits bigint").parquet(out)


@query
def churn_stream(spark, d):
    """Daily commit counts from the events table read as a stream."""
    return plain(_daily(spark, d))


@query
def churn_90d_stream(spark, d):
    """Commits of the last 90 days from the stream's daily counts."""
    return recent_commits(_daily(spark, d), DOC_AS_OF)


def _all_days(spark, d):
    out = new_path(spark, "churn")
    count_stream(_events(spark, d), out, new_path(spark, "churn-log")).awaitTermination()
    return day_counts(spark, out)


@query
def churn_stream_all_days(spark, d):
    """Daily commit counts from the stream, the days still open included."""
    return plain(_all_days(spark, d))


@query
def churn_90d_stream_all_days(spark, d):
    """Commits of the last 90 days from the stream, the newest days included."""
    return recent_commits(_all_days(spark, d), DOC_AS_OF)


@query
def heat_saved(spark, d):
    """The scored table, written and read back."""
    path = new_path(spark, "heat")
    writers.write_heat(Inputs(spark, d).scored(), path)
    return plain(readers.read_heat(spark, path))


def _result(spark, d):
    """A whole result, written and read back."""
    t, path = Inputs(spark, d), new_path(spark, "result")
    writers.write_result(path, t.once("scored", t.scored), t.runs, edges=t.edges(), incidents=t.incidents)
    return readers.read_result(spark, path)


@query
def result_metadata(spark, d):
    return _result(spark, d)["metadata"].select(
        "repo_id", "version", "repo_path", "commit_sha", "branch", "total_files",
        F.element_at("languages", "Go").alias("go_files"))


@query
def result_files(spark, d):
    return plain(_result(spark, d)["files"])


@query
def result_dependencies(spark, d):
    return _result(spark, d)["dependencies"]


@query
def assessments_saved(spark, d):
    """Two appended batches of the same contents, read back: the second counts."""
    path = new_path(spark, "assessments")
    done = Inputs(spark, d).assessments()
    writers.append_assessments(done, path, batch=1)
    writers.append_assessments(done.withColumn("critical_reason", F.lit("again")), path, batch=2)
    return readers.read_assessments(spark, path)


@query
def churn_sliding_stream(spark, d):
    """Commits of the last 90 days on every day, from the stream; the feed brings late days."""
    return plain(on_days(sliding_commits(_all_days(spark, d))))


@query
def pr_stream(spark, d):
    """Verdicts of diffs that arrive as a stream of numstat lines."""
    t = Inputs(spark, d)
    feed = new_path(spark, "feed")
    # Lines of one diff are spread over the files, of which a fourth is a batch: a file is
    # written, and its lines are parsed, by one task.
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
    t.numstat.repartition(4 * files, "value").write.parquet(feed)
    lines = spark.readStream.schema("repo_id string, pr_number bigint, value string").option(
        "maxFilesPerTrigger", files).parquet(feed)
    heat = new_path(spark, "heat")
    t.scored().write.parquet(heat)
    out = new_path(spark, "verdicts")
    score_stream(
        prs.parse_numstat(lines), lambda s: s.read.parquet(heat), out,
        new_path(spark, "verdicts-log"), STATIC,
    ).awaitTermination()
    return verdicts(spark, out).select(
        "repo_id", "pr_number", "files_changed", "heat_score", "tier", "blocked",
        F.array_join("signals", "; ").alias("signals"))


def all_queries() -> dict[str, Query]:
    return dict(_ALL)
