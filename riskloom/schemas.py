"""Schemas of every table that is read from or written to storage."""

from pyspark.sql import types as T

SOURCE_FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

COMMIT_FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("sha", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("message", T.StringType()),
])

INCIDENTS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("caused_by_commit", T.StringType()),
    T.StructField("fixed_by_commit", T.StringType()),
    T.StructField("downtime_minutes", T.LongType()),
    T.StructField("users_affected", T.LongType()),
])

ANNOTATIONS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("notes", T.StringType()),
    T.StructField("override_tier", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("documentation_url", T.StringType()),
])

COVERAGE = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("coverage_percent", T.DoubleType()),
    T.StructField("test_count", T.LongType()),
    T.StructField("has_integration_tests", T.BooleanType()),
])

IMPACTS = ("security_impact", "data_impact", "availability_impact", "user_impact")

ASSESSMENT_BODY = T.StructType(
    [T.StructField(name, T.LongType()) for name in IMPACTS]
    + [
        T.StructField("blast_radius_summary", T.StringType()),
        T.StructField("critical_reason", T.StringType()),
    ]
)

ASSESSMENTS = T.StructType(
    [T.StructField("content_hash", T.StringType())]
    + [T.StructField(name, T.IntegerType()) for name in IMPACTS]
    + [
        T.StructField("blast_radius_summary", T.StringType()),
        T.StructField("critical_reason", T.StringType()),
    ]
)

PR_FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("pr_number", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("lines_added", T.LongType()),
    T.StructField("lines_deleted", T.LongType()),
    T.StructField("is_new", T.BooleanType()),
])

REPO_RUNS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("repo_path", T.StringType()),
    T.StructField("analyzed_at", T.TimestampType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("branch", T.StringType()),
])

_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


FACTORS = _struct(
    dependency_centrality=_struct(
        score="double", import_count="bigint", exported_symbols="bigint"),
    incident_history=_struct(
        score="int", incident_count="bigint", last_incident="timestamp",
        severity_breakdown=T.MapType(T.StringType(), T.LongType())),
    change_frequency=_struct(
        score="int", commit_count="bigint", commits_last_90d="bigint", unique_authors="bigint"),
    user_impact=_struct(
        score="int", user_facing="boolean", affects_auth="boolean", affects_data="boolean",
        affects_payments="boolean"),
    data_sensitivity=_struct(
        score="int", handles_pii="boolean", handles_secrets="boolean",
        handles_financial="boolean"),
    test_coverage=_struct(
        score="int", coverage_percent="double", test_count="bigint",
        has_integration_tests="boolean"),
    complexity=_struct(
        score="int", cyclomatic="bigint", cognitive="bigint", function_count="bigint"),
    blast_radius=_struct(
        score="int", security_impact="int", data_impact="int", availability_impact="int",
        user_impact="int", summary="string", critical_reason="string", assessed="boolean"),
)

_DEPENDENCY = T.ArrayType(_struct(path="string", heat_score="int"))
DEPENDENCIES = _struct(imported_by=_DEPENDENCY, imports=_DEPENDENCY)

RECENT_CHANGES = T.ArrayType(_struct(
    date="timestamp", message="string", author="string", sha="string", pr_number="bigint",
    had_incident="boolean"))

REVIEW = _struct(
    min_reviewers="int", requires_senior="boolean", requires_security_scan="boolean",
    requires_integration_tests="boolean", auto_merge="boolean",
    estimated_review_time_minutes="int")

SIZE = _struct(lines="bigint", bytes="bigint")

# One scored file, nested (the shape of one entry of a saved result document).
FILE_HEAT = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("heat_score", T.IntegerType()),
    T.StructField("tier", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("size", SIZE),
    T.StructField("factors", FACTORS),
    T.StructField("recent_changes", RECENT_CHANGES),
    T.StructField("review_requirements", REVIEW),
])

# A saved result document: one JSON object per repository.
HEAT_DOCUMENT = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("repo_path", T.StringType()),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("commit_sha", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("languages", T.MapType(T.StringType(), T.LongType())),
    ])),
    T.StructField("files", T.MapType(T.StringType(), T.StructType(
        [f for f in FILE_HEAT.fields if f.name != "repo_id"]
        + [T.StructField("dependencies", DEPENDENCIES)]
    ))),
    T.StructField("incidents", T.ArrayType(T.StructType(
        [f for f in INCIDENTS.fields if f.name != "repo_id"]
    ))),
    T.StructField("annotations", T.MapType(T.StringType(), T.StructType(
        [f for f in ANNOTATIONS.fields if f.name != "repo_id"]
    ))),
])

# Parts of a saved result.
RUN_RESULT = T.StructType([
    T.StructField("repo_id", T.StringType()), T.StructField("version", T.StringType()),
    *HEAT_DOCUMENT["metadata"].dataType.fields])
EDGES = T.StructType([
    T.StructField(n, T.StringType()) for n in ("repo_id", "path", "imported_by", "match")])

# The flat scored table, in the order of its columns.
HEAT = (
    "repo_id string, path string, language string, lines bigint, bytes bigint, heat_score int,"
    " tier string, centrality double, import_count bigint, exported_symbols bigint,"
    " incident_score int, incident_count bigint, last_incident timestamp, sev_critical bigint,"
    " sev_high bigint, sev_medium bigint, sev_low bigint, churn_score int, commit_count bigint,"
    " commits_last_90d bigint, unique_authors bigint, user_impact_score int, user_facing boolean,"
    " affects_auth boolean, affects_data boolean, affects_payments boolean, sensitivity_score int,"
    " handles_pii boolean, handles_secrets boolean, handles_financial boolean, coverage_score int,"
    " coverage_percent double, test_count bigint, has_integration_tests boolean,"
    " complexity_score int, cyclomatic bigint, cognitive bigint, function_count bigint,"
    " blast_score int, security_impact int, data_impact int, availability_impact int,"
    " user_impact int, summary string, critical_reason string, assessed boolean, min_reviewers int,"
    " requires_senior boolean, requires_security_scan boolean, requires_integration_tests boolean,"
    " auto_merge boolean, estimated_review_time_minutes int"
)

VERDICTS = _struct(
    repo_id="string", pr_number="bigint", files_changed="bigint", heat_score="int",
    total_lines="bigint", languages="bigint", test_lines="bigint", code_lines="bigint",
    large_diff="boolean", many_languages="boolean", low_test_ratio="boolean",
    no_description="boolean", tier="string", min_reviewers="int", requires_senior="boolean",
    requires_security_scan="boolean", requires_integration_tests="boolean", auto_merge="boolean",
    estimated_review_time_minutes="int", signals=T.ArrayType(T.StringType()), blocked="boolean",
)
