"""The same results in DuckDB SQL, written another way where there is one.

Lines are unnested and counted one by one, imports are matched by comparing every
import with every path, maxima are windows over a repository: plain and slow on
purpose, as a check on the engine's formulations.
"""

from __future__ import annotations

import re

from riskloom.settings import EXCLUDED_DIRS
from verification.bindings import AS_OF, DOC_AS_OF, VIEWS, with_views

_WS = "(' ' || chr(9) || chr(11) || chr(12) || chr(13))"


def _count(text: str, literal: str) -> str:
    return f"((length({text}) - length(replace({text}, '{literal}', ''))) // {len(literal)})"


def _starts(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"starts_with({text}, '{w}')" for w in words) + ")"


def _any(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _sum(*conditions: str) -> str:
    return "CAST(sum(" + " + ".join(f"CAST({c} AS INTEGER)" for c in conditions) + ") AS BIGINT)"


_BASE = "string_split(path, '/')[-1]"
_IS_TEST = (
    f"(regexp_matches({_BASE}, '(_test\\.go|\\.test\\.ts|\\.test\\.js|\\.spec\\.ts|\\.spec\\.js"
    f"|_test\\.py)$') OR starts_with({_BASE}, 'test_'))"
)
_NOT_ASSESSED = (
    f"({_IS_TEST} OR regexp_matches({_BASE}, '(_test\\.rs|\\.pb\\.go|\\.md|\\.yaml|\\.yml|\\.toml"
    f"|\\.json|\\.lock|\\.sum|\\.mod)$') OR contains({_BASE}, '.generated.'))"
)
_LANGUAGE = """CASE regexp_extract(lower(path), '\\.([^./]*)$', 1)
  WHEN 'go' THEN 'Go' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript'
  WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'rs' THEN 'Rust' ELSE '' END"""
_EXCLUDED = (
    "len(list_filter(string_split(path, '/')[:-2], lambda s: starts_with(s, '.') OR s IN ("
    + ", ".join(f"'{d}'" for d in EXCLUDED_DIRS)
    + ") OR starts_with(s, 'distribution-') OR starts_with(s, 'env')"
    + " OR ends_with(s, '.egg-info'))) > 0"
)
_LINES = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), ''))" \
    " + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END"

_USER = {
    "user_facing": ("api/", "handler", "route", "controller", "endpoint"),
    "affects_auth": ("auth", "jwt", "session", "token", "login", "permission"),
    "affects_data": ("db/", "database", "model", "schema", "migration", "sql"),
    "affects_payments": ("payment", "billing", "checkout", "stripe", "paypal", "transaction"),
}
_SENSITIVE = {
    "handles_pii": ("user", "profile", "personal", "customer", "account"),
    "handles_secrets": ("auth", "secret", "crypto", "key", "token", "credential"),
    "handles_financial": ("payment", "billing", "price", "invoice", "transaction"),
}
_FLAGS = ", ".join(
    f"{_any('path', *words)} AS {name}" for name, words in {**_USER, **_SENSITIVE}.items())
_USER_SCORE = (
    "least(100, CASE WHEN user_facing THEN 40 ELSE 0 END + CASE WHEN affects_auth THEN 30 ELSE 0"
    " END + CASE WHEN affects_data THEN 20 ELSE 0 END + CASE WHEN affects_payments THEN 30 ELSE 0"
    " END)")
_SENSITIVITY_SCORE = (
    "least(100, CASE WHEN handles_pii THEN 50 ELSE 0 END + CASE WHEN handles_secrets THEN 40 ELSE"
    " 0 END + CASE WHEN handles_financial THEN 50 ELSE 0 END)")
_COMPLEXITY = (
    "CAST(trunc(least(cyclomatic / 20e0, 1e0) * 50e0 + least(cognitive / 30e0, 1e0) * 50e0)"
    " AS INTEGER)")


def _tier(score: str, limits: tuple[int, int, int]) -> str:
    c, h, m = limits
    return (f"CASE WHEN {score} >= {c} THEN 'critical' WHEN {score} >= {h} THEN 'high'"
            f" WHEN {score} >= {m} THEN 'medium' ELSE 'low' END")


_RANK = "CASE tier WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_RULES = {
    "min_reviewers": (2, 2, 1, 0),
    "requires_senior": ("true", "false", "false", "false"),
    "requires_security_scan": ("true", "false", "false", "false"),
    "requires_integration_tests": ("true", "true", "false", "false"),
    "auto_merge": ("false", "false", "false", "true"),
    "estimated_review_time_minutes": (60, 45, 20, 5),
}
_REVIEW = ", ".join(
    f"CASE tier WHEN 'critical' THEN {v[0]} WHEN 'high' THEN {v[1]} WHEN 'medium' THEN {v[2]}"
    f" ELSE {v[3]} END AS {name}" for name, v in _RULES.items())


def _weighted(parts: list[tuple[str, int, str]]) -> str:
    weights = [f"(CASE WHEN {on} THEN {w}e0 ELSE 0e0 END)" for _, w, on in parts]
    total = "(" + " + ".join(weights) + ")"
    terms = [f"CAST({s} AS DOUBLE) * ({w} / {total} * 100e0) / 100e0"
             for (s, _, _), w in zip(parts, weights)]
    return f"CAST(trunc(greatest(0e0, least(100e0, {' + '.join(terms)}))) AS INTEGER)"


_HAS_INC = "(incident_count > 0 OR incident_score > 0)"
_HAS_COM = "(commit_count > 0 OR churn_score > 0)"
_STATIC_HEAT = _weighted([
    ("centrality * 100e0", 20, "true"), ("user_impact_score", 20, "true"),
    ("sensitivity_score", 15, "true"), ("complexity_score", 15, "true"),
    ("coverage_score", 10, "true"), ("incident_score", 25, _HAS_INC),
    ("churn_score", 10, _HAS_COM)])
_ASSESSED_HEAT = _weighted([
    ("blast_score", 40, "true"), ("centrality * 100e0", 15, "true"),
    ("complexity_score", 15, "true"), ("coverage_score", 10, "true"),
    ("incident_score", 10, _HAS_INC), ("churn_score", 10, _HAS_COM)])


def _history(commits: str, as_of: str) -> str:
    return f"""
SELECT *, least(100, CAST(trunc(commits_last_90d / 90e0 * 50e0) AS INTEGER)) AS churn_score
FROM (SELECT repo_id, path, count(*) AS commit_count,
        count(*) FILTER (WHERE ts > TIMESTAMP '{as_of}' - INTERVAL 90 DAY) AS commits_last_90d,
        count(DISTINCT author) AS unique_authors
      FROM {commits} GROUP BY repo_id, path)"""


def _incidents(incidents: str, as_of: str) -> str:
    return f"""
SELECT *, CAST(least(100, least(80, 20 * incident_count)
    + CASE WHEN any_recent THEN 20 ELSE 0 END + severity_points) AS INTEGER) AS incident_score
FROM (SELECT repo_id, file AS path, count(*) AS incident_count,
        bool_or(TIMESTAMP '{as_of}' - date < INTERVAL 2160 HOUR) AS any_recent,
        CAST(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5
                 WHEN 'medium' THEN 2 ELSE 0 END) AS BIGINT) AS severity_points,
        max(date) AS last_incident,
        count(*) FILTER (WHERE severity = 'critical') AS sev_critical,
        count(*) FILTER (WHERE severity = 'high') AS sev_high,
        count(*) FILTER (WHERE severity = 'medium') AS sev_medium,
        count(*) FILTER (WHERE severity = 'low') AS sev_low
      FROM {incidents} GROUP BY repo_id, file)"""


def _edges(files: str, refs: str) -> str:
    return f"""
SELECT r.repo_id, r.path AS imported_by, r.imp,
  (SELECT min_by(f.path, CASE WHEN f.path = r.imp || '.py' THEN 1
                              WHEN f.path = r.imp || '.go' THEN 2
                              WHEN f.path = r.imp || '.ts' THEN 3
                              WHEN f.path = r.imp || '.js' THEN 4 ELSE 5 END)
   FROM {files} f WHERE f.repo_id = r.repo_id
     AND f.path IN (r.imp || '.py', r.imp || '.go', r.imp || '.ts', r.imp || '.js',
                    r.imp || '/__init__.py')) AS path, 'exact' AS match
FROM {refs} r
UNION ALL
SELECT r.repo_id, r.path, r.imp, min(h.path), 'loose'
FROM (SELECT *, row_number() OVER () AS line FROM {refs}) r
LEFT JOIN (SELECT i.repo_id, i.imp, f.path FROM (SELECT DISTINCT repo_id, imp FROM {refs}) i
           JOIN {files} f ON f.repo_id = i.repo_id AND contains(f.path, i.imp)
           QUALIFY row_number() OVER (PARTITION BY i.repo_id, i.imp ORDER BY f.path) <= 2) h
  ON h.repo_id = r.repo_id AND h.imp = r.imp AND h.path <> r.path
GROUP BY r.line, r.repo_id, r.path, r.imp"""


def _centrality(edges: str) -> str:
    return f"""
SELECT *, CAST(import_count AS DOUBLE) / max(import_count) OVER (PARTITION BY repo_id) AS centrality
FROM (SELECT repo_id, path, count(*) AS import_count FROM {edges}
      WHERE path IS NOT NULL GROUP BY repo_id, path)"""


def _heat(metrics: str, history: str, incidents: str, centrality: str | None,
          limits: tuple[int, int, int], assessed: bool = False, coverage: bool = False) -> str:
    impacts = ("security_impact", "data_impact", "availability_impact", "user_impact")
    if assessed:
        blast = ("CASE WHEN assessed THEN greatest(security_impact, data_impact,"
                 " availability_impact, user_impact) ELSE 0 END AS blast_score, "
                 + ", ".join(f"CAST(coalesce({i}, 0) AS INTEGER) AS {i}" for i in impacts)
                 + ", coalesce(blast_radius_summary, '') AS summary,"
                 " coalesce(critical_reason, '') AS critical_reason, assessed")
        found = (f"SELECT m.*, a.* EXCLUDE (content_hash), a.content_hash IS NOT NULL AS assessed"
                 f" FROM (SELECT *, CASE WHEN {_NOT_ASSESSED} THEN '' ELSE content_hash END AS h"
                 f" FROM {metrics}) m LEFT JOIN o_assessments a ON a.content_hash = m.h")
    else:
        blast = ("0 AS blast_score, " + ", ".join(f"0 AS {i}" for i in impacts)
                 + ", '' AS summary, '' AS critical_reason, false AS assessed")
        found = f"SELECT * FROM {metrics}"
    fan = (f"LEFT JOIN {centrality} USING (repo_id, path)" if centrality
           else "LEFT JOIN (SELECT NULL AS import_count, NULL AS centrality) ON false")
    cover = "LEFT JOIN fx_coverage USING (repo_id, path)" if coverage else (
        "LEFT JOIN (SELECT NULL AS coverage_percent, NULL AS test_count,"
        " NULL AS has_integration_tests) ON false")
    return f"""
SELECT *, {_REVIEW} FROM (
SELECT *, {_tier('heat_score', limits)} AS tier FROM (
SELECT *, CASE WHEN assessed THEN {_ASSESSED_HEAT} ELSE {_STATIC_HEAT} END AS heat_score FROM (
SELECT *, {_USER_SCORE} AS user_impact_score, {_SENSITIVITY_SCORE} AS sensitivity_score,
  {_COMPLEXITY} AS complexity_score,
  greatest(0, CAST(trunc(100e0 - coverage_percent) AS INTEGER)
    - CASE WHEN has_integration_tests THEN 20 ELSE 0 END) AS coverage_score
FROM (
SELECT repo_id, path, language, lines, bytes, function_count, exported_symbols, cyclomatic,
  cognitive, coalesce(commit_count, 0) AS commit_count,
  coalesce(commits_last_90d, 0) AS commits_last_90d,
  coalesce(unique_authors, 0) AS unique_authors, coalesce(churn_score, 0) AS churn_score,
  coalesce(incident_count, 0) AS incident_count, coalesce(incident_score, 0) AS incident_score,
  last_incident, coalesce(sev_critical, 0) AS sev_critical, coalesce(sev_high, 0) AS sev_high,
  coalesce(sev_medium, 0) AS sev_medium, coalesce(sev_low, 0) AS sev_low,
  CAST(coalesce(import_count, 0) AS BIGINT) AS import_count,
  CAST(coalesce(centrality, 0) AS DOUBLE) AS centrality,
  CAST(coalesce(coverage_percent, 50) AS DOUBLE) AS coverage_percent,
  CAST(coalesce(test_count, 0) AS BIGINT) AS test_count,
  CAST(coalesce(has_integration_tests, false) AS BOOLEAN) AS has_integration_tests,
  {_FLAGS}, {blast}
FROM ({found})
LEFT JOIN {history} USING (repo_id, path)
LEFT JOIN (SELECT * EXCLUDE (any_recent, severity_points) FROM {incidents}) USING (repo_id, path)
{fan}
{cover}
))))"""


_STATIC_LIMITS, _ASSESSED_LIMITS = (50, 40, 25), (75, 61, 31)

_GO_BLANK = ("'(?s)/\\*.*?\\*/|//[^\\n]*|`[^`]*`|\"(?:\\\\.|[^\"\\\\\\n])*\""
             "|''(?:\\\\.|[^''\\\\\\n])*'''")

# The two closing paragraphs of a prompt.
_PROMPT_TASK = """'Suppose a change to this file goes wrong and nobody notices before release. Give four whole numbers from 0 (no effect at all) to 100 (the worst that this kind of system can suffer); 50 is harm that needs a rollback the same day.
- security_impact: could someone read, forge or escalate what they must not?
- data_impact: could stored or transferred data be lost, changed or exposed?
- availability_impact: could a service slow down, hang or stop for others?
- user_impact: would people who use the product notice, and how badly?'"""
_PROMPT_FORM = """'Add blast_radius_summary, at most 80 characters on what else would break, and critical_reason, at most 40 characters, empty unless a number is above 85. Reply with these six fields as a single JSON object, on one line, without other text.'"""

_O_VIEWS = {
    "o_files": f"SELECT *, {_LANGUAGE} AS language FROM fx_source_files "
               f"WHERE language <> '' AND NOT ({_EXCLUDED})",
    "o_code": f"SELECT *, {_LANGUAGE} AS language, CAST({_LINES} AS BIGINT) AS lines,"
              f" CAST(strlen(content) AS BIGINT) AS bytes,"
              f" substr(sha256(content), 1, 32) AS content_hash"
              f" FROM fx_code_files WHERE language <> '' AND NOT ({_EXCLUDED})",
    "o_lines": f"""SELECT *, trim(line, {_WS}) AS t FROM (
        SELECT * EXCLUDE (content), unnest(string_split(content, chr(10))) AS line FROM o_code)""",
    "o_python": f"""
SELECT repo_id, path, any_value(language) AS language, any_value(lines) AS lines,
  any_value(bytes) AS bytes, any_value(content_hash) AS content_hash,
  {_sum("starts_with(t, 'def ')")} AS function_count,
  {_sum("starts_with(t, 'def ') AND NOT starts_with(t, 'def _')", "starts_with(t, 'class ')")}
    AS exported_symbols,
  1 + {_sum(_starts('t', 'if ', 'elif '), _starts('t', 'for ', 'while '), _starts('t', 'except'),
            _count('t', ' and '), _count('t', ' or '))} AS cyclomatic,
  CAST(sum(CASE WHEN {_starts('t', 'if ', 'for ', 'while ', 'try:')}
    THEN 1 + (length(line) - length(ltrim(line, ' ' || chr(9)))) // 4 ELSE 0 END) AS BIGINT)
    AS cognitive
FROM o_lines WHERE language = 'Python' GROUP BY repo_id, path""",
    "o_script": f"""
SELECT repo_id, path, language, lines, bytes, content_hash,
  CAST({_count('content', 'function ')} + {_count('content', '=>')} AS BIGINT) AS function_count,
  CAST({_count('content', 'export ')} AS BIGINT) AS exported_symbols,
  CAST({' + '.join(_count('content', w) for w in
                   ('if ', 'else if ', 'for ', 'while ', 'case ', 'catch '))} AS BIGINT)
    AS cyclomatic, CAST(0 AS BIGINT) AS cognitive
FROM o_code WHERE language IN ('TypeScript', 'JavaScript')""",
    "o_generic": f"""
SELECT repo_id, path, any_value(language) AS language, any_value(lines) AS lines,
  any_value(bytes) AS bytes, any_value(content_hash) AS content_hash,
  {_sum(_starts('t', 'fn ', 'pub fn ', 'func ', 'def ', 'public ', 'private '))}
    AS function_count,
  {_sum(*[_count('line', w) for w in
          ('pub fn ', 'pub struct ', 'pub enum ', 'pub trait ', 'public ')])} AS exported_symbols,
  1 + {_sum(_starts('t', 'if ', '} else if ', 'else if '), _starts('t', 'for ', 'while ', 'loop '),
            "(starts_with(t, 'match ') OR contains(t, '=> '))",
            "(starts_with(t, 'catch') OR contains(t, 'Err('))")} AS cyclomatic,
  CAST(0 AS BIGINT) AS cognitive
FROM o_lines WHERE language IN ('Rust', 'Java') GROUP BY repo_id, path""",
    "o_go_text": f"""
SELECT * EXCLUDE (content), regexp_replace(content, {_GO_BLANK}, ' ', 'g') AS blank FROM o_code
WHERE language = 'Go'""",
    "o_go_lines": """
SELECT repo_id, path, line, n FROM (SELECT repo_id, path, string_split(blank, chr(10)) AS ls
  FROM o_go_text), LATERAL (SELECT unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS n)""",
    # Inside a function: from its first line to the next line that starts with a brace.
    "o_go_marked": """
SELECT *, starts_with(line, 'func ') AND NOT inside_before AS opens FROM (
  SELECT *, coalesce(max(CASE WHEN starts_with(line, 'func ') AND NOT regexp_matches(line, '\\}[ \\t\\r]*$')
             THEN n END) OVER before, 0)
    > coalesce(max(CASE WHEN starts_with(line, '}') THEN n END) OVER before, 0) AS inside_before
  FROM o_go_lines
  WINDOW before AS (PARTITION BY repo_id, path ORDER BY n
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "o_go_body": """
SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY repo_id, path ORDER BY n) AS f
FROM o_go_marked WHERE opens OR inside_before""",
    "o_go_tokens": """
SELECT repo_id, path, f, n, i, tok FROM (
  SELECT repo_id, path, f, n, regexp_extract_all(
      regexp_replace(CASE WHEN opens THEN regexp_replace(line, '^func.*\\{[ \\t\\r]*$|^func', '')
                          ELSE line END,
                     '\\bswitch\\b[^{\\n]*\\.\\(type\\)', ' ', 'g'),
      '\\b(?:if|for|switch)\\b|\\bfunc\\s*\\([^{\\n]*\\{') AS toks FROM o_go_body),
  LATERAL (SELECT unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS i)""",
    "o_go_cost": """
SELECT repo_id, path, CAST(sum(1 + coalesce(deeper, 0)) AS BIGINT) AS cognitive FROM (
  SELECT repo_id, path, sum(CASE WHEN starts_with(tok, 'func') THEN 0 ELSE 1 END) OVER (
    PARTITION BY repo_id, path, f ORDER BY n, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS deeper FROM o_go_tokens)
GROUP BY repo_id, path""",
    "o_go": """
SELECT t.repo_id, t.path, t.language, t.lines, t.bytes, t.content_hash,
  len(regexp_extract_all(blank, '(?m)^func\\b')) AS function_count,
  len(regexp_extract_all(blank, '(?m)^func\\s+(?:\\([^)]*\\)\\s*)?[A-Z]'))
    + coalesce(len(regexp_extract_all(list_aggregate(regexp_extract_all(blank,
        '(?m)^[ \\t]*(?:type|var|const)[ \\t]+(\\w+(?:[ \\t]*,[ \\t]*\\w+)*)', 1), 'string_agg', ' '),
        '\\b[A-Z]')), 0) AS exported_symbols,
  len(regexp_extract_all(blank, '(?m)^func\\b')) + coalesce(b.branches, 0) AS cyclomatic,
  coalesce(c.cognitive, 0) AS cognitive
FROM o_go_text t
LEFT JOIN (SELECT repo_id, path, CAST(sum(len(regexp_extract_all(line,
    '\\b(?:if|for|case)\\b|\\bdefault\\s*:|&&|\\|\\|'))) AS BIGINT) AS branches
  FROM o_go_body GROUP BY repo_id, path) b USING (repo_id, path)
LEFT JOIN o_go_cost c USING (repo_id, path)""",
    "o_metrics": "SELECT * FROM o_python UNION ALL BY NAME SELECT * FROM o_script"
                 " UNION ALL BY NAME SELECT * FROM o_generic UNION ALL BY NAME SELECT * FROM o_go",
    "o_doc_refs": f"""
SELECT repo_id, path, replace(m, '.', '/') AS imp FROM (
  SELECT repo_id, path, CASE WHEN starts_with(t, 'import ') AND ends_with(w, ',')
    THEN left(w, length(w) - 1) ELSE w END AS m
  FROM (SELECT repo_id, path, t, string_split_regex(t, '\\s+')[2] AS w FROM o_lines
        WHERE language = 'Python' AND {_starts('t', 'from ', 'import ')}))
WHERE m <> '' AND NOT starts_with(m, '_')
UNION ALL
SELECT repo_id, path, imp FROM (SELECT repo_id, path, unnest(['fmt', 'a/b',
  './f' || CAST(doc_id % 9 AS STRING)]) AS imp FROM o_code WHERE language = 'Go')
WHERE starts_with(imp, '.') OR NOT contains(imp, '/')""",
    "o_history": _history("fx_commit_files", AS_OF),
    "o_incidents": _incidents("fx_incidents", AS_OF),
    "o_edges": _edges("fx_file_metrics", "fx_import_refs"),
    "o_centrality": _centrality("o_edges"),
    "o_doc_history": _history("fx_doc_commits", DOC_AS_OF),
    "o_doc_incidents": _incidents("fx_doc_incidents", DOC_AS_OF),
    "o_doc_edges": _edges("o_metrics", "o_doc_refs"),
    "o_doc_centrality": _centrality("o_doc_edges"),
    "o_assessments": """
SELECT content_hash,
  CAST(CASE c % 5 WHEN 3 THEN 100 ELSE (c * 7) % 101 END AS INTEGER) AS security_impact,
  CAST(CASE c % 5 WHEN 3 THEN 0 ELSE (c * 13) % 101 END AS INTEGER) AS data_impact,
  CAST(CASE c % 5 WHEN 3 THEN 50 ELSE (c * 29) % 101 END AS INTEGER) AS availability_impact,
  CAST(CASE c % 5 WHEN 3 THEN 7 ELSE (c * 31) % 101 END AS INTEGER) AS user_impact,
  CASE c % 5 WHEN 3 THEN '' ELSE 's' || c END AS blast_radius_summary, '' AS critical_reason
FROM (SELECT content_hash, CAST(substr(content_hash, 2) AS BIGINT) AS c FROM fx_responses)
WHERE c % 5 <> 4""",
    "o_heat": _heat("fx_file_metrics", "o_history", "o_incidents", "o_centrality", _STATIC_LIMITS),
    "o_assessed": _heat("fx_file_metrics", "o_history", "o_incidents", "o_centrality",
                        _ASSESSED_LIMITS, assessed=True),
    "o_covered": _heat("fx_file_metrics", "o_history", "o_incidents", "o_centrality",
                       _STATIC_LIMITS, coverage=True),
    "o_doc_heat": _heat("o_metrics", "o_doc_history", "o_doc_incidents", "o_doc_centrality",
                        _STATIC_LIMITS),
    "o_changes": f"""
SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY ts DESC, sha) AS rank
FROM fx_commit_files WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY""",
    "o_tree": """
SELECT repo_id, path, false AS is_dir, heat_score, tier, lines FROM o_heat
UNION ALL
SELECT repo_id, dir, true, max(heat_score), NULL, 0 FROM o_dirs GROUP BY repo_id, dir""",
    "o_dirs": """
SELECT * FROM (SELECT *, unnest(list_transform(generate_series(1, len(string_split(path, '/')) - 1),
  lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM o_heat)""",
}

_PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_NODE = f"{_PARENT} AS parent, {_BASE} AS name, CAST(len(string_split(path, '/')) AS INTEGER) AS depth"
_REASON = "CASE WHEN assessed AND summary <> '' THEN summary ELSE '' END AS reason"
_HEAT_ORDER = "heat_score DESC, path"
_TIERS = ", ".join(
    f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in ("critical", "high", "medium", "low"))
_HOTTEST_TIER = (f"CASE WHEN max(heat_score) > 0 THEN max_by(tier, heat_score * 10 + {_RANK})"
                 " ELSE 'low' END AS tier")


def _pr_files(heat: str, files: str = "fx_pr_files") -> str:
    return f"""
SELECT repo_id, pr_number, path, lines_added, lines_deleted, false AS is_new,
  coalesce(heat_score, 0) AS heat_score, coalesce(tier, 'low') AS tier,
  coalesce(language, '') AS language, coalesce(summary, '') AS reason,
  coalesce(tier IN ('critical', 'high'), false) AS needs_attention
FROM {files} LEFT JOIN (SELECT repo_id, path, heat_score, tier, language, summary
                        FROM {heat}) USING (repo_id, path)"""


def _pr_risk(heat: str, files: str = "fx_pr_files", limits: tuple = (500, 3, 0.3),
             described: bool = False) -> str:
    lines, languages, ratio = limits
    base = f"""
SELECT repo_id, pr_number, count(*) AS files_changed, max(heat_score) AS heat_score,
  CAST(sum(lines_added + lines_deleted) AS BIGINT) AS total_lines,
  count(DISTINCT CASE WHEN language <> '' THEN language END) AS languages,
  CAST(sum(CASE WHEN {_IS_TEST} THEN lines_added ELSE 0 END) AS BIGINT) AS test_lines,
  CAST(sum(CASE WHEN {_IS_TEST} THEN 0 ELSE lines_added END) AS BIGINT) AS code_lines
FROM ({_pr_files(heat, files)}) GROUP BY repo_id, pr_number"""
    empty = "false"
    if described:
        base = f"""
SELECT repo_id, pr_number, coalesce(files_changed, 0) AS files_changed,
  coalesce(heat_score, 0) AS heat_score, coalesce(total_lines, 0) AS total_lines,
  coalesce(languages, 0) AS languages, coalesce(test_lines, 0) AS test_lines,
  coalesce(code_lines, 0) AS code_lines, description
FROM ({base}) FULL JOIN fx_descriptions USING (repo_id, pr_number)"""
        empty = "trim(coalesce(description, '')) = ''"
    return f"""
SELECT *, {_REVIEW}, tier IN ('critical', 'high') AS blocked, concat_ws('; ',
    CASE WHEN large_diff THEN 'Large diff (>{lines} lines)' END,
    CASE WHEN many_languages THEN 'Many languages (>{languages})' END,
    CASE WHEN low_test_ratio THEN 'Low test ratio (<{ratio})' END,
    CASE WHEN no_description THEN 'No description' END) AS signals
FROM (SELECT *, {_tier('heat_score', _STATIC_LIMITS)} AS tier, total_lines > {lines} AS large_diff,
        languages > {languages} AS many_languages,
        code_lines > 0 AND CAST(test_lines AS DOUBLE) / code_lines < {ratio} AS low_test_ratio,
        {empty} AS no_description
      FROM ({base}))"""


_NUMSTAT = """
SELECT repo_id, pr_number, f[3] AS path, coalesce(TRY_CAST(f[1] AS BIGINT), 0) AS lines_added,
  coalesce(TRY_CAST(f[2] AS BIGINT), 0) AS lines_deleted
FROM (SELECT repo_id, pr_number, string_split_regex(trim(value), '\\s+') AS f FROM fx_numstat)
WHERE len(f) >= 3"""

_INCIDENT_CHECK = f"""
SELECT * EXCLUDE (date), date AS date_text,
  CASE WHEN date = '' THEN TIMESTAMP '{AS_OF}' ELSE TRY_CAST(date AS TIMESTAMP) END AS date
FROM fx_new_incidents"""

_METRIC_COLUMNS = (
    "repo_id, path, lines, bytes, function_count, exported_symbols, cyclomatic, cognitive, "
    f"{_COMPLEXITY} AS complexity_score")

_HEAT_OUT = """
SELECT repo_id, path, language, lines, bytes, heat_score, tier, centrality, import_count,
  exported_symbols, incident_score, incident_count, last_incident, sev_critical, sev_high,
  sev_medium, sev_low, churn_score, commit_count, commits_last_90d, unique_authors,
  user_impact_score, user_facing, affects_auth, affects_data, affects_payments,
  sensitivity_score, handles_pii, handles_secrets, handles_financial, coverage_score,
  coverage_percent, test_count, has_integration_tests, complexity_score, cyclomatic, cognitive,
  function_count, blast_score, security_impact, data_impact, availability_impact, user_impact,
  summary, critical_reason, assessed, min_reviewers, requires_senior, requires_security_scan,
  requires_integration_tests, auto_merge, estimated_review_time_minutes FROM """

_HASH = "substr(sha256(content), 1, 32)"
_EXCERPT = ("CASE WHEN len(string_split(content, chr(10))) > 300 THEN array_to_string("
            "string_split(content, chr(10))[1:300], chr(10)) || chr(10) || '... (truncated)'"
            " ELSE content END")

SQL = {
    "source_inventory": f"""
SELECT repo_id, path, language, CAST({_LINES} AS BIGINT) AS lines,
  CAST(strlen(content) AS BIGINT) AS bytes, {_PARENT} AS dir, {_BASE} AS name,
  array_to_string(string_split(path, '/')[1:2], '/') AS module FROM o_files""",
    "language_counts": "SELECT repo_id, language, count(*) AS files FROM o_files GROUP BY ALL",
    "repo_totals": "SELECT repo_id, count(*) AS total_files,"
                   " CAST(count(DISTINCT language) AS INTEGER) AS languages"
                   " FROM o_files GROUP BY repo_id",
    "repo_language_map": """
SELECT repo_id, string_agg(language || '=' || n, ',' ORDER BY language) AS by_language
FROM (SELECT repo_id, language, count(*) AS n FROM o_files GROUP BY ALL) GROUP BY repo_id""",
    "test_files": f"SELECT repo_id, path, {_IS_TEST} AS is_test FROM fx_source_files",
    "assessable_files": f"SELECT repo_id, path FROM o_files WHERE NOT {_NOT_ASSESSED}",
    "excluded_files": f"SELECT repo_id, path, {_EXCLUDED} AS excluded FROM fx_source_files",
    "path_risk_flags": f"""
SELECT *, {_USER_SCORE} AS user_impact_score, {_SENSITIVITY_SCORE} AS sensitivity_score
FROM (SELECT repo_id, path, {_FLAGS} FROM fx_source_files)""",
    "text_metrics_python": f"SELECT {_METRIC_COLUMNS} FROM o_python",
    "text_metrics_js": f"SELECT {_METRIC_COLUMNS} FROM o_script",
    "text_metrics_generic": f"SELECT {_METRIC_COLUMNS} FROM o_generic",
    "text_metrics_go": f"SELECT {_METRIC_COLUMNS} FROM o_go",
    "text_metrics_html": f"""
SELECT 'site' AS repo_id, 'pages/p' || page_id || '.js' AS path, 'JavaScript' AS language,
  CAST({_LINES} AS BIGINT) AS lines, CAST(strlen(content) AS BIGINT) AS bytes,
  CAST({_count('content', 'function ')} + {_count('content', '=>')} AS BIGINT) AS function_count,
  CAST({_count('content', 'export ')} AS BIGINT) AS exported_symbols,
  CAST({' + '.join(_count('content', w) for w in
                   ('if ', 'else if ', 'for ', 'while ', 'case ', 'catch '))} AS BIGINT)
    AS cyclomatic, CAST(0 AS BIGINT) AS cognitive
FROM (SELECT page_id, html AS content FROM pages)""",
    "source_imports": "SELECT repo_id, path, imp, count(*) AS n FROM o_doc_refs GROUP BY ALL",
    "content_hashes": f"SELECT repo_id, path, {_HASH} AS content_hash FROM fx_source_files",
    "file_history": "SELECT * FROM o_history",
    "recent_changes": """
SELECT repo_id, path, CAST(rank AS INTEGER) AS rank, ts AS date, message, author,
  substr(sha, 1, 7) AS sha,
  CAST(nullif(regexp_extract(message, '#([0-9]+)', 1), '') AS BIGINT) AS pr_number,
  contains(lower(message), 'fix') AS had_incident
FROM o_changes WHERE rank <= 10""",
    "latest_changes": "SELECT repo_id, path, CAST(rank AS INTEGER) AS rank, ts AS date, message"
                      " FROM o_changes WHERE rank <= 5",
    "commit_messages": """
SELECT repo_id, path, sha,
  CAST(nullif(regexp_extract(message, '#([0-9]+)', 1), '') AS BIGINT) AS pr_number,
  contains(lower(message), 'fix') AS bug_fix, message AS subject, substr(sha, 1, 7) AS short_sha
FROM fx_commit_files""",
    "incident_rollup": "SELECT * FROM o_incidents",
    "incidents_by_file":
        "SELECT repo_id, file, count(*) AS incidents FROM fx_incidents GROUP BY ALL",
    "incidents_of_one_file":
        "SELECT * FROM fx_incidents WHERE repo_id = 'r1' AND file = 'src/core/p30.rs'",
    "incident_counts": "SELECT repo_id, count(*) AS incidents FROM fx_incidents GROUP BY repo_id",
    "incident_append": f"""
SELECT repo_id, printf('INC-%d-%03d', year(date), row_number() OVER (PARTITION BY repo_id ORDER BY
    date, md5(file || chr(31) || severity || chr(31) || description))
    + (SELECT count(*) FROM fx_incidents e WHERE e.repo_id = n.repo_id)) AS id,
  file, date, severity, description
FROM ({_INCIDENT_CHECK}) n WHERE date IS NOT NULL AND severity <> 'extreme'""",
    "incident_log": f"""
SELECT repo_id, printf('INC-%d-%03d', year(date), n + again * taken) AS id, file, date, severity, description
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY
    date, md5(file || chr(31) || severity || chr(31) || description)) AS n, count(*) OVER (PARTITION BY repo_id) AS taken
  FROM ({_INCIDENT_CHECK}) WHERE date IS NOT NULL AND severity <> 'extreme'), (VALUES (0), (1)) t(again)""",
    "incident_files": "SELECT repo_id, file, CAST(date AS TIMESTAMP) AS date, severity FROM fx_incidents",
    "annotation_files": "SELECT repo_id, path, override_tier, 'team ' || path AS owner FROM fx_annotations",
    "assessments_of_odd_responses": """
SELECT 'h' || c_custkey AS content_hash, CAST(c_custkey % 101 AS INTEGER) AS security_impact, 1 AS data_impact,
  CASE WHEN k = 3 THEN 0 ELSE 2 END AS availability_impact, CASE WHEN k = 3 THEN 0 ELSE 3 END AS user_impact,
  CASE k WHEN 0 THEN 'line one line two' WHEN 1 THEN 'open, and cut' WHEN 2 THEN 'say "yes, no' ELSE '' END AS blast_radius_summary,
  CASE k WHEN 0 THEN 'a  b' ELSE '' END AS critical_reason
FROM (SELECT *, c_custkey % 4 AS k FROM customer)""",
    "import_edges_cleaned": """
SELECT repo_id, 'pkg/p' || p_partkey || '/__init__.py' AS path, 'pkg/main.go' AS imported_by, 'exact' AS match
FROM (SELECT 'r' || p_partkey % 4 AS repo_id, p_partkey FROM part)""",
    "incident_rejects": f"""
SELECT repo_id, file, severity, description, date_text AS date,
  CASE WHEN date IS NULL THEN 'date must be YYYY-MM-DD'
       ELSE 'severity must be critical, high, medium or low' END AS error
FROM ({_INCIDENT_CHECK}) WHERE date IS NULL OR severity = 'extreme'""",
    "import_edges": "SELECT * FROM o_edges WHERE path IS NOT NULL",
    "fan_in": "SELECT repo_id, path, import_count FROM o_centrality",
    "centrality": "SELECT repo_id, path, import_count, centrality FROM o_centrality",
    "dependency_heat": """
SELECT e.repo_id, e.imported_by, e.path, e.match, coalesce(i.heat_score, 0) AS importer_heat,
  coalesce(t.heat_score, 0) AS heat_score
FROM o_edges e LEFT JOIN o_heat i ON i.repo_id = e.repo_id AND i.path = e.imported_by
  LEFT JOIN o_heat t ON t.repo_id = e.repo_id AND t.path = e.path
WHERE e.path IS NOT NULL""",
    "file_heat": _HEAT_OUT + "o_heat",
    "file_heat_assessed": _HEAT_OUT + "o_assessed",
    "file_heat_nested": _HEAT_OUT + "o_heat",
    "source_heat": """
SELECT repo_id, path, language, heat_score, tier, centrality, import_count, incident_score,
  churn_score, commit_count, unique_authors, complexity_score, user_impact_score,
  sensitivity_score, coverage_score, min_reviewers FROM o_doc_heat""",
    "tier_override": f"""
SELECT repo_id, path, heat_score, tier,
  {', '.join(c for c in _REVIEW.split(', ') if c.endswith(('min_reviewers', 'auto_merge')))}
FROM (SELECT h.repo_id, h.path, h.heat_score,
        CASE WHEN override_tier IN ('critical', 'high', 'medium', 'low') THEN override_tier
             ELSE h.tier END AS tier
      FROM o_heat h LEFT JOIN fx_annotations USING (repo_id, path))""",
    "coverage_heat": """
SELECT repo_id, path, coverage_percent, test_count, has_integration_tests, coverage_score,
  heat_score, tier FROM o_covered""",
    "list_files": f"""
SELECT repo_id, path, heat_score, tier, {_REASON}, least(25, n) AS count, n > 25 AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_HEAT_ORDER}) AS rn,
        count(*) OVER (PARTITION BY repo_id) AS n FROM o_assessed) WHERE rn <= 25""",
    "list_high_files": f"""
SELECT repo_id, path, heat_score, tier, {_REASON}, n AS count, n < files AS truncated
FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS files,
        count(*) FILTER (WHERE tier = 'high') OVER (PARTITION BY repo_id) AS n FROM o_assessed)
WHERE tier = 'high'""",
    "list_medium_files_limited": f"""
SELECT repo_id, path, heat_score, tier, {_REASON}, least(3, n) AS count, least(3, n) < files AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier ORDER BY {_HEAT_ORDER}) AS rn,
        count(*) OVER (PARTITION BY repo_id) AS files,
        count(*) OVER (PARTITION BY repo_id, tier) AS n FROM o_assessed)
WHERE tier = 'medium' AND rn <= 3""",
    "tier_report": f"""
SELECT repo_id, tier, path, heat_score, summary AS reason, n AS tier_files,
  greatest(0, n - 20) AS more, upper(tier) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier ORDER BY {_HEAT_ORDER}) AS rn,
        count(*) OVER (PARTITION BY repo_id, tier) AS n FROM o_assessed) WHERE rn <= 20""",
    "tier_counts":
        f"SELECT repo_id, count(*) AS total, {_TIERS} FROM o_heat GROUP BY repo_id",
    "tier_bars": """
SELECT repo_id, tier, files, CASE WHEN files > 0 THEN greatest(
    CAST(files AS DOUBLE) / max(files) OVER (PARTITION BY repo_id) * 100e0, 8e0) ELSE 0e0 END AS width
FROM (SELECT r.repo_id, t.tier, count(h.path) AS files
      FROM (SELECT DISTINCT repo_id FROM o_heat) r
      CROSS JOIN (SELECT unnest(['critical', 'high', 'medium', 'low']) AS tier) t
      LEFT JOIN o_heat h ON h.repo_id = r.repo_id AND h.tier = t.tier GROUP BY ALL)""",
    "review_hours": """
SELECT repo_id, CAST(sum(estimated_review_time_minutes) AS BIGINT) AS minutes,
  CAST(sum(estimated_review_time_minutes) AS DOUBLE) / 60e0 AS hours
FROM o_heat GROUP BY repo_id""",
    "action_items": f"""
SELECT repo_id, path, heat_score, tier, {_REASON}, CAST(rn AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_HEAT_ORDER}) AS rn
      FROM o_assessed WHERE NOT auto_merge) WHERE rn <= 5""",
    "file_facts": f"""
SELECT repo_id, path, {_PARENT} AS dir, {_BASE} AS name, heat_score, tier, summary AS reason,
  critical_reason AS crit_reason, security_impact AS security, data_impact AS data,
  availability_impact AS availability, user_impact AS user, auto_merge,
  min_reviewers AS reviewers, greatest(lines, 10) AS lines, language, cyclomatic AS complexity,
  import_count AS imported_by FROM o_assessed""",
    "ranked_facts": f"""
SELECT repo_id, path, heat_score, row_number() OVER (PARTITION BY repo_id ORDER BY {_HEAT_ORDER}) AS rank
FROM o_assessed""",
    "pr_files_ranked": f"""
SELECT repo_id, pr_number, path, heat_score,
  row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY heat_score DESC, path) AS rank
FROM ({_pr_files("o_assessed")})""",
    "file_search": f"""
SELECT repo_id, path, heat_score, summary AS reason FROM o_assessed
WHERE tier = 'medium' AND (contains(lower(path), 's1') OR contains(lower(summary), 's1'))
  AND starts_with({_PARENT}, 'src/a')""",
    "file_detail": f"""
SELECT repo_id, path, heat_score, tier, upper(tier) AS label, {_REASON},
  import_count AS breakage_impact, NOT auto_merge AS needs_human_review, security_impact,
  data_impact, availability_impact, user_impact, commits_last_90d, cyclomatic, min_reviewers
FROM o_assessed WHERE repo_id = 'r2' AND path = 'src/db/p2.go'""",
    "path_suggestions": """
SELECT repo_id, path FROM fx_file_metrics WHERE repo_id = 'r1' AND contains(path, 'auth/p1')
ORDER BY path LIMIT 5""",
    "breakage_impact": "SELECT repo_id, path, import_count AS breakage_impact FROM o_centrality",
    "impact_bands": "SELECT repo_id, path, " + ", ".join(
        f"{i}_impact, CASE WHEN {i}_impact >= 80 THEN 'critical' WHEN {i}_impact >= 60 THEN 'high'"
        f" WHEN {i}_impact >= 40 THEN 'medium' ELSE 'low' END AS {i}_band"
        for i in ("security", "data", "availability", "user")) + " FROM o_assessed WHERE assessed",
    "dashboard_stats": f"""
SELECT repo_id, total, critical, high, medium, low, languages, go_files, repo_path, commit_sha,
  branch
FROM (SELECT repo_id, count(*) AS total, {_TIERS}, CAST(count(DISTINCT language) AS INTEGER) AS languages,
        count(*) FILTER (WHERE language = 'Go') AS go_files FROM o_heat GROUP BY repo_id)
LEFT JOIN fx_runs USING (repo_id)""",
    "numstat": _NUMSTAT,
    "pr_file_risk": _pr_files("o_assessed"),
    "pr_risk": "SELECT * FROM (" + _pr_risk("o_heat") + ")",
    "pr_signals": f"""
SELECT repo_id, pr_number, CAST(i - 1 AS INTEGER) AS pos, s[i] AS signal
FROM (SELECT repo_id, pr_number, s, unnest(generate_series(1, len(s))) AS i
      FROM (SELECT repo_id, pr_number, string_split(signals, '; ') AS s
            FROM ({_pr_risk("o_heat")}) WHERE signals <> ''))""",
    "pr_described": f"""
SELECT repo_id, pr_number, files_changed, heat_score, tier, blocked, signals
FROM ({_pr_risk("o_heat", limits=(800, 2, 0.25), described=True)})""",
    "assessment_plan": f"""
SELECT content_hash, repo_id, path, files
FROM (SELECT {_HASH} AS content_hash, repo_id, path, count(*) OVER h AS files,
        row_number() OVER (h ORDER BY repo_id, path) AS rn
      FROM o_files WHERE NOT {_NOT_ASSESSED} WINDOW h AS (PARTITION BY {_HASH}))
WHERE rn = 1 AND content_hash NOT IN (SELECT {_HASH} FROM fx_source_files WHERE doc_id % 3 = 0)""",
    "assessment_excerpts":
        f"SELECT repo_id, path, md5({_EXCERPT}) AS excerpt_md5 FROM o_code"
        f" WHERE NOT {_NOT_ASSESSED}",
    "assessment_prompts": f"""
SELECT repo_id, path, md5('Source file ' || path || ':' || repeat(chr(10), 2) || content
  || repeat(chr(10), 2) || {_PROMPT_TASK} || repeat(chr(10), 2) || {_PROMPT_FORM}) AS prompt_md5
FROM o_code WHERE NOT {_NOT_ASSESSED}""",
    "assessment_reassessed": """
SELECT r.content_hash, coalesce(security_impact, 0) AS security_impact, coalesce(user_impact, 1) AS user_impact
FROM fx_responses r LEFT JOIN o_assessments USING (content_hash)""",
    "assessments": """
SELECT *, greatest(security_impact, data_impact, availability_impact, user_impact) AS max_impact
FROM o_assessments""",
    "assessment_rejects":
        "SELECT content_hash, text FROM fx_responses WHERE text = 'no structured answer'",
    "chat_envelopes": """
SELECT content_hash, CASE WHEN length(content_hash) % 3 <> 0 THEN text END AS text
FROM fx_responses""",
    "assessment_merge": """
SELECT content_hash, security_impact, data_impact, availability_impact, user_impact,
  blast_radius_summary, CASE WHEN c % 3 = 0 THEN critical_reason ELSE 'cached' END AS critical_reason
FROM (SELECT *, CAST(substr(content_hash, 2) AS BIGINT) AS c FROM o_assessments)
WHERE c % 2 = 0 OR c % 3 = 0""",
    "assessment_merge_whole": """
SELECT content_hash, security_impact, data_impact, availability_impact, user_impact,
  blast_radius_summary, CASE WHEN c % 3 = 0 THEN critical_reason ELSE 'cached' END AS critical_reason
FROM (SELECT *, CAST(substr(content_hash, 2) AS BIGINT) AS c FROM o_assessments)""",
    "assessment_counters": f"""
SELECT (SELECT count(*) FROM o_files WHERE NOT {_NOT_ASSESSED} AND {_HASH} IN
          (SELECT {_HASH} FROM fx_source_files WHERE doc_id % 3 = 0)) AS cached,
  (SELECT count(*) FROM o_assessments) AS assessed,
  (SELECT count(*) FROM fx_responses WHERE text = 'no structured answer') AS failed""",
    "dir_rollup": """
SELECT repo_id, dir, max(heat_score) AS max_heat, count(*) AS files,
  CAST(len(string_split(dir, '/')) AS INTEGER) AS depth FROM o_dirs GROUP BY repo_id, dir""",
    "dir_tier_counts": f"""
SELECT *, {_tier('max_heat', _STATIC_LIMITS)} AS tier FROM (
SELECT repo_id, dir, max(heat_score) AS max_heat, {_TIERS} FROM o_dirs GROUP BY repo_id, dir)""",
    "explorer_dirs": f"""
SELECT repo_id, dir, max(heat_score) AS max_heat, {_HOTTEST_TIER}, count(*) AS files,
  {_PARENT.replace('path', 'dir')} AS parent FROM o_dirs GROUP BY repo_id, dir""",
    "module_rollup": f"""
SELECT repo_id, array_to_string(string_split(path, '/')[1:2], '/') AS module,
  CAST(sum(greatest(lines, 10)) AS DOUBLE) AS total_weight, max(heat_score) AS max_heat,
  {_HOTTEST_TIER}, count(*) AS files FROM o_heat GROUP BY repo_id, module""",
    "module_rollup_by_heat": f"""
SELECT repo_id, array_to_string(string_split(path, '/')[1:2], '/') AS module,
  CAST(sum(greatest(heat_score * heat_score, 50)) AS DOUBLE) / 10e0 AS total_weight,
  max(heat_score) AS max_heat, {_HOTTEST_TIER}, count(*) AS files
FROM o_heat GROUP BY repo_id, module""",
    "treemap_weights": """
SELECT repo_id, path, greatest(heat_score * heat_score / 10e0, 5e0) AS by_heat,
  CAST(greatest(lines, 10) AS DOUBLE) AS by_lines FROM o_heat""",
    "tree_nodes": f"SELECT *, {_NODE} FROM o_tree",
    "tree_by_name": f"""
SELECT repo_id, path, is_dir, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, name) AS rank
FROM (SELECT *, {_NODE} FROM o_tree)""",
    "tree_by_size": f"""
SELECT repo_id, path, is_dir, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, lines DESC, name) AS rank
FROM (SELECT *, {_NODE} FROM o_tree)""",
    "tree_by_heat": f"""
SELECT repo_id, path, is_dir, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, heat_score DESC, name) AS rank
FROM (SELECT *, {_NODE} FROM o_tree)""",
    "explorer_listing": f"""
SELECT *, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, heat_score DESC, name) AS rank
FROM (SELECT *, {_BASE} AS name FROM (
  SELECT repo_id, dir AS path, true AS is_dir, max(heat_score) AS heat_score, {_HOTTEST_TIER},
    count(*) AS files, {_PARENT.replace('path', 'dir')} AS parent FROM o_dirs GROUP BY repo_id, dir
  UNION ALL SELECT repo_id, path, false, heat_score, tier, 1, {_PARENT} FROM o_heat))""",
    "tree_filter": f"""
SELECT *, {_NODE} FROM (
SELECT repo_id, path, false AS is_dir, heat_score, tier, lines FROM o_heat
WHERE tier IN ('critical', 'high')
UNION ALL
SELECT repo_id, dir, true, max(heat_score), NULL, 0 FROM o_dirs
WHERE tier IN ('critical', 'high') GROUP BY repo_id, dir)""",
    "tree_search": f"""
SELECT *, {_NODE} FROM o_tree WHERE contains(lower({_BASE}), 'auth')
UNION ALL SELECT *, {_NODE} FROM o_tree WHERE contains(lower({_BASE}), 'p77')""",
    "at_or_above": f"SELECT repo_id, path, tier, {_RANK} AS tier_rank FROM o_heat"
                   " WHERE tier <> 'low'",
    # One micro-batch: only days that the watermark (latest event less one day) has passed.
    "churn_stream": """
SELECT 'r' AS repo_id, path, day, count(*) AS commits
FROM (SELECT event_type AS path, date_trunc('day', ts) AS day FROM events)
WHERE day + INTERVAL 1 DAY
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
GROUP BY path, day""",
    "churn_90d_stream": f"""
SELECT 'r' AS repo_id, path, count(*) AS commits_last_90d
FROM (SELECT event_type AS path, date_trunc('day', ts) AS day FROM events)
WHERE day >= TIMESTAMP '{DOC_AS_OF}' - INTERVAL 90 DAY AND day + INTERVAL 1 DAY
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
GROUP BY path""",
    "churn_stream_all_days": """
SELECT 'r' AS repo_id, event_type AS path, date_trunc('day', ts) AS day, count(*) AS commits
FROM events GROUP BY ALL""",
    "churn_90d_stream_all_days": f"""
SELECT 'r' AS repo_id, event_type AS path, count(*) AS commits_last_90d
FROM events WHERE date_trunc('day', ts) >= TIMESTAMP '{DOC_AS_OF}' - INTERVAL 90 DAY
GROUP BY ALL""",
    "churn_sliding_stream": """
SELECT repo_id, path, CAST(day AS TIMESTAMP) AS day, CAST(sum(n) AS BIGINT) AS commits_last_90d
FROM (SELECT repo_id, path, n, unnest(range(first, first + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS day
      FROM (SELECT 'r' AS repo_id, event_type AS path, date_trunc('day', CAST(ts AS TIMESTAMP)) AS first, count(*) AS n FROM events GROUP BY ALL))
GROUP BY ALL""",
    "result_metadata": """
SELECT repo_id, '1.0.0' AS version, repo_path, commit_sha, branch, total_files, go_files
FROM (SELECT repo_id, count(*) AS total_files, nullif(count(*) FILTER (WHERE language = 'Go'), 0) AS go_files
      FROM o_heat GROUP BY repo_id) FULL JOIN fx_runs USING (repo_id)""",
    "result_files": _HEAT_OUT + "o_heat",
    "result_dependencies":
        "SELECT repo_id, path, imported_by, match FROM o_edges WHERE path IS NOT NULL",
    "heat_saved": _HEAT_OUT + "o_heat",
    "assessments_saved": """
SELECT * REPLACE ('again' AS critical_reason) FROM o_assessments""",
    "pr_stream": f"""
SELECT repo_id, pr_number, files_changed, heat_score, tier, blocked, signals
FROM ({_pr_risk("o_heat", files="o_numstat")})""",
}
_O_VIEWS["o_numstat"] = _NUMSTAT

_EVERY = {**VIEWS, **_O_VIEWS}


def all_sql() -> dict[str, str]:
    out = {}
    for name, body in SQL.items():
        used = [n for n in dict.fromkeys(re.findall(r"\b[fo][x]?_\w+\b", body)) if n in _EVERY]
        out[name] = re.sub(r"@(\w+)@", r"\1", with_views(used, body, _EVERY, once=True))
    return out
