"""Views that turn the given tables into the engine's inputs.

The same text runs in Spark SQL and in DuckDB: ``@name@`` stands for a given table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.staging import stage

AS_OF = "2001-08-02"
DOC_AS_OF = "2024-02-01"

NL, TAB = "chr(10)", "chr(9)"


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for word, by in pairs:
        text = f"replace({text}, ' {word} ', {by})"
    return text


# Words of the documents that become code, by kind of file, so that every metric has
# something to count. Values are SQL expressions.
_PYTHON = [
    ("the", f"{NL} || '  def the_'"), ("of", f"{NL} || '    if of and '"),
    ("de", f"{NL} || {TAB} || 'for de in '"), ("der", f"{NL} || '        while der or '"),
    ("and", f"{NL} || 'import src.utils.f' || CAST(doc_id % 50 AS STRING) || ', '"),
    ("la", f"{NL} || 'from src.user import '"), ("is", f"{NL} || 'except '"),
    ("que", f"{NL} || ' class '"), ("in", f"{NL} || '      try:' || {NL}"),
    ("to", f"{NL} || 'def _to'"), ("for", f"{NL} || 'from __future__ import '"),
    ("it", f"{NL} || '# if it'"), ("und", f"{NL} || 'elif und or '"),
]
_SCRIPT = [
    ("the", "' function the'"), ("of", "' if '"), ("de", "' else if '"), ("and", "' => '"),
    ("la", "' case '"), ("in", "' catch '"), ("to", "' export '"), ("is", "' while '"),
]
_GENERIC = [
    ("the", f"{NL} || '  pub fn '"), ("of", f"{NL} || '}} else if '"),
    ("de", f"{NL} || ' match '"), ("and", "' => '"), ("la", f"{NL} || ' private '"),
    ("in", "' Err('"), ("is", f"{NL} || 'for '"), ("que", f"{NL} || 'catch'"),
    ("to", f"{NL} || 'public '"), ("it", "' pub struct '"), ("der", f"{NL} || 'loop '"),
]
_GO = [
    ("the", f"{NL} || 'func The() {{' || {NL} || {TAB} || 'if a && b {{' || {NL}"),
    ("of", f"{NL} || '}}' || {NL}"), ("and", f"{NL} || {TAB} || 'for {{' || {NL}"),
    ("to", "' || '"), ("in", f"{NL} || {TAB} || 'switch x {{' || {NL} || 'case 1:' || {NL}"),
    ("is", f"{NL} || {TAB} || 'go func() {{' || {NL}"),
    ("it", f"{NL} || {TAB} || 'switch y := x.(type) {{' || {NL} || 'default:' || {NL}"),
    ("was", f"{NL} || 'type Was struct {{' || {NL}"), ("on", f"{NL} || 'var on, On = 1, 2' || {NL}"),
    ("that", f"{NL} || 'func (t T) that() {{ return }}' || {NL}"),
    ("with", "' // if with '"), ("as", "' \"if as\" '"),
]
_GO_HEAD = (
    f"'package p' || {NL} || {NL} || 'import (' || {NL} || {TAB} || '\"fmt\"' || {NL} || {TAB}"
    f" || '\"a/b\"' || {NL} || {TAB} || '\"./f' || CAST(doc_id % 9 AS STRING) || '\"' || {NL}"
    f" || ')' || {NL}"
)

VIEWS = {
    "fx_source_files": """
SELECT source AS repo_id, doc_id,
  'src/' || CASE CAST(floor(doc_id / 20) AS BIGINT) % 10
      WHEN 0 THEN 'auth' WHEN 1 THEN 'api' WHEN 2 THEN 'db' WHEN 3 THEN 'payment'
      WHEN 4 THEN 'utils' WHEN 5 THEN 'user' WHEN 6 THEN 'core' WHEN 7 THEN '.cache'
      WHEN 8 THEN 'vendor' ELSE 'billing' END
  || '/' || CASE CAST(floor(doc_id / 7) AS BIGINT) % 4
      WHEN 0 THEN 'f' WHEN 1 THEN 'handler_' WHEN 2 THEN 'test_' ELSE 'token_' END
  || CAST(doc_id AS STRING)
  || CASE CAST(floor(doc_id / 3) AS BIGINT) % 8
      WHEN 0 THEN '.go' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.rs'
      WHEN 4 THEN '.js' WHEN 5 THEN '.md' WHEN 6 THEN '.java' ELSE '_test.go' END AS path,
  text AS content
FROM @documents@""",
    "fx_code_files": f"""
SELECT repo_id, doc_id, path,
  CASE WHEN path LIKE '%.py' THEN {_replaced("content", _PYTHON)}
       WHEN path LIKE '%.ts' OR path LIKE '%.js' THEN {_replaced("content", _SCRIPT)}
       WHEN path LIKE '%.go' THEN {_GO_HEAD} || {_replaced("content", _GO)}
       ELSE {_replaced("content", _GENERIC)} END AS content
FROM fx_source_files""",
    "fx_doc_commits": """
SELECT repo_id, 'e' || CAST(event_id AS STRING) AS sha, path,
  'u' || CAST(user_id AS STRING) AS author, ts,
  CASE event_type WHEN 'error' THEN 'Resolve crash (#' || CAST(event_id AS STRING) || ')'
       WHEN 'view' THEN 'Merge pull request #' || CAST(event_id AS STRING) || ' from y'
       ELSE 'Extend ' || event_type END AS message
FROM (SELECT *, event_id % (SELECT count(*) FROM @documents@) AS of_doc FROM @events@)
JOIN fx_source_files ON doc_id = of_doc""",
    "fx_doc_incidents": """
SELECT repo_id, path AS file, ts AS date,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium'
       ELSE 'low' END AS severity
FROM (SELECT *, event_id % (SELECT count(*) FROM @documents@) AS of_doc FROM @events@)
JOIN fx_source_files ON doc_id = of_doc
WHERE event_type = 'error' AND value > 40""",
    "fx_part_path": """
SELECT p_partkey, p_size,
  'src/' || CASE p_partkey % 8 WHEN 0 THEN 'auth' WHEN 1 THEN 'api' WHEN 2 THEN 'db'
      WHEN 3 THEN 'payment' WHEN 4 THEN 'utils' WHEN 5 THEN 'user' WHEN 6 THEN 'core'
      ELSE 'billing' END
  || '/p' || CAST(p_partkey AS STRING) AS stem,
  CASE CAST(floor(p_partkey / 8) AS BIGINT) % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.py'
      WHEN 2 THEN '.ts' WHEN 3 THEN '.rs' WHEN 4 THEN '_test.go' ELSE '.java' END AS ext
FROM @part@""",
    "fx_commit_files": """
SELECT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id,
  'sha' || CAST(l_orderkey AS STRING) AS sha, stem || ext AS path,
  'u' || CAST(o_custkey AS STRING) || '@example.com' AS author, o_orderdate AS ts,
  min(CASE WHEN l_linenumber = 1
           THEN 'Merge pull request #' || CAST(l_orderkey AS STRING) || ' from x'
           WHEN l_returnflag = 'R' THEN 'Fix defect (#' || CAST(l_orderkey AS STRING) || ')'
           ELSE 'Add feature' END) AS message
FROM @lineitem@ JOIN @orders@ ON o_orderkey = l_orderkey
  JOIN fx_part_path ON p_partkey = l_partkey
GROUP BY l_orderkey, stem, ext, o_custkey, o_orderdate""",
    "fx_incidents": """
SELECT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, stem || ext AS file,
  l_shipdate AS date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
       WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity
FROM @lineitem@ JOIN @orders@ ON o_orderkey = l_orderkey
  JOIN fx_part_path ON p_partkey = l_partkey
WHERE l_returnflag = 'R' AND l_quantity >= 48""",
    "fx_new_incidents": """
SELECT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, stem || ext AS file,
  CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium'
       WHEN 4 THEN 'low' ELSE 'extreme' END AS severity,
  'order ' || CAST(l_orderkey AS STRING) || ' line ' || CAST(l_linenumber AS STRING)
    || ' supplier ' || CAST(l_suppkey AS STRING) AS description,
  CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN 'yesterday' WHEN 1 THEN ''
       ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date
FROM @lineitem@ JOIN fx_part_path ON p_partkey = l_partkey
WHERE l_returnflag = 'A'""",
    "fx_pr_files": """
SELECT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, l_orderkey AS pr_number,
  stem || ext AS path, CAST(sum(l_quantity) * 3 AS BIGINT) AS lines_added,
  CAST(sum(l_linenumber) * 5 AS BIGINT) AS lines_deleted
FROM @lineitem@ JOIN fx_part_path ON p_partkey = l_partkey
GROUP BY l_orderkey, stem, ext""",
    "fx_numstat": f"""
SELECT repo_id, pr_number,
  CASE WHEN lines_added % 11 = 0 THEN path
       ELSE CASE WHEN lines_added % 7 = 0 THEN '-' ELSE CAST(lines_added AS STRING) END
         || {TAB} || CASE WHEN lines_added % 7 = 0 THEN '-'
                          ELSE CAST(lines_deleted AS STRING) END
         || {TAB} || path END AS value
FROM fx_pr_files""",
    "fx_descriptions": """
SELECT 'r' || CAST(o_orderkey % 4 AS STRING) AS repo_id, o_orderkey AS pr_number,
  CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS description
FROM @orders@""",
    "fx_file_metrics": """
SELECT DISTINCT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, stem || ext AS path,
  CASE ext WHEN '.go' THEN 'Go' WHEN '_test.go' THEN 'Go' WHEN '.py' THEN 'Python'
       WHEN '.ts' THEN 'TypeScript' WHEN '.rs' THEN 'Rust' ELSE 'Java' END AS language,
  CAST(p_size * 10 AS BIGINT) AS lines, CAST(p_size * 320 AS BIGINT) AS bytes,
  'h' || CAST(p_partkey AS STRING) AS content_hash,
  CAST(p_size % 11 AS BIGINT) AS function_count,
  CAST(p_size % 7 AS BIGINT) AS exported_symbols,
  CAST(p_size AS BIGINT) AS cyclomatic, CAST((p_size * 7) % 41 AS BIGINT) AS cognitive
FROM @lineitem@ JOIN fx_part_path ON p_partkey = l_partkey""",
    "fx_import_refs": """
SELECT DISTINCT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, a.stem || a.ext AS path,
  CASE WHEN l_linenumber % 3 = 0 THEN b.stem
       ELSE substring(b.stem || b.ext, CAST(1 + l_orderkey % 9 AS INTEGER), CAST(1 + l_partkey % 40 AS INTEGER)) END AS imp
FROM @lineitem@ JOIN fx_part_path a ON a.p_partkey = l_partkey
  JOIN fx_part_path b ON b.p_partkey = l_suppkey""",
    "fx_coverage": """
SELECT DISTINCT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, stem || ext AS path,
  CAST(p_size * 2 AS DOUBLE) - 0.5 AS coverage_percent, CAST(p_size % 9 AS BIGINT) AS test_count,
  p_partkey % 3 = 0 AS has_integration_tests
FROM @lineitem@ JOIN fx_part_path ON p_partkey = l_partkey
WHERE p_partkey % 4 <> 0""",
    "fx_annotations": """
SELECT DISTINCT 'r' || CAST(l_orderkey % 4 AS STRING) AS repo_id, stem || ext AS path,
  CASE p_partkey % 30 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low'
       WHEN 3 THEN 'unheard-of' END AS override_tier
FROM @lineitem@ JOIN fx_part_path ON p_partkey = l_partkey
WHERE p_partkey % 30 < 5""",
    "fx_responses": """
SELECT 'h' || CAST(c_custkey AS STRING) AS content_hash,
  CASE c_custkey % 5
    WHEN 3 THEN '{"security_impact":150,"data_impact":-10,"availability_impact":50,"user_impact":7,"blast_radius_summary":"","critical_reason":""}'
    WHEN 4 THEN 'no structured answer'
    ELSE CASE c_custkey % 5 WHEN 1 THEN 'Assessment follows: ' ELSE '' END
      || '{"security_impact":' || CAST((c_custkey * 7) % 101 AS STRING)
      || ',"data_impact":' || CAST((c_custkey * 13) % 101 AS STRING)
      || ',"availability_impact":' || CAST((c_custkey * 29) % 101 AS STRING)
      || ',"user_impact":' || CAST((c_custkey * 31) % 101 AS STRING)
      || ',"blast_radius_summary":"s' || CAST(c_custkey AS STRING) || '"'
      || CASE c_custkey % 5 WHEN 2 THEN ',"critical_reason":"cut he'
              ELSE ',"critical_reason":""}' END
  END AS text
FROM @customer@""",
    "fx_odd_responses": f"""
SELECT 'h' || CAST(c_custkey AS STRING) AS content_hash,
  CASE WHEN c_custkey % 4 = 3 THEN 'An answer:' || {NL} ELSE '' END
  || '{{"security_impact":' || CAST(c_custkey % 101 AS STRING) || ',"data_impact":1,'
  || CASE WHEN c_custkey % 4 = 3 THEN ''
          ELSE '"availability_impact":2,"user_impact":3,"blast_radius_summary":"' END
  || CASE c_custkey % 4
       WHEN 0 THEN 'line one' || {NL} || 'line two","critical_reason":"a' || {NL} || {NL} || 'b"}}'
       WHEN 1 THEN 'open, and cut'
       WHEN 2 THEN 'say ' || chr(92) || chr(34) || 'yes, no' ELSE '' END AS text
FROM @customer@""",
    "fx_odd_files": """
SELECT 'r' || CAST(p_partkey % 4 AS STRING) AS repo_id, 'pkg/p' || CAST(p_partkey AS STRING) || '/__init__.py' AS path
FROM @part@""",
    "fx_odd_refs": """
SELECT 'r' || CAST(p_partkey % 4 AS STRING) AS repo_id, 'pkg/main.go' AS path,
  CASE CAST(floor(p_partkey / 4) AS BIGINT) % 4 WHEN 0 THEN './pkg/../pkg/p' WHEN 1 THEN 'pkg//p'
       WHEN 2 THEN 'pkg/./x/../p' ELSE 'x/../pkg/p' END || CAST(p_partkey AS STRING)
  || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '/.' END AS imp
FROM @part@""",
    "fx_chat_bodies": """
SELECT content_hash,
  CASE WHEN length(content_hash) % 3 = 0 THEN '{"choices":[]}'
       ELSE '{"id":"x","choices":[{"index":0,"message":{"role":"assistant","content":"'
         || replace(text, chr(34), chr(92) || chr(34)) || '"}}]}' END AS body
FROM fx_responses""",
    "fx_runs": """
SELECT DISTINCT 'r' || CAST(o_orderkey % 4 AS STRING) AS repo_id,
  '/checkouts/r' || CAST(o_orderkey % 4 AS STRING) AS repo_path,
  CAST(NULL AS TIMESTAMP) AS analyzed_at, 'c' || CAST(o_orderkey % 4 AS STRING) AS commit_sha,
  'main' AS branch
FROM @orders@""",
}


def with_views(names: list[str], body: str, views: dict[str, str] = VIEWS, once: bool = False) -> str:
    """The body with the named views, and all views those need, in front of it; with
    ``once`` (DuckDB only) each is computed a single time."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in re.findall(r"\b\w+\b", views[name]):
            if other in views and other != name:
                need(other)
        ordered.append(name)

    for name in names:
        need(name)
    held = "MATERIALIZED " if once else ""
    ctes = ",\n".join(f"{n} AS {held}({views[n].strip()})" for n in ordered)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


@lru_cache(maxsize=None)
def _table(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Temporary view over a given table, named after its folder."""
    view_name = re.sub(r"\W", "_", f"{name}{sf_dir}")
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view_name)
    return view_name


# Rows of a table for which one more task is asked for, whatever the session's setting.
_TASK_ROWS = 500_000

Table = Callable[[str], DataFrame]


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // _TASK_ROWS + 1)


def _repo(key: Column) -> Column:
    return F.concat(F.lit("r"), (key % 4).cast("string"))


def _named(df: DataFrame, keep: list[str], **keys: str) -> DataFrame:
    """``keep`` and the stem and extension (``<name>_stem``, ``<name>_ext``) that the view of
    the parts gives each key; those are functions of the key, so that no name is shuffled."""
    view_text = VIEWS["fx_part_path"].partition("FROM")[0].partition("p_size,")[2]
    stem, ext = re.split(r" AS stem,", view_text)
    ext = ext.rpartition(" AS ext")[0]
    at = lambda text, key: F.expr(text.replace("p_partkey", key))
    return df.select(*keep, *[c for name, key in keys.items() for c in (
        at(stem, key).alias(f"{name}_stem"), at(ext, key).alias(f"{name}_ext"))])


def _commit_files(table: Table) -> DataFrame:
    """Lines meet parts and orders as numbers, in that order, and are grouped where they met
    the orders; of the messages of a commit, which differ in kind only, the least kind is kept."""
    kind = F.when(F.col("l_linenumber") == 1, 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    lines = table("lineitem").select("l_orderkey", "l_partkey", kind.alias("kind"))
    orders = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    parts = table("part").select(F.col("p_partkey").alias("l_partkey"))
    keys = ["l_orderkey", "l_partkey", "o_custkey", "o_orderdate"]
    n = _tasks(table("lineitem"))
    met = lines.join(parts, "l_partkey", "left_semi").repartition(n, "l_orderkey").join(orders.repartition(n, "l_orderkey"), "l_orderkey")
    order = F.col("l_orderkey").cast("string")
    message = F.when(F.col("kind") == 2, F.concat(F.lit("Merge pull request #"), order, F.lit(" from x"))) \
        .when(F.col("kind") == 1, F.concat(F.lit("Fix defect (#"), order, F.lit(")"))).otherwise("Add feature")
    return _named(met.groupBy(*keys).agg(F.min("kind").alias("kind")), [*keys, "kind"], f="l_partkey").select(
        _repo(F.col("l_orderkey")).alias("repo_id"), F.concat(F.lit("sha"), order).alias("sha"),
        F.concat("f_stem", "f_ext").alias("path"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("author"),
        F.col("o_orderdate").alias("ts"), message.alias("message"))


def _pr_files(table: Table) -> DataFrame:
    """Lines are grouped by the numbers of order and part, where they met the parts."""
    lines = table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    parts = table("part").select(F.col("p_partkey").alias("l_partkey"))
    n = _tasks(table("lineitem"))
    files = lines.repartition(n, "l_partkey").join(parts.repartition(n, "l_partkey"), "l_partkey").groupBy("l_orderkey", "l_partkey").agg(
        (F.sum("l_quantity") * 3).cast("bigint").alias("lines_added"), (F.sum("l_linenumber") * 5).cast("bigint").alias("lines_deleted"))
    return _named(files, ["l_orderkey", "lines_added", "lines_deleted"], f="l_partkey").select(
        _repo(F.col("l_orderkey")).alias("repo_id"), F.col("l_orderkey").alias("pr_number"),
        F.concat("f_stem", "f_ext").alias("path"), "lines_added", "lines_deleted")


def _file_metrics(table: Table) -> DataFrame:
    """The distinct pairs of repository and part are found before the parts are joined."""
    pairs = table("lineitem").select((F.col("l_orderkey") % 4).alias("repo"), "l_partkey").distinct()
    size = F.col("p_size")
    parts = table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size").distinct()
    files = _named(pairs.join(parts, "l_partkey"), ["repo", "l_partkey", "p_size"], f="l_partkey")
    languages = {".go": "Go", "_test.go": "Go", ".py": "Python", ".ts": "TypeScript", ".rs": "Rust"}
    language = F.lit("Java")
    for ext, name in languages.items():
        language = F.when(F.col("f_ext") == ext, name).otherwise(language)
    return files.select(
        F.concat(F.lit("r"), F.col("repo").cast("string")).alias("repo_id"), F.concat("f_stem", "f_ext").alias("path"),
        language.alias("language"), (size * 10).cast("bigint").alias("lines"), (size * 320).cast("bigint").alias("bytes"),
        F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("content_hash"),
        (size % 11).cast("bigint").alias("function_count"), (size % 7).cast("bigint").alias("exported_symbols"),
        size.cast("bigint").alias("cyclomatic"), ((size * 7) % 41).cast("bigint").alias("cognitive"))


def _import_refs(table: Table) -> DataFrame:
    """Importing and imported part travel as numbers; lines are made different where those of
    one importing part met."""
    lines = table("lineitem").select(
        (F.col("l_orderkey") % 4).alias("repo"), "l_partkey", "l_suppkey",
        (1 + F.col("l_orderkey") % 9).cast("int").alias("start"), (F.col("l_linenumber") % 3 == 0).alias("whole"))
    part = lambda key: table("part").select(F.col("p_partkey").alias(key)).distinct()
    n = _tasks(table("lineitem"))
    met = lines.join(part("l_suppkey"), "l_suppkey", "left_semi").repartition(n, "l_partkey") \
        .join(part("l_partkey").repartition(n, "l_partkey"), "l_partkey", "left_semi")
    named = _named(met, ["repo", "l_partkey", "start", "whole"], b="l_suppkey")
    imp = F.when(F.col("whole"), F.col("b_stem")).otherwise(F.substring(
        F.concat("b_stem", "b_ext"), F.col("start"), (1 + F.col("l_partkey") % 40).cast("int")))
    refs = named.select("repo", "l_partkey", imp.alias("imp")).distinct()
    return _named(refs, ["repo", "imp"], a="l_partkey").select(
        F.concat(F.lit("r"), F.col("repo").cast("string")).alias("repo_id"), F.concat("a_stem", "a_ext").alias("path"), "imp")


# Views whose text, taken in its order, shuffles names and groups by them: the same rows, made
# from keys. Names come last.
BUILT: dict[str, Callable[[Table], DataFrame]] = {
    "fx_commit_files": _commit_files, "fx_pr_files": _pr_files,
    "fx_file_metrics": _file_metrics, "fx_import_refs": _import_refs,
}


@lru_cache(maxsize=None)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    if name in BUILT:
        return BUILT[name](lambda t: spark.table(_table(spark, sf_dir, t)))
    return written_view(spark, sf_dir, name)


@lru_cache(maxsize=None)
def written_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same by the view's text."""
    text = with_views([name], f"SELECT * FROM {name}")
    return spark.sql(re.sub(r"@(\w+)@", lambda m: _table(spark, sf_dir, m[1]), text))


@lru_cache(maxsize=None)
def staged_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a written table of several files, as inputs are in real use."""
    cores = spark.sparkContext.defaultParallelism
    return stage(view(spark, sf_dir, name).repartition(cores), name)
