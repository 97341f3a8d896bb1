"""Run queries and their SQL side by side: ``python -m verification.compare DIR [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from verification.oracle import all_sql
from verification.queries import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in data)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str):
    """Number of rows, and the rows only one side has, with the column names."""
    df = all_queries()[name](spark, sf_dir)
    mine = rows(df.columns, df.collect())
    sql = all_sql().get(name)
    if sql is None:
        return sum(mine.values()), None, None, None
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        raise AssertionError(f"columns differ: {sorted(df.columns)} / {sorted(columns)}")
    return sum(mine.values()), mine - theirs, theirs - mine, sorted(columns)


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(all_queries())
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, extra, missing, columns = differences(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}")
            if "-v" in sys.argv:
                traceback.print_exc()
            continue
        took = f"{time.time() - start:.1f}s"
        if extra is None:
            print(f"rows {name}: {n} rows {took}")
        elif not extra and not missing:
            print(f"ok   {name}: {n} rows {took}" + ("  EMPTY" if n == 0 else ""))
        else:
            bad += 1
            print(f"DIFF {name}: {n} rows, only here {sum(extra.values())}, only SQL "
                  f"{sum(missing.values())} {took}\n  {columns}\n  here {list(extra)[:2]}\n"
                  f"  sql  {list(missing)[:2]}")
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
