import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate expressions over rows: apply(schema, rows, expr, ...) -> list of tuples."""
    def run(schema, rows, *expressions):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        out = df.select("_i", *[e.alias(f"c{n}") for n, e in enumerate(expressions)])
        found = [tuple(r)[1:] for r in out.orderBy("_i").collect()]
        return [f[0] if len(expressions) == 1 else f for f in found]

    return run
