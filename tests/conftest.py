import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", f"file://{root}/warehouse")
        .config("spark.checkpoint.dir", f"file://{root}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


@pytest.fixture(scope="session")
def same_rows(sf_dir):
    """Whether a Spark result and SQL on the same tables have the same columns and rows, in any order."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")

    def check(df, sql):
        found = con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        order = [found.columns.index(c) for c in columns]
        key = lambda row: tuple((v is None, str(v)) for v in row)
        left = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=key)
        right = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=key)
        assert left == right

    return check
