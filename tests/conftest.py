import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Do a query and its SQL in DuckDB give the same rows?"""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def tidy(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    def compare(f, sql):
        df = f(spark, SF)
        names = sorted(df.columns)
        ours = sorted((tuple(tidy(r[c]) for c in names) for r in df.collect()), key=repr)
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == names
        theirs = sorted((tuple(tidy(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
        assert ours == theirs
        assert ours

    return compare
