import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, tables):
    """Compares a query with its SQL, run by another engine."""
    import duckdb

    con = duckdb.connect()
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def plain(value):
        if isinstance(value, float) or hasattr(value, "quantize"):
            return round(float(value), 9)
        return tuple(map(plain, value)) if isinstance(value, list) else value

    def check(query, sql):
        df = query(spark, tables)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
        result = con.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(row[k]) for k in at) for row in result.fetchall()), key=repr)

    return check
