import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF_SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir, sql):
    """Rows of a DuckDB query over the Parquet tables of a directory."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con.execute(sql).fetchdf()


def same_rows(ours, theirs, digits=6):
    """Equal columns, and equal rows in any order; floats to some digits."""

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        plain = lambda v: None if v is None or v != v else round(float(v), digits) + 0.0 if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) else v
        return sorted(repr(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False, name=None))

    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
