import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(folder / "shared")).config("spark.local.dir", str(folder / "local")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame_or_tuples, columns=None):
    """Rows as sorted tuples with doubles of nine digits, columns by name."""
    import datetime

    if columns is None:
        columns, data = frame_or_tuples.columns, [tuple(r) for r in frame_or_tuples.collect()]
    else:
        data = frame_or_tuples
    at = [columns.index(c) for c in sorted(columns)]

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") + 0.0
        return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v

    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr), sorted(columns)
