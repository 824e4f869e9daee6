import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("the shared tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(spark_rows, duck_rows):
    """Both frames as sorted tuples of text, floats to nine digits."""
    import pandas as pd

    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if not isinstance(v, list) and pd.isna(v):
            return "~"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    def rows(f):
        f = f[sorted(f.columns)]
        return sorted(tuple(cell(v) for v in r) for r in f.astype(object).itertuples(index=False))

    assert sorted(spark_rows.columns) == sorted(duck_rows.columns)
    a, b = rows(spark_rows), rows(duck_rows)
    assert len(a) == len(b)
    assert a == b
