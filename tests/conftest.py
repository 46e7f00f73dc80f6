import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out


@pytest.fixture(scope="session")
def duck():
    import duckdb

    out = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{DATA}/{name}.parquet"
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return out


def same(spark_df, duck_rel):
    """Rows as multisets, columns by name."""
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def value(v):
        if isinstance(v, float):
            return "null" if v != v else repr(round(v, 6))
        if v is None:
            return "null"
        return str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)

    rows = [sorted(tuple(value(v) for v in r) for r in x[cols].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]
