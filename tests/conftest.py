import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def same(spark_df, duck_rows) -> None:
    """Both hold the same rows and columns, in any order."""
    a, b = spark_df.toPandas(), duck_rows.df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    plain = lambda x: None if pd.api.types.is_scalar(x) and pd.isna(x) else x.item() if hasattr(x, "item") else x
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x
    text = lambda df: sorted(repr([number(plain(x)) for x in row]) for row in df[cols].astype(object).values.tolist())
    assert text(a) == text(b)
