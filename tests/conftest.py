from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same_as_sql(spark, names: list[str], queries: dict, oracle: dict) -> None:
    """Each query gives on the smallest tables what its SQL gives."""
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    for name in names:
        got = queries[name](spark, str(DATA))
        want = con.sql(oracle[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        a = rows(got.select(*cols))
        at = [want.columns.index(c) for c in cols]
        b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
        assert a == b, name
