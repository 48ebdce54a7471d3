from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture
def oracle():
    """Rows of a SQL query over DataFrames given by table name, or over the Parquet tables of a folder."""
    import duckdb

    def run(sql: str, tables: dict | str) -> list[tuple]:
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        if isinstance(tables, str):
            for t in sorted(os.listdir(tables)):
                at = f"{tables}/{t}"
                con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
        else:
            for name, df in tables.items():
                con.register(name, df.toArrow())
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=repr)

    return run


@pytest.fixture
def rows_of():
    def run(df) -> list[tuple]:
        names = sorted(df.columns)
        return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)

    return run
