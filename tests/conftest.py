from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df) -> list[tuple]:
    """Rows with the columns by name, as comparable text; floats to six places."""
    import pandas as pd

    cols = sorted(df.columns)

    def show(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "NULL"
        if isinstance(v, float):  # whole numbers beside nulls are floats in one engine and not in the other
            return str(int(v)) if v.is_integer() else f"{v:.6f}"
        return str(v)

    return sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
