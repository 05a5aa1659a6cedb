"""Catalog queries against DuckDB where the driver's tables are."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tideline.plans import catalog

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v != v or v is pd.NaT:
            return "-"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(show(v) for v in row) for row in df.itertuples(index=False, name=None))


@needs_data
@pytest.mark.parametrize("name", ["flagship", "annotate", "bucket_18mo", "rule_guard_all", "fill_backward_limit1", "findings", "standardize", "asof_level", "interval_mean", "diff_points", "autocorr", "histogram", "hdi", "rhat", "ancestors", "instruments", "staleness", "semantic_scores", "validate_rows", "worker_output", "compare_sides", "law_origins", "worker_states", "read_sources", "screens"])
def test_query_matches_its_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_histogram_at_the_edges_of_bins(spark, tmp_path):
    """Cents whose quotient by the bin's width isn't the whole number that it is on paper."""
    cents = {"a": [0, 9, 18, 27, 27], "b": [0, 15, 30, 45, 0], "c": [0, 3, *[1] * 14, 5], "d": [1, *range(1, 577), 251, 251]}
    rows = pd.DataFrame([(k, c / 100) for k, v in cents.items() for c in v], columns=["event_type", "value"])
    rows.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = catalog.queries()["histogram"](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()["histogram"]).df()
    assert normal(got) == normal(want)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
