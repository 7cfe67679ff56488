"""Every registered query against its SQL on the smallest tables, and the entry module's contract."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pagesignal.jobs import catalog

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    return df.map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    if name in catalog.SQL:
        pd.testing.assert_frame_equal(plain(got), plain(oracle.execute(catalog.SQL[name]).df()), check_dtype=False)
    else:
        assert len(got)


@pytest.fixture(scope="module")
def few_orders(spark, tmp_path_factory):
    """Six orders of six days, among them multiples of 499 and 501."""
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = ", ".join(f"({k}L, 1L, 'O', 1.5D, timestamp '2024-01-0{d}', '1-URGENT')" for d, k in enumerate((1, 499, 501, 5, 2495, 2505), 1))
    spark.sql(f"SELECT * FROM VALUES {rows} AS o(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_kpi_upsert_has_every_order(spark, few_orders):
    assert {r.t[-1] for r in catalog.QUERIES["kpi_upsert"](spark, few_orders).collect()} == set("123456")


def test_kpi_series_of_geo_has_every_order(spark, few_orders):
    got = {r.metric: r.points for r in catalog.QUERIES["kpi_series_of_geo"](spark, few_orders).collect()}
    assert got == {"1-URGENT": "2024-01-04|1.50,2024-01-05|1.50", "": "2024-01-06|1.50"}


def test_kpi_points_has_every_order(spark, few_orders):
    got = {(r.metric, r.t) for r in catalog.QUERIES["kpi_points"](spark, few_orders).collect()}
    assert got == {("1-URGENT", "2024-01-01"), ("1-URGENT", "2024-01-02"), ("", "2024-01-03")}


def test_pages_of_one_id_stay_apart(spark, oracle, tmp_path):
    spark.sql("SELECT * FROM VALUES (1L, 'one'), (1L, 'two'), (1L, 'two'), (4L, 'four') AS p(page_id, html)").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["read_raw_pages"](spark, str(tmp_path)).toPandas()
    want = oracle.execute(catalog.SQL["read_raw_pages"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_streams_leave_only_results(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("stream-*"))
    rows = catalog.QUERIES["stream_kpi_upsert"](spark, str(SF))
    (folder,) = set(root.glob("stream-*")) - before
    assert [p.name for p in folder.iterdir()] == ["table"] and rows.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]
