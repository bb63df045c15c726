"""The driver contract: entry, registered queries and their oracles."""

from __future__ import annotations

import duckdb

import __spark_entry__ as E
from sylva.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()  # of the core's own queries


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(q)
    assert set(QUERIES) - set(o) == ROWS_ONLY
    assert set(o) <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["change", "source_path", "dest_path", "size", "kind_changed"]
    assert df.count() > 0


def _rows(df):
    return sorted(tuple("NULL" if v is None else str(v) for v in r) for r in df)


def test_some_oracles_at_smoke_scale(spark):
    con = duckdb.connect()
    for t in ["documents", "orders", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["sync_report", "track", "change_totals", "snapshot_diff_orders", "common_parent"]:
        sp = E.queries()[name](spark, SF)
        cols = sorted(sp.columns)
        got = _rows(sp.select(*cols).collect())
        want = _rows(con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall())
        assert got == want, name


def test_fixture_counts_at_sf001(spark):
    """The counts FIXTURES.md gives for the derived document inventories."""
    from pyspark.sql import functions as F

    from sylva.plans import sync
    from sylva.sources import testdata as T

    sf = "/root/testdata/sf0.01"
    src, dst = T.documents_src(spark, sf), T.documents_dst(spark, sf)
    assert src.where("not is_dir").count() == 1000 and dst.where("not is_dir").count() == 900
    rules = [(1, "in", "/backup", None), (2, "add", "/lake/**", None)]
    res = sync.check(src, dst, rules, renames=False)
    files = res.pairs.where(F.coalesce(~F.col("s_is_dir"), F.lit(True)) & F.coalesce(~F.col("d_is_dir"), F.lit(True)))
    same = files.where("source_path is not null and d_is_dir is not null and equal").count()
    by = {r.change: r["count"] for r in res.changes.where("not is_dir").groupBy("change").count().collect()}
    assert (same, by.get("add"), by.get("delete"), by.get("modify")) == (606, 288, 188, 106)
    renames = sync.check(src, dst, rules).public.where("change = 'rename'").count()
    assert renames == 94
    fast = sync.check(src, dst, rules, mode="fast", renames=False).pairs
    both = fast.where("source_path is not null and d_is_dir is not null and not s_is_dir and not d_is_dir")
    assert (both.where("equal").count(), both.count()) == (356, 712)
