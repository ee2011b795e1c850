"""Entry points, registry completeness, point in time, and parity of a few queries with their SQL form."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bizlens.operators import facts as fx
from bizlens.plans.queries.facts import inputs

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    letters = {k[0] for k in q}
    assert letters == set("abcdefghijklmnop")


@needs_data
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "gap_to_best" in df.columns


@needs_data
def test_deleting_the_future_changes_nothing(spark):
    full = inputs(spark, SF)
    ids = ["f_stranger_orders_week", "f_dispatch_delay_days", "f_repeat_customer_share", "f_posts_with_orders"]
    cut = F.lit("2001-07-09").cast("date")
    past = fx.Inputs(full.orders.where(F.col("date") < cut), full.posts.where(F.col("date") < cut), full.leads.where(F.col("created") < cut), full.turned_away.where(F.col("date") < cut),
                     full.stockouts.where(F.col("date") < cut), full.profile, full.snapshots)
    pick = lambda i: sorted(map(str, fx.fact_table(i, facts=ids).where("week_no <= 2").collect()))
    assert pick(full) == pick(past)


@needs_data
@pytest.mark.parametrize("key", ["c05_pareto_share", "d15_response_latency", "e14_repeat_customer_share", "g11_ranked_list", "h13_ranking_metrics", "i03_next_event", "m04_unmet_demand", "p03_streaming_weekly_counts"])
def test_parity(spark, key):
    sys.path.append("/opt/oracle")
    duckdb = pytest.importorskip("duckdb")
    from tools.check_parity import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[key](spark, SF)
    cur = con.execute(entry.oracle_sql()[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
