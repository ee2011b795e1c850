"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from bizlens.plans import registry
from bizlens.plans.queries import order_metrics as lines
from bizlens.operators import order_metrics as om
from bizlens.session import build_session

HEADLINE = ["b17_b18_import_report", "c01_totals", "c05_pareto_share", "c08_line_quality", "c08_line_rollup", "c12_delivery", "c14_price_profile", "d03_kpi_facts", "e02_stranger_orders_week",
            "e14_repeat_customer_share", "f06_fact_table", "g11_ranked_list", "h13_ranking_metrics", "j04_j05_projection", "l12_week_actions"]


def metrics_from_raw_lines(spark, sf):
    """The reference's one published run time: raw order lines to orders to repeat, gap and concentration metrics."""
    from pyspark.sql import functions as F

    orders = om.orders_from_lines(lines.raw_lines(spark, sf)).select(F.lit(1).alias("business_id"), "order_id", "day", "customer", F.col("revenue").cast("decimal(18,4)").alias("revenue"))
    out = om.totals(orders).join(om.repeat_customers(orders), "business_id").join(om.days_between_orders(orders), "business_id")
    return out.join(om.concentration(orders), "business_id").join(om.pareto_share(orders), "business_id")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf}/nation.parquet").count()  # session start is not part of any query
    times = {}
    for key in ["order_metrics_from_raw_lines", *HEADLINE]:
        fn = metrics_from_raw_lines if key == "order_metrics_from_raw_lines" else queries[key]
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
