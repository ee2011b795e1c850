"""Section C in SQL."""

from __future__ import annotations

from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views

register("order_list", ("biz_order",), """
    SELECT business_id, order_id, date AS day, CASE WHEN order_id % 29 <> 0 THEN buyer_ref END AS customer, total AS revenue FROM biz_order""")
register("cust", ("order_list",), "SELECT business_id, customer, count(*) AS n, sum(revenue) AS spent FROM order_list WHERE customer IS NOT NULL GROUP BY 1, 2")
register("gap_rows", ("order_list",), """
    SELECT business_id, day - lag(day) OVER (PARTITION BY business_id, customer ORDER BY day) AS gap FROM order_list WHERE customer IS NOT NULL""")
register("raw_lines", (), """
    SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS invoice,
           CASE WHEN l_partkey % 37 = 0 THEN 'POST' ELSE lpad(CAST(l_partkey AS VARCHAR), 5, '0') || 'A' END AS stock_code,
           CASE WHEN l_suppkey % 41 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
           CASE WHEN l_orderkey % 23 = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS customer_id, CAST(l_shipdate AS DATE) AS day
    FROM lineitem""")
register("classed", ("raw_lines",), """
    SELECT *, CASE WHEN invoice LIKE 'C%' THEN 'cancellation' WHEN NOT regexp_matches(stock_code, '^[0-9]{5}') THEN 'non_product'
                   WHEN quantity <= 0 OR price <= 0 THEN 'non_positive' ELSE 'sale' END AS kind FROM raw_lines""")
register("seller_order", (), """
    SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 1 THEN l_suppkey || '-' || (l_partkey % 4)
                    WHEN 2 THEN l_suppkey || '-' || (l_partkey % 20) ELSE l_suppkey || '-' || l_partkey END AS seller, l_orderkey AS order_id FROM lineitem""")
register("seller_stat", ("seller_order",), """
    SELECT *, CASE WHEN orders < 10 THEN '<10' WHEN orders < 50 THEN '10-49' WHEN orders <= 500 THEN '50-500' ELSE '>500' END AS band
    FROM (SELECT seller, count(*) AS orders FROM seller_order GROUP BY 1)""")
register("band_order", ("seller_order", "seller_stat"), """
    SELECT DISTINCT order_id FROM seller_order JOIN seller_stat USING (seller) WHERE band = '50-500'""")
register("shop_session", ("ev",), """
    SELECT CASE WHEN day = min(day) OVER (PARTITION BY user_id) THEN 'New_Visitor' ELSE 'Returning_Visitor' END AS visitor_type,
           CASE WHEN clicks > 0 THEN 'page_value > 0' ELSE 'page_value = 0' END AS page_value,
           CASE WHEN pages < 10 THEN '0-9 product pages' WHEN pages < 50 THEN '10-49' ELSE '50+' END AS pages_viewed,
           CASE WHEN pages > 5 THEN 'bounce rate = 0' ELSE 'bounce rate > 0' END AS bounce,
           CASE WHEN isodow(day) IN (6, 7) THEN 'weekend' ELSE 'weekday' END AS day_kind, buys > 0 AS converted
    FROM (SELECT user_id, day, 5 * count(*) AS pages, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys,
                 count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks FROM ev GROUP BY 1, 2)""")
_SEG = " UNION ALL ".join(
    f"SELECT '{seg}' AS segment, {val} AS value, count(*) AS sessions, count(CASE WHEN converted THEN 1 END) AS purchases FROM shop_session GROUP BY {val}"
    for seg, val in [("visitor_type", "visitor_type"), ("page_value", "page_value"), ("pages_viewed", "pages_viewed"), ("bounce", "bounce"),
                     ("day_kind", "day_kind"), ("overall", "'all'")])
register("by_segment", ("shop_session",), f"SELECT *, {rnd(div('purchases', 'sessions'), 4)} AS conversion FROM ({_SEG})")


def _repeat(src: str, key: str) -> str:
    return f"""SELECT {key}, count(*) AS customers, count(CASE WHEN n >= 2 THEN 1 END) AS repeat_customers,
        {rnd(div('count(CASE WHEN n >= 2 THEN 1 END)', 'count(*)'), 4)} AS repeat_customer_share FROM {src} GROUP BY 1"""


ORACLES = {
    "c01_totals": with_views(f"""
        SELECT business_id, count(*) AS orders, count(*) - count(customer) AS orders_without_customer, count(DISTINCT customer) AS customers,
               {rnd('sum(revenue)', 2)} AS revenue_total, {rnd(div('sum(revenue)', 'count(*)'), 2)} AS average_order_value,
               CAST(min(day) AS VARCHAR) AS first_order, CAST(max(day) AS VARCHAR) AS last_order FROM order_list GROUP BY 1""", "order_list"),
    "c02_repeat_customers": with_views(_repeat("cust", "business_id"), "cust"),
    "c03_days_between_orders": with_views(f"""
        SELECT business_id, count(gap) AS gaps, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_days,
               {rnd('quantile_cont(CAST(gap AS DOUBLE), 0.9)', 6)} AS p90_days FROM gap_rows WHERE gap IS NOT NULL GROUP BY 1""", "gap_rows"),
    "c04_c06_concentration": with_views(f"""
        SELECT business_id, {rnd(div('sum(CASE WHEN r = 1 THEN spent END)', 'sum(spent)'), 4)} AS top_1,
               {rnd(div('sum(CASE WHEN r <= 10 THEN spent END)', 'sum(spent)'), 4)} AS top_10,
               {rnd(div('sum(CASE WHEN r = 1 THEN spent END)', 'sum(spent)'), 4)} > 0.30 AS single_customer_over_30pct
        FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY spent DESC, customer) AS r FROM cust) GROUP BY 1""", "cust"),
    "c05_pareto_share": with_views(f"""
        SELECT business_id, {rnd(div('min(CASE WHEN run >= CAST(0.8 AS DECIMAL(3,2)) * total THEN r END)', 'count(*)'), 4)} AS customer_share_for_80pct
        FROM (SELECT business_id, sum(spent) OVER w AS run, row_number() OVER w AS r, sum(spent) OVER (PARTITION BY business_id) AS total
              FROM cust WINDOW w AS (PARTITION BY business_id ORDER BY spent DESC, customer ROWS UNBOUNDED PRECEDING)) GROUP BY 1""", "cust"),
    "c07_monthly": with_views(f"""
        SELECT business_id, strftime(day, '%Y-%m') AS month, count(*) AS orders, {rnd('sum(revenue)', 2)} AS revenue FROM order_list GROUP BY 1, 2""", "order_list"),
    "c08_line_quality": with_views("""
        SELECT count(*) AS lines, count(CASE WHEN kind = 'cancellation' THEN 1 END) AS cancellation_lines, count(CASE WHEN kind = 'non_product' THEN 1 END) AS non_product_lines,
               count(CASE WHEN kind = 'non_positive' THEN 1 END) AS non_positive_quantity_or_price_lines,
               count(CASE WHEN kind = 'sale' AND customer_id = '' THEN 1 END) AS missing_customer_id_lines FROM classed""", "classed"),
    "c08_line_rollup": with_views("""
        SELECT invoice AS order_id, CAST(min(day) AS VARCHAR) AS day, max(nullif(customer_id, '')) AS customer, CAST(sum(quantity * price) AS DOUBLE) AS revenue
        FROM classed WHERE kind = 'sale' GROUP BY 1""", "classed"),
    "c10_seller_size": with_views(f"""
        SELECT band, count(*) AS sellers, CAST(sum(orders) AS BIGINT) AS seller_orders, (SELECT quantile_cont(CAST(orders AS DOUBLE), 0.5) FROM seller_stat) AS median_orders_per_seller,
               {rnd(div('sum(orders)', '(SELECT sum(orders) FROM seller_stat)'), 4)} AS order_share FROM seller_stat GROUP BY 1""", "seller_stat"),
    "c11_repeat_by_band": with_views(_repeat("""(
        SELECT 'all_customers' AS scope, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL
        SELECT 'customers_of_band', o_custkey, count(*) FROM orders WHERE o_orderkey IN (SELECT order_id FROM band_order) GROUP BY 1, 2)""", "scope"), "band_order"),
    "c12_delivery": with_views(f"""
        SELECT scope, count(*) AS delivered_orders, {rnd(div('count(CASE WHEN days > 25 THEN 1 END)', 'count(*)'), 4)} AS late_share,
               {rnd('quantile_cont(days, 0.5)', 4)} AS delivery_days_median, {rnd('quantile_cont(days, 0.9)', 4)} AS delivery_days_p90
        FROM (SELECT 'all' AS scope, o_orderkey % 30 + (o_custkey % 24) / CAST(24 AS DOUBLE) AS days FROM orders WHERE o_orderstatus = 'F' UNION ALL
              SELECT 'band', o_orderkey % 30 + (o_custkey % 24) / CAST(24 AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT order_id FROM band_order))
        GROUP BY 1""", "band_order"),
    "c13_score_distribution": f"""
        WITH r AS (SELECT CAST(1 + 2 * quality + 1 - toxic AS BIGINT) AS score, n_chars >= 500 AS has_comment FROM labels JOIN documents USING (doc_id))
        SELECT score, count(*) AS reviews, (SELECT {rnd('avg(score)', 4)} FROM r) AS mean_score,
               (SELECT {rnd(div('count(CASE WHEN score <= 2 THEN 1 END)', 'count(*)'), 4)} FROM r) AS low_score_share,
               (SELECT {rnd(div('count(CASE WHEN has_comment THEN 1 END)', 'count(*)'), 4)} FROM r) AS with_comment_share FROM r GROUP BY 1""",
    "c14_price_profile": f"""
        SELECT {rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS price_median, {rnd('quantile_cont(l_extendedprice, 0.9)', 4)} AS price_p90,
               {rnd(div('sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2)))', 'count(*)'), 4)} AS mean_freight,
               {rnd(div('sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2)))', 'sum(CAST(l_extendedprice AS DECIMAL(14,2)))'), 4)} AS freight_share
        FROM lineitem""",
    "c14_top_categories": "SELECT p_name AS category, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "c15_category_counts": """
        SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS orders FROM orders GROUP BY 2 UNION ALL
        SELECT 'payment', o_orderpriority, count(*) FROM orders GROUP BY 2""",
    "c16_conversion_by_segment": with_views("SELECT * FROM by_segment", "by_segment"),
    "c16_conversion_lifts": with_views(f"""
        SELECT {rnd(div("max(CASE WHEN value = 'New_Visitor' THEN conversion END)", "max(CASE WHEN value = 'Returning_Visitor' THEN conversion END)"), 3)} AS new_vs_returning_conversion_ratio,
               {rnd(div("max(CASE WHEN value = 'page_value > 0' THEN conversion END)", "max(CASE WHEN value = 'page_value = 0' THEN conversion END)"), 1)} AS page_value_lift
        FROM by_segment""", "by_segment"),
}
