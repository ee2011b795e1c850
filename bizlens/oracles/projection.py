"""Section J in SQL."""

from __future__ import annotations

from bizlens.oracles import calendar as _cal  # noqa: F401  registers the calendar views
from bizlens.oracles import facts as _facts  # noqa: F401  registers the weekly windows
from bizlens.oracles.sqltext import rnd
from bizlens.oracles.views import register, with_views

register("demand", ("win1", "order_business", "biz_turned_away"), """
    SELECT w.business_id, w.week_no, w.as_of, w.a AS week, CAST((w.as_of - w.a) / 7 AS INTEGER) AS back,
           (SELECT count(*) FROM order_business o WHERE o.status <> 'P' AND o.business_id = w.business_id AND o.date BETWEEN w.a AND w.b) AS orders,
           (SELECT count(*) FROM biz_turned_away t WHERE t.business_id = w.business_id AND t.date BETWEEN w.a AND w.b) AS turned_away FROM win1 w WHERE w.as_of - w.a <= 56""")
register("trend", ("demand",), """
    SELECT *, CASE WHEN n > 1 THEN sqrt(greatest(syy - slope * sxy, 0) / greatest(1, n - 2)) ELSE 0 END AS sd
    FROM (SELECT business_id, week_no, as_of, count(*) AS n, min(week) AS hist_from, coalesce(regr_slope(y, x), 0) AS slope, avg(y) AS mean, coalesce(regr_intercept(y, x), avg(y)) - coalesce(regr_slope(y, x), 0) AS level,
                 regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT *, CAST(orders + turned_away AS DOUBLE) AS y, CAST(-back AS DOUBLE) AS x FROM demand) GROUP BY 1, 2, 3)""")
register("context", ("trend", "window_day"), """
    SELECT *, (1 + 0.3::DOUBLE * f_next) / (1 + 0.3::DOUBLE * f_hist) AS factor FROM (
    SELECT *, (SELECT count(DISTINCT day) FROM window_day WHERE day BETWEEN as_of AND as_of + 27) / CAST(28 AS DOUBLE) AS f_next,
           (SELECT count(DISTINCT day) FROM window_day WHERE day BETWEEN hist_from AND as_of - 1) / CAST(as_of - hist_from AS DOUBLE) AS f_hist FROM trend)""")
register("projected", ("context", "profile"), """
    SELECT *, w1 + w2 + w3 + w4 AS expected, 1.2816::DOUBLE * sd * 2 AS half, capacity * 4 AS cap
    FROM (SELECT c.*, capacity, greatest(0, (level + 0.5::DOUBLE * slope) * factor) AS w1, greatest(0, (level + 0.5::DOUBLE * slope * 2) * factor) AS w2,
                 greatest(0, (level + 0.5::DOUBLE * slope * 3) * factor) AS w3, greatest(0, (level + 0.5::DOUBLE * slope * 4) * factor) AS w4 FROM context c JOIN profile USING (business_id))""")
_cap = lambda c: rnd(f"least({c}, cap)", 0)
register("projection", ("projected",), f"""
    SELECT business_id, week_no, CAST(as_of AS VARCHAR) AS month_from, CAST(as_of + 27 AS VARCHAR) AS month_to, n AS weeks_used, {', '.join(f'{rnd(f"w{k}", 1)} AS week_{k}' for k in (1, 2, 3, 4))},
           {rnd('greatest(0, expected - half)', 0)} AS demand_low, {rnd('expected', 0)} AS demand_expected, {rnd('expected + half', 0)} AS demand_high,
           {_cap('greatest(0, expected - half)')} AS orders_low, {_cap('expected')} AS orders_expected, {_cap('expected + half')} AS orders_high,
           {rnd('slope', 2)} AS trend_per_week, {rnd('sd', 2)} AS weekly_scatter_sd, {rnd('factor', 3)} AS context_factor, expected > cap AS demand_exceeds_capacity,
           greatest(0.0, {rnd('expected', 0)} - cap) AS orders_lost, CASE WHEN n < 8 OR (mean > 0 AND sd / mean > 0.35) THEN 'low' ELSE 'medium' END AS confidence, CAST(NULL AS VARCHAR) AS message FROM projected""")
ORACLES = {
    "j01_weekly_demand": with_views("SELECT business_id, week_no, CAST(week AS VARCHAR) AS week, orders, turned_away, orders + turned_away AS demand FROM demand", "demand"),
    "j02_trend": with_views(f"SELECT business_id, week_no, n, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ('slope', 'mean', 'level', 'sd'))} FROM trend", "trend"),
    "j03_context_factor": with_views(f"SELECT business_id, week_no, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ('f_next', 'f_hist', 'factor'))} FROM context", "context"),
    "j04_j05_projection": with_views("SELECT * FROM projection", "projection"),
}
