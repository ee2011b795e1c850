"""Section I in SQL."""

from __future__ import annotations

from bizlens.oracles.sqltext import rnd
from bizlens.oracles.views import register, with_views

register("cal_month", (), """SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS m FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT ts FROM events)""")
register("event_window", ("cal_month",), """
    SELECT 'Weekend ' || strftime(m, '%Y-%m') AS name, 'race_weekend' AS kind, f AS window_start, f + 2 AS window_end FROM (SELECT m, m + CAST((12 - isodow(m)) % 7 AS INTEGER) AS f FROM cal_month)""")
register("window_day", ("event_window",), "SELECT name, window_start, window_end, window_start + CAST(i AS INTEGER) AS day FROM event_window, range(0, 3) t(i)")
_d = lambda *cs: ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cs)
ORACLES = {
    "i01_overlapping_windows": with_views(f"""
        SELECT business_id, week_no, name, {_d('window_start', 'window_end')} FROM snapshots JOIN event_window ON as_of <= window_end AND window_start <= as_of + 27""", "snapshots", "event_window"),
    "i02_covering_window": with_views(f"""
        SELECT name, {_d('window_start', 'window_end', 'day')} FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) JOIN event_window ON day BETWEEN window_start AND window_end""", "event_window"),
    "i03_next_event": with_views("""
        SELECT CAST(day AS VARCHAR) AS day, arg_min(name, window_end) AS name, min(window_end) - day AS days_until
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) LEFT JOIN event_window ON window_end >= day GROUP BY day""", "event_window"),
    "i04_build_up_and_tail": with_views("""
        SELECT name, CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end, CAST(window_start - 7 AS VARCHAR) AS build_from, CAST(window_start - 1 AS VARCHAR) AS build_to,
               CAST(window_end + 1 AS VARCHAR) AS tail_from, CAST(window_end + 3 AS VARCHAR) AS tail_to FROM event_window""", "event_window"),
    "i05_festival_windows": with_views("""
        SELECT 'Festival ' || strftime(m, '%Y-%m') AS name, 'festival' AS kind, CAST(m + 12 AS VARCHAR) AS window_start, CAST(m + 19 AS VARCHAR) AS window_end FROM cal_month WHERE month(m) % 2 = 0""", "cal_month"),
    "i06_interest_uplift": with_views(f"""
        SELECT coalesce(season, 'overall') AS season, weekend_days, other_days, {rnd('a', 3)} AS mean_weekend, {rnd('b', 3)} AS mean_other, {rnd('a / nullif(b, 0)', 3)} AS uplift
        FROM (SELECT season, count(CASE WHEN w THEN 1 END) AS weekend_days, count(CASE WHEN NOT w THEN 1 END) AS other_days, avg(CASE WHEN w THEN views END) AS a, avg(CASE WHEN NOT w THEN views END) AS b
              FROM (SELECT *, CAST(year(date) AS VARCHAR) AS season, date IN (SELECT day FROM window_day) AS w FROM (
                    SELECT day AS date, count(*) AS views FROM ev WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT CAST(o_orderdate AS DATE), count(*) FROM orders GROUP BY 1)) GROUP BY ROLLUP (season))""", "window_day", "ev"),
    "i07_inside_share": with_views("""
        SELECT business_id, week_no, CAST(as_of AS VARCHAR) AS as_of, CAST(as_of + 27 AS VARCHAR) AS hi, count(DISTINCT day) AS inside_days, count(DISTINCT day) / CAST(28 AS DOUBLE) AS share
        FROM snapshots LEFT JOIN window_day ON day BETWEEN as_of AND as_of + 27 GROUP BY business_id, week_no, as_of""", "snapshots", "window_day"),
    "i08_upcoming_windows": with_views(f"""
        SELECT business_id, week_no, {_d('as_of')}, name, {_d('window_start', 'window_end')} FROM snapshots JOIN event_window ON window_start > as_of AND window_start <= as_of + 21""", "snapshots", "event_window"),
}
