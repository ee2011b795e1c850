"""Sections E and F in SQL: every window is measured straight from the rows it holds."""

from __future__ import annotations

from bizlens.operators.facts import MIN_SAMPLE, SPECS
from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views
from bizlens.plans.queries.facts import FACT_QUERIES

register("fact_lead", ("lead",), "SELECT business_id, lead_id, outcome, created - 8246 AS created, outcome_date - 8246 AS outcome_date FROM lead")


def window_views(tag: str, n: int) -> None:
    """Views `win{tag}` (windows) and `wf{tag}` (facts per window) for windows of n weeks."""
    win, wf = f"win{tag}", f"wf{tag}"
    register(win, ("snapshots",), f"""
        SELECT business_id, week_no, as_of, CAST(d AS DATE) AS a, CAST(d AS DATE) + {7 * n - 1} AS b
        FROM (SELECT *, unnest(generate_series(history_start, as_of - {7 * n}, INTERVAL 7 DAY)) AS d FROM snapshots)
        WHERE business_id IN (SELECT business_id FROM businesses)""")
    register(f"{win}_o", (win, "biz_order"), f"""
        SELECT w.business_id, w.week_no, w.as_of, w.a, w.b, count(o.order_id) AS orders,
               count(CASE WHEN relationship = 'friend' THEN 1 END) AS friend, count(CASE WHEN relationship = 'friend_of_friend' THEN 1 END) AS friend_of_friend,
               count(CASE WHEN relationship = 'stranger' THEN 1 END) AS stranger, count(CASE WHEN relationship = 'unknown' THEN 1 END) AS unknown,
               coalesce(sum(qty), 0) AS qty, coalesce(sum(cost), 0) AS cost, coalesce(sum(total), 0) AS total, coalesce(sum(gross), 0) AS gross,
               coalesce(sum(discount), 0) AS discount,
               quantile_cont(CASE WHEN dispatched_at < w.as_of THEN CAST(dispatched_at - date AS DOUBLE) END, 0.5) AS dmed,
               sum(CASE WHEN dispatched_at < w.as_of THEN dispatched_at - date END) AS dsum, count(CASE WHEN dispatched_at < w.as_of THEN 1 END) AS dn
        FROM {win} w LEFT JOIN biz_order o ON o.business_id = w.business_id AND o.date BETWEEN w.a AND w.b GROUP BY ALL""")
    register(f"{win}_p", (win, "biz_post", "biz_order"), f"""
        SELECT w.business_id, w.week_no, w.a, count(p.post_id) AS posts, coalesce(sum(reach), 0) AS reach, coalesce(sum(profile_visits), 0) AS visits,
               coalesce(sum(follows), 0) AS follows, count(CASE WHEN f.d < w.as_of THEN 1 END) AS attributed
        FROM {win} w LEFT JOIN biz_post p ON p.business_id = w.business_id AND p.date BETWEEN w.a AND w.b
        LEFT JOIN (SELECT post_id, min(date) AS d FROM biz_order WHERE post_id IS NOT NULL GROUP BY 1) f ON f.post_id = p.post_id GROUP BY ALL""")
    register(f"{win}_l", (win, "fact_lead"), f"""
        SELECT w.business_id, w.week_no, w.a, count(l.lead_id) AS closed, count(CASE WHEN outcome = 'ordered' THEN 1 END) AS closed_ordered
        FROM {win} w LEFT JOIN fact_lead l ON l.business_id = w.business_id AND l.created BETWEEN w.a AND w.b AND l.outcome_date < w.as_of GROUP BY ALL""")
    register(f"{win}_e", (win, "biz_stockout", "biz_turned_away"), f"""
        SELECT w.business_id, w.week_no, w.a, (SELECT count(*) FROM biz_stockout s WHERE s.business_id = w.business_id AND s.date BETWEEN w.a AND w.b) AS stockouts,
               (SELECT count(*) FROM biz_turned_away s WHERE s.business_id = w.business_id AND s.date BETWEEN w.a AND w.b) AS away FROM {win} w""")
    register(f"{win}_r", (win, "biz_order"), f"""
        SELECT business_id, week_no, a, count(*) AS buyers, count(CASE WHEN n >= 2 THEN 1 END) AS repeaters
        FROM (SELECT w.business_id, w.week_no, w.a, o.buyer_ref, count(*) AS n FROM {win} w JOIN biz_order o ON o.business_id = w.business_id AND o.date <= w.b GROUP BY ALL)
        GROUP BY ALL""")
    register(f"{win}_g", (win, "biz_order"), f"""
        SELECT w.business_id, w.week_no, w.a, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS gmed, sum(gap) AS gsum, count(*) AS gn
        FROM {win} w JOIN (SELECT business_id, date, date - lag(date) OVER (PARTITION BY business_id, buyer_ref ORDER BY date) AS gap FROM biz_order) o
             ON o.business_id = w.business_id AND o.date <= w.b
        WHERE gap IS NOT NULL {'AND w.b = w.as_of - 1' if n > 1 else ''} GROUP BY ALL""")

    def part(fid, value, num, den, size, kind, src):
        return (f"SELECT business_id, week_no, a, '{fid}' AS fact_id, CAST({value} AS DOUBLE) AS value, CAST({num} AS DOUBLE) AS numerator, "
                f"CAST({den} AS DOUBLE) AS denominator, CAST({size} AS BIGINT) AS sample_size, '{kind}' AS sample_kind FROM {src}")

    o, p, e = f"{win}_o", f"{win}_p", f"{win}_e"
    op = f"{p} JOIN {o} USING (business_id, week_no, a)"
    eo = f"{e} JOIN {o} USING (business_id, week_no, a)"
    per = lambda c: f"CASE WHEN orders > 0 THEN {c} / CAST({n} AS DOUBLE) END"
    parts = [part(f"f_orders_by_source_{r}", per(r), r, n, "orders", "orders", o) for r in ("friend", "friend_of_friend", "stranger", "unknown")]
    parts += [
        part("f_stranger_orders_week", per("stranger"), "stranger", n, "orders", "orders", o),
        part("f_stranger_share", div("stranger", "orders"), "stranger", "orders", "orders", "orders", o),
        part("f_reach_per_post", div("reach", "posts"), "reach", "posts", "posts", "posts", p),
        part("f_posts_with_orders", div("attributed", "posts"), "attributed", "posts", "posts", "posts", p),
        part("f_profile_visit_rate", div("visits", "reach"), "visits", "reach", "posts", "posts", p),
        part("f_follow_rate", div("follows", "visits"), "follows", "visits", "posts", "posts", p),
        part("f_orders_per_1000_reach", div("1000 * orders", "reach"), "orders", "reach", "orders", "orders", op),
        part("f_lead_to_order_rate", div("closed_ordered", "closed"), "closed_ordered", "closed", "closed", "leads", f"{win}_l"),
        part("f_unit_cost_full", div("cost", "qty"), "cost", "qty", "orders", "orders", o),
        part("f_margin_per_order", div("(total - cost)", "orders"), "total - cost", "orders", "orders", "orders", o),
        part("f_margin_pct", div("(total - cost)", "total"), "total - cost", "total", "orders", "orders", o),
        part("f_discount_share", div("discount", "gross"), "discount", "gross", "orders", "orders", o),
        part("f_repeat_customer_share", div("repeaters", "buyers"), "repeaters", "buyers", "buyers", "customers", f"{win}_r"),
        part("f_days_between_orders", "gmed", "gsum", "gn", "gn", "repeat gaps", f"{win}_g"),
        part("f_orders_per_week", per("orders"), "orders", n, "orders", "orders", o),
        part("f_dispatch_delay_days", "dmed", "dsum", "dn", "dn", "dispatched orders", o),
        part("f_stockouts", "stockouts", "stockouts", n, "greatest(1, orders)", "orders", eo),
        part("f_orders_turned_away", "away", "away", n, "greatest(1, orders)", "orders", eo),
        part("f_capacity_utilisation", f"CASE WHEN orders > 0 THEN orders / CAST({n} AS DOUBLE) / capacity END", "orders", f"{n} * capacity", "orders", "orders",
             f"{o} JOIN profile USING (business_id)"),
    ]
    register(wf, (o, p, e, f"{win}_l", f"{win}_r", f"{win}_g", "profile"),
             "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL")


window_views("4", 4)
window_views("1", 1)

_quote = lambda s: s.replace("'", "''")
register("spec", (), "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{_quote(v)}'" for v in (s.fact_id, s.kpi, s.bottleneck, s.unit, s.better, s.source, s.origin)) + ")" for s in SPECS)
    + ") t(fact_id, kpi, bottleneck, unit, better, source_rule, origin)")
register("min_sample", (), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in MIN_SAMPLE.items()) + ") t(sample_kind, floor_n)")


def shown(c: str) -> str:
    return f"CASE WHEN unit = 'ratio' THEN {rnd(c, 4)} ELSE {rnd(c, 2)} END"


register("best", ("wf4", "spec"), """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id, week_no, fact_id
                                                ORDER BY CASE WHEN better = 'higher' THEN -value ELSE value END, a DESC) AS r FROM wf4 JOIN spec USING (fact_id))
    WHERE r = 1 AND better IN ('higher', 'lower')""")
register("fact", ("wf4", "best", "spec", "min_sample", "snapshots"), f"""
    SELECT c.business_id, 'week_' || c.week_no AS snapshot, c.week_no, c.fact_id, s.kpi, s.bottleneck,
           CASE WHEN s.kpi = 'orders_by_source' THEN replace(c.fact_id, 'f_orders_by_source_', '') END AS dimension,
           CAST(n.as_of - 28 AS VARCHAR) AS period_from, CAST(n.as_of - 1 AS VARCHAR) AS period_to, {shown('c.value').replace('unit', 's.unit')} AS value, s.unit,
           {shown('b.value').replace('unit', 's.unit')} AS baseline, CAST(b.a AS VARCHAR) AS best_from, CAST(b.a + 27 AS VARCHAR) AS best_to,
           CASE WHEN b.value <> 0 THEN {rnd('(c.value - b.value) / b.value * 100', 1)} END AS delta_pct,
           CASE WHEN b.value <> 0 THEN greatest(0.0, {rnd("CASE WHEN s.better = 'higher' THEN (b.value - c.value) / b.value ELSE (c.value - b.value) / b.value END", 4)})
                WHEN b.value = 0 AND s.better = 'lower' THEN CASE WHEN c.value > 0 THEN 1.0 ELSE 0.0 END END AS gap_to_best,
           s.better, {rnd('c.numerator', 2)} AS numerator, {rnd('c.denominator', 2)} AS denominator, 'v2' AS definition_version,
           CASE WHEN c.sample_size < floor_n THEN 'partial' ELSE 'ok' END AS quality_flag, CASE WHEN c.sample_size < floor_n THEN 'estimate' ELSE s.source_rule END AS source,
           c.sample_size, c.sample_kind,
           CASE WHEN c.fact_id = 'f_capacity_utilisation' THEN 'up_to_limit' WHEN s.better = 'higher' THEN 'up' WHEN s.better = 'lower' THEN 'down' END AS direction, s.origin
    FROM wf4 c JOIN snapshots n ON n.business_id = c.business_id AND n.week_no = c.week_no AND c.a = n.as_of - 28
    JOIN spec s ON s.fact_id = c.fact_id JOIN min_sample m ON m.sample_kind = c.sample_kind
    LEFT JOIN best b ON b.business_id = c.business_id AND b.week_no = c.week_no AND b.fact_id = c.fact_id""")

_BRIEF = "business_id, week_no, fact_id, value, numerator, denominator, sample_size, sample_kind, baseline, gap_to_best"


def _in(ids) -> str:
    return ", ".join(f"'{i}'" for i in ids)


def _series(fid: str, digits: int) -> str:
    return f"""SELECT g.business_id, g.week_no, CAST(g.a AS VARCHAR) AS from_day, CAST(g.b AS VARCHAR) AS to_day, {rnd('f.value', digits)} AS value,
        coalesce(f.sample_size, 0) AS sample_size, '{fid}' AS fact_id FROM win1 g LEFT JOIN (SELECT * FROM wf1 WHERE fact_id = '{fid}') f USING (business_id, week_no, a)"""


ORACLES = {
    **{k: with_views(f"SELECT {_BRIEF} FROM fact WHERE fact_id IN ({_in(ids)})", "fact") for k, ids in FACT_QUERIES.items()},
    "f01_week_grid": with_views("SELECT business_id, week_no, CAST(a AS VARCHAR) AS window_from, CAST(b AS VARCHAR) AS window_to FROM win4", "win4"),
    "f02_point_in_time": with_views("""
        SELECT business_id, week_no, (SELECT count(*) FROM biz_order x WHERE x.business_id = s.business_id AND x.date < s.as_of) AS orders,
               (SELECT count(*) FROM biz_post x WHERE x.business_id = s.business_id AND x.date < s.as_of) AS posts,
               (SELECT count(*) FROM fact_lead x WHERE x.business_id = s.business_id AND x.created < s.as_of) AS leads,
               (SELECT count(*) FROM biz_turned_away x WHERE x.business_id = s.business_id AND x.date < s.as_of) AS turned_away,
               (SELECT count(*) FROM biz_stockout x WHERE x.business_id = s.business_id AND x.date < s.as_of) AS stockouts FROM snapshots s""",
        "snapshots", "biz_order", "biz_post", "fact_lead", "biz_turned_away", "biz_stockout"),
    "f03_f04_own_best": with_views("SELECT business_id, week_no, fact_id, value, baseline, best_from, best_to, gap_to_best, delta_pct FROM fact WHERE better <> 'info'", "fact"),
    "f05_small_samples": with_views("SELECT business_id, week_no, fact_id, sample_size, sample_kind, quality_flag, source FROM fact", "fact"),
    "f06_fact_table": with_views("SELECT * FROM fact", "fact"),
    "f07_weekly_series": with_views(" UNION ALL ".join([_series("f_stranger_orders_week", 2), _series("f_margin_pct", 4), _series("f_dispatch_delay_days", 2),
                                                        _series("f_days_between_orders", 2)]), "win1", "wf1"),
    "f08_facts_by_bottleneck": with_views(f"SELECT {_BRIEF}, bottleneck FROM fact WHERE bottleneck = 'margin'", "fact"),
    "f09_fact_changes": with_views("""
        SELECT c.business_id, c.week_no, c.fact_id, c.kpi, c.unit, p.value AS previous, c.value AS current,
               CASE WHEN c.value IS NULL OR p.value IS NULL THEN 'unknown' WHEN c.value = p.value THEN 'same'
                    WHEN (c.value > p.value) = (coalesce(c.direction, 'up') <> 'down') THEN 'better' ELSE 'worse' END AS moved
        FROM fact c JOIN fact p ON p.business_id = c.business_id AND p.week_no = c.week_no - 1 AND p.fact_id = c.fact_id""", "fact"),
}
