"""Section N in SQL."""

from __future__ import annotations

from bizlens.oracles import diagnosis as _dx  # noqa: F401  registers week_action, verdict
from bizlens.oracles.sqltext import rnd
from bizlens.oracles.views import register, with_views

register("wanted", ("fact",), """
    SELECT business_id, week_no, CASE WHEN o > 0 THEN o + coalesce(t, 0) END AS demand FROM (SELECT business_id, week_no, max(CASE WHEN sample_kind = 'orders' THEN sample_size END) AS o,
           max(CASE WHEN fact_id = 'f_orders_turned_away' THEN value END) AS t FROM fact GROUP BY 1, 2)""")
def reviewed(name: str, source: str) -> None:
    """Views `<name>0` and `<name>`: the actions of `source` judged with the facts of the week after."""
    register(f"{name}0", (source, "fact", "wanted"), f"""
    SELECT a.business_id, a.week_no + 1 AS week_no, a.action_id, a.action_key, a.status, a.status = 'done' AS done, a.target_fact AS fact_id, CAST(a.target_value AS DOUBLE) AS target_value, p.value AS previous, c.value AS current,
           coalesce(CASE WHEN coalesce(c.direction, p.direction, 'up') = 'down' THEN c.value <= a.target_value ELSE c.value >= a.target_value END, false) AS reached,
           CASE WHEN p.value IS NULL OR c.value IS NULL THEN NULL WHEN p.value = c.value THEN 0 WHEN (c.value > p.value) = (coalesce(c.direction, p.direction, 'up') <> 'down') THEN 1 ELSE -1 END AS move,
           coalesce(c.kpi IN ('orders_turned_away', 'dispatch_delay_days', 'stockouts') AND d0.demand > 0 AND d1.demand > d0.demand AND p.value IS NOT NULL
                    AND CASE WHEN c.kpi = 'orders_turned_away' THEN c.value - p.value <= d1.demand - d0.demand ELSE d1.demand >= 1.1::DOUBLE * d0.demand END, false) AS surge
    FROM (SELECT * FROM {source} WHERE kind = 'action' AND week_no < 4) a LEFT JOIN fact p ON p.business_id = a.business_id AND p.week_no = a.week_no AND p.fact_id = a.target_fact
    LEFT JOIN fact c ON c.business_id = a.business_id AND c.week_no = a.week_no + 1 AND c.fact_id = a.target_fact
    LEFT JOIN wanted d0 ON d0.business_id = a.business_id AND d0.week_no = a.week_no LEFT JOIN wanted d1 ON d1.business_id = a.business_id AND d1.week_no = a.week_no + 1""")
    register(name, (f"{name}0",), f"""
    SELECT business_id, week_no, action_id, action_key, status, done, fact_id, target_value, previous, current,
           CASE WHEN NOT done THEN 'not_judged' WHEN reached THEN 'reached_target' WHEN move = 1 THEN 'moving' WHEN surge THEN 'inconclusive' WHEN coalesce(move, 0) = 0 THEN 'no_change' ELSE 'worse' END AS effectiveness,
           CASE WHEN NOT done THEN 'retry' WHEN reached THEN 'double_down' WHEN move = 1 OR surge THEN 'keep' ELSE 'drop' END AS decision FROM {name}0""")


reviewed("review", "week_action")
# ---- the closed loop: every candidate is judged as if it were chosen, then one view a week
register("as_chosen", ("mine", "mark"), """
    SELECT m.business_id, m.week_no, m.action_key, target_fact, target_value, 'action' AS kind, 'act_' || m.business_id || '_w' || m.week_no || '_' || m.action_key AS action_id, coalesce(s.status, 'todo') AS status
    FROM mine m LEFT JOIN mark s ON s.action_id = 'act_' || m.business_id || '_w' || m.week_no || '_' || m.action_key""")
reviewed("told", "as_chosen")
register("pref1", (), "SELECT CAST(NULL AS BIGINT) AS business_id, CAST(NULL AS BIGINT) AS week_no, '' AS action_key, '' AS preference WHERE false")
WEEKS = 4
for _w in range(1, WEEKS + 1):
    register(f"steer{_w}", ("mine", f"pref{_w}"), f"""
        SELECT m.* REPLACE (eligible AND NOT (eligible AND coalesce(preference = 'exclude', false)) AS eligible,
                            CASE WHEN eligible AND preference = 'exclude' THEN 'Dropped after last week''s follow-up: the number did not move.' ELSE blocked_reason END AS blocked_reason,
                            CASE WHEN preference = 'boost' THEN {rnd('score + 10', 1)} ELSE score END AS score), preference
        FROM mine m LEFT JOIN pref{_w} p ON p.business_id = m.business_id AND p.week_no = m.week_no AND p.action_key = m.action_key WHERE m.week_no = {_w}""")
    _dx.picks(f"steer_pick{_w}", f"steer{_w}", (f"steer{_w}",), "business_id, week_no")
    register(f"pref{_w + 1}", ("told", f"steer_pick{_w}"), f"""
        SELECT t.business_id, t.week_no, t.action_key, CASE WHEN decision = 'drop' THEN 'exclude' ELSE 'boost' END AS preference
        FROM told t JOIN steer_pick{_w} k ON k.business_id = t.business_id AND k.week_no + 1 = t.week_no AND k.action_key = t.action_key WHERE decision <> 'retry'""")
register("steered", tuple(f"steer_pick{_w}" for _w in range(1, WEEKS + 1)), " UNION ALL ".join(
    f"SELECT s.*, k.action_key IS NOT NULL AS chosen FROM steer{_w} s LEFT JOIN steer_pick{_w} k ON k.business_id = s.business_id AND k.week_no = s.week_no AND k.action_key = s.action_key" for _w in range(1, WEEKS + 1)))
_agg = lambda cond, c: f"coalesce(string_agg(CASE WHEN {cond} THEN {c} END, ',' ORDER BY {c}), '')"
ORACLES = {
    "n01_action_reviews": with_views("SELECT * FROM review", "review"),
    "n02_demand": with_views("SELECT * FROM wanted", "wanted"),
    "n03_shared_targets": with_views("""
        SELECT business_id, week_no, action_id, CASE WHEN done AND n > 1 THEN n || ' done actions aimed at this number; the change cannot be split between them.' END AS attribution_note
        FROM (SELECT *, count(CASE WHEN done THEN 1 END) OVER (PARTITION BY business_id, week_no, fact_id) AS n FROM review)""", "review"),
    "n04_preferences": with_views(f"SELECT business_id, week_no, {_agg(chr(100) + 'ecision IN (' + repr('double_down') + ', ' + repr('keep') + ')', 'action_key')} AS boost, {_agg('decision = ' + repr('drop'), 'action_key')} AS exclude FROM review GROUP BY 1, 2", "review"),
    "n04_advice_loop": with_views("""
        SELECT s.business_id, s.week_no, m.action_id, s.action_key, s.bottleneck, mode, CASE WHEN chosen THEN 'action' WHEN NOT eligible THEN 'blocked' ELSE 'not_chosen' END AS kind, effort_min, score, blocked_reason,
               s.target_fact, CAST(s.target_value AS DOUBLE) AS target_value, s.current, s.direction, CASE WHEN chosen THEN CAST(as_of + 7 AS VARCHAR) END AS due, CASE WHEN chosen THEN coalesce(m.status, 'todo') END AS status,
               partner_id, product_name, preference, CASE WHEN chosen THEN decision END AS decision, CASE WHEN chosen THEN concat_ws(',', ids, partner_id) END AS evidence_ids
        FROM steered s JOIN mark m ON m.action_id = 'act_' || s.business_id || '_w' || s.week_no || '_' || s.action_key
        LEFT JOIN told t ON t.business_id = s.business_id AND t.week_no = s.week_no + 1 AND t.action_key = s.action_key
        LEFT JOIN (SELECT business_id AS b, week_no AS w, bottleneck AS n, string_agg(fact_id, ',' ORDER BY pos, fact_id) AS ids FROM card GROUP BY ALL) c ON b = s.business_id AND w = s.week_no AND n = s.bottleneck""",
                                  "steered", "told", "mark", "card"),
    "n05_followups": with_views(f"""
        SELECT v.business_id, v.week_no, coalesce(actions_done, '') AS actions_done, coalesce(actions_skipped, '') AS actions_skipped, coalesce(actions_open, '') AS actions_open, m0.value AS previous_measure, m1.value AS current_measure,
               {rnd('m1.value - m0.value', 4)} AS change, p."primary" AS previous_bottleneck, v."primary" AS bottleneck, v."primary" IS DISTINCT FROM p."primary" AS changed,
               CASE WHEN v."primary" IS NOT NULL AND v."primary" IS DISTINCT FROM p."primary" THEN 'The main bottleneck moved from ' || replace(coalesce(p."primary", 'none'), '_', ' ') || ' to ' || replace(v."primary", '_', ' ') || ': this week''s actions switch to it.'
                    WHEN p."primary" IS NOT NULL AND v."primary" IS NULL THEN upper(left(p."primary", 1)) || replace(substr(p."primary", 2), '_', ' ') || ' is back at your best weeks and nothing else is clearly off: keep doing what works.' END AS adjustment
        FROM verdict v JOIN verdict p ON p.business_id = v.business_id AND p.week_no = v.week_no - 1
        LEFT JOIN (SELECT business_id AS b, week_no AS w, {_agg("status = 'done'", 'action_id')} AS actions_done, {_agg("status = 'skipped'", 'action_id')} AS actions_skipped, {_agg("status = 'todo'", 'action_id')} AS actions_open FROM review GROUP BY 1, 2) r ON b = v.business_id AND w = v.week_no
        LEFT JOIN (SELECT * FROM fact WHERE fact_id = 'f_stranger_orders_week') m0 ON m0.business_id = v.business_id AND m0.week_no = v.week_no - 1
        LEFT JOIN (SELECT * FROM fact WHERE fact_id = 'f_stranger_orders_week') m1 ON m1.business_id = v.business_id AND m1.week_no = v.week_no""", "verdict", "review", "fact"),
    "n06_four_week_arc": with_views(f"""
        SELECT f.business_id, arg_min(value, week_no) FILTER (fact_id = 'f_stranger_orders_week') AS orders_first, arg_max(value, week_no) FILTER (fact_id = 'f_stranger_orders_week') AS orders_last,
               arg_min(value, week_no) FILTER (fact_id = 'f_stranger_share') AS share_first, arg_max(value, week_no) FILTER (fact_id = 'f_stranger_share') AS share_last, coalesce(any_value(worked), '') AS worked, coalesce(any_value(did_not), '') AS did_not_work
        FROM fact f LEFT JOIN (SELECT business_id, {_agg("effectiveness IN ('reached_target', 'moving')", "'week_' || (week_no - 1) || ' ' || action_key")} AS worked,
                                      {_agg("effectiveness IN ('no_change', 'worse')", "'week_' || (week_no - 1) || ' ' || action_key")} AS did_not FROM review GROUP BY 1) r USING (business_id) GROUP BY 1""", "fact", "review"),
    "n07_partner_history": with_views(f"SELECT partner_id, count(*) AS collabs, {rnd('avg(stranger_leads)', 4)} AS mean_stranger_leads FROM partner_result GROUP BY 1", "partner_result"),
    "n08_outcome_grading": f"""
        SELECT plan_id, {rnd('done / CAST(total AS DOUBLE)', 4)} AS fidelity_rate, done = total AS executed, CASE WHEN base <> 0 THEN {rnd('(actual - base) / base * 100', 1)} END AS delta_vs_baseline_pct,
               CASE WHEN done <> total OR plan_id % 40 < CASE WHEN plan_id % 2 = 0 THEN 7 ELSE 30 END THEN 'inconclusive' WHEN actual BETWEEN plan_id % 100 * 1000 AND plan_id % 100 * 1000 + 250000 THEN 'promising' ELSE 'not_effective' END AS effectiveness,
               plan_id % 48 > 24 AS guardrail_breached
        FROM (SELECT o_orderkey AS plan_id, 1 + o_orderkey % 4 AS total, least(1 + o_orderkey % 4, 1 + o_orderkey % 3) AS done, CAST(o_orderkey % 7 * 10000 AS DOUBLE) AS base, o_totalprice AS actual FROM orders)""",
}
