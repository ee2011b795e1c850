"""Section D in SQL."""

from __future__ import annotations

from bizlens.operators.d2c import SPECS
from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views
from bizlens.plans.queries.d2c import BRIEF, FACT_QUERIES, PERIODS

register("period", (), "SELECT period_id, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi, CAST(as_of AS TIMESTAMP) AS as_of FROM (VALUES "
         + ", ".join(str(p) for p in PERIODS) + ") t(period_id, lo, hi, as_of)")
register("label", ("period", "d2c_daily"), """
    SELECT period_id, as_of, label, CASE label WHEN 'current' THEN lo WHEN 'pooled' THEN e - 27 ELSE e - 27 + 7 * CAST(substr(label, 2) AS INTEGER) END AS a,
           CASE label WHEN 'current' THEN hi WHEN 'pooled' THEN e ELSE e - 21 + 7 * CAST(substr(label, 2) AS INTEGER) END AS b
    FROM (SELECT *, lo - 1 - CAST(dayofweek(lo - 1) + 1 AS INTEGER) % 7 AS e FROM period WHERE lo <= hi AND lo >= (SELECT min(date) FROM d2c_daily) AND hi <= (SELECT max(date) FROM d2c_daily)),
         (VALUES ('current'), ('pooled'), ('w0'), ('w1'), ('w2'), ('w3')) t(label)""")
register("cohort", ("d2c_order",), "SELECT customer_id FROM d2c_order WHERE is_first_order AND day <= DATE '2024-01-10' AND customer_id % 2 = 0")
_SEEN = ("CASE WHEN stage IN ('qualified', 'won') AND first_response_at > as_of THEN 'new' WHEN stage = 'won' AND won_at > as_of THEN 'qualified' ELSE stage END")
register("m_daily", ("label", "d2c_daily"), """
    SELECT period_id, label, coalesce(sum(CASE WHEN channel = 'instagram' THEN spend END), 0) AS is_, coalesce(sum(CASE WHEN channel = 'instagram' THEN sessions END), 0) AS ise,
           coalesce(sum(CASE WHEN channel = 'instagram' THEN new_customers END), 0) AS inw, coalesce(sum(CASE WHEN channel = 'instagram' THEN revenue END), 0) AS ir,
           coalesce(sum(CASE WHEN channel = 'google' THEN spend END), 0) AS gs, coalesce(sum(CASE WHEN channel = 'google' THEN new_customers END), 0) AS gnw,
           coalesce(sum(CASE WHEN channel = 'google' THEN revenue END), 0) AS gr, coalesce(sum(sessions), 0) AS ses
    FROM label LEFT JOIN d2c_daily ON date BETWEEN a AND b GROUP BY ALL""")
register("m_order", ("label", "d2c_order"), """
    SELECT period_id, label, count(order_id) AS n, coalesce(sum(revenue), 0) AS rev, coalesce(sum(cogs), 0) AS cogs, count(CASE WHEN is_first_order THEN 1 END) AS firsts
    FROM label LEFT JOIN d2c_order ON day BETWEEN a AND b GROUP BY ALL""")
register("m_lead", ("label", "d2c_lead"), f"""
    SELECT period_id, label, count(lead_id) AS ln, count(CASE WHEN st IN ('qualified', 'won') THEN 1 END) AS lq, count(CASE WHEN st = 'won' THEN 1 END) AS lw,
           count(CASE WHEN high_value AND (first_response_at IS NULL OR first_response_at > cut) THEN 1 END) AS un,
           quantile_cont(CASE WHEN high_value THEN (epoch_us(CASE WHEN first_response_at <= obs THEN first_response_at ELSE obs END) - epoch_us(created_at)) / CAST(3600000000 AS DOUBLE) END, 0.9) AS p90
    FROM (SELECT *, {_SEEN} AS st, least(CAST(b + 1 AS TIMESTAMP) + INTERVAL 6 HOUR, as_of) AS obs, least(CAST(b AS TIMESTAMP) + INTERVAL 86399 SECOND, as_of) AS cut
          FROM label LEFT JOIN d2c_lead ON CAST(created_at AS DATE) BETWEEN a AND b) GROUP BY 1, 2""")
register("m_win", ("label", "d2c_lead"), """
    SELECT period_id, label, count(lead_id) AS wins FROM label LEFT JOIN d2c_lead ON high_value AND won_at <= as_of AND CAST(won_at AS DATE) BETWEEN a AND b GROUP BY 1, 2""")
register("m_cohort", ("label", "d2c_order", "cohort"), """
    SELECT period_id, label, count(CASE WHEN r.day <= b THEN 1 END) AS c_repeat, count(*) AS c_size
    FROM label, cohort c LEFT JOIN (SELECT customer_id, min(day) AS day FROM d2c_order WHERE NOT is_first_order GROUP BY 1) r USING (customer_id) GROUP BY 1, 2""")
register("measure", ("m_daily", "m_order", "m_lead", "m_win", "m_cohort"), """
    SELECT * FROM m_daily JOIN m_order USING (period_id, label) JOIN m_lead USING (period_id, label) JOIN m_win USING (period_id, label) JOIN m_cohort USING (period_id, label)""")


def part(fid, value, num="NULL", den="NULL"):
    return f"SELECT period_id, label, '{fid}' AS fact_id, CAST({value} AS DOUBLE) AS value, CAST({num} AS DOUBLE) AS numerator, CAST({den} AS DOUBLE) AS denominator FROM measure"


def q(fid, num, den):
    return part(fid, div(num, den), num, den)


_PARTS = [part("f_spend_instagram", "is_"), q("f_cac_instagram", "is_", "inw"), q("f_conv_instagram", "inw", "ise"), q("f_roas_instagram", "ir", "is_"),
          q("f_croas_instagram", rnd("CAST(ir AS DOUBLE) * 0.5", 2), "is_"), part("f_spend_google", "gs"), q("f_cac_google", "gs", "gnw"),
          q("f_croas_google", rnd("CAST(gr AS DOUBLE) * 0.5", 2), "gs"), q("f_cac_blended", "(is_ + gs)", "firsts"), part("f_revenue_total", "rev"), part("f_orders_total", "n"),
          q("f_aov", "rev", "n"), q("f_gross_margin", rnd("rev - cogs", 2), "rev"), q("f_repeat_rate", "(n - firsts)", "n"), q("f_repeat_email", "c_repeat", "c_size"),
          part("f_leads_total", "ln"), part("f_latency_hot_leads", "p90"), part("f_unattended_hot_leads", "un"), part("f_hot_lead_wins", "wins"),
          part("f_funnel_sessions", "ses"), part("f_funnel_leads", "ln"), part("f_funnel_qualified", "lq", "lq", "ln"), part("f_funnel_won", "lw", "lw", "lq")]
register("label_value", ("measure",), " UNION ALL ".join(_PARTS))
register("dspec", (), "SELECT * FROM (VALUES " + ", ".join(str(s) for s in SPECS) + ") t(fact_id, kpi, dimension, unit, baseline_kind)")
_at = lambda lab, c: f"max(CASE WHEN label = '{lab}' THEN {c} END)"
register("dbase", ("label_value", "dspec"), f"""
    SELECT period_id, fact_id, kpi, dimension, unit, baseline_kind, {_at('current', 'value')} AS value, {_at('current', 'numerator')} AS numerator, {_at('current', 'denominator')} AS denominator,
           CASE WHEN baseline_kind = 'weekly' THEN ({' + '.join(f"coalesce({_at(f'w{k}', 'value')}, 0)" for k in range(4))}) / nullif(CAST(count(CASE WHEN label LIKE 'w_' THEN value END) AS DOUBLE), 0)
                ELSE {_at('pooled', 'value')} END AS baseline
    FROM label_value JOIN dspec USING (fact_id) GROUP BY 1, 2, 3, 4, 5, 6""")
register("dfact", ("dbase", "period"), f"""
    SELECT period_id, fact_id, kpi, dimension, CAST(lo AS VARCHAR) AS period_from, CAST(hi AS VARCHAR) AS period_to, v AS value, unit, b AS baseline,
           CASE WHEN b <> 0 THEN {rnd('(v - b) / b * 100', 1)} END AS delta_pct, {rnd('numerator', 2)} AS numerator, {rnd('denominator', 2)} AS denominator,
           'v1' AS definition_version, CASE WHEN kpi = 'contribution_roas' THEN 'partial' ELSE 'ok' END AS quality_flag
    FROM (SELECT *, CASE unit WHEN 'count' THEN {rnd('value', 0)} WHEN 'ratio' THEN {rnd('value', 3)} ELSE {rnd('value', 1)} END AS v,
                 CASE unit WHEN 'ratio' THEN {rnd('baseline', 3)} ELSE {rnd('baseline', 1)} END AS b FROM dbase) JOIN period USING (period_id)""")
register("dseries", ("d2c_daily",), f"""
    SELECT CAST(date AS VARCHAR) AS date, channel, {rnd('spend', 2)} AS spend, sessions, new_customers, {rnd('revenue', 2)} AS revenue, {rnd(div('spend', 'new_customers'), 2)} AS cac
    FROM d2c_daily WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AND channel IN ('instagram', 'google')""")
_Z = "CAST(0.6745 AS DOUBLE) * (cac - med) / nullif(mad, 0)"

ORACLES = {
    "d01_baseline_window": with_views("""
        SELECT CAST(day AS VARCHAR) AS period_from, CAST(e - 27 AS VARCHAR) AS baseline_from, CAST(e AS VARCHAR) AS baseline_to
        FROM (SELECT DISTINCT day, day - 1 - CAST((dayofweek(day - 1) + 1) % 7 AS INTEGER) AS e FROM ev)""", "ev"),
    "d02_baselines": with_views(f"SELECT period_id, fact_id, baseline_kind, {rnd('baseline', 6)} AS baseline FROM dbase", "dbase"),
    "d03_kpi_facts": with_views("SELECT * FROM dfact", "dfact"),
    **{k: with_views(f"SELECT {', '.join(BRIEF)} FROM dfact WHERE fact_id IN ({', '.join(repr(i) for i in ids)})", "dfact") for k, ids in FACT_QUERIES.items()},
    "d18_stage_seen": with_views(f"SELECT period_id, {_SEEN} AS stage, count(*) AS leads FROM d2c_lead, period WHERE created_at <= as_of GROUP BY 1, 2", "d2c_lead", "period"),
    "d20_daily_series": with_views("SELECT * FROM dseries", "dseries"),
    "d21_anomalies": with_views(f"""
        SELECT channel, date, cac AS value, {rnd(_Z, 6)} AS z, coalesce(abs({_Z}) > 3.5, false) AS anomaly
        FROM dseries JOIN (SELECT channel, any_value(med) AS med, median(abs(cac - med)) AS mad
                           FROM (SELECT *, median(cac) OVER (PARTITION BY channel) AS med FROM dseries WHERE date < '2024-01-22' AND cac IS NOT NULL) GROUP BY 1) USING (channel)""", "dseries"),
    "d22_current_summary": with_views(f"""
        SELECT count(*) AS orders, {rnd('sum(revenue)', 2)} AS revenue, count(DISTINCT customer_id) AS customers FROM d2c_order WHERE day BETWEEN DATE '2024-01-28' AND DATE '2024-01-30'""", "d2c_order"),
}
