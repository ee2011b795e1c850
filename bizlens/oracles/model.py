"""Section H in SQL."""

from __future__ import annotations

from bizlens.functions import model as mdl
from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views

_S = {k: v for k, v in mdl.SCALER.items()}


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def raw_p(po: str = "previous_outcome", prior: str = "prior_contacts", days: str = "days_since_last_contact", camp: str = "contacts_this_campaign") -> str:
    def sc(x, n):
        return f"(({x}) - {D(_S[n][0])}) / {D(_S[n][1])}"

    w = mdl.COEF
    z = (f"({D(mdl.INTERCEPT)} + {D(w[0])} * CASE WHEN {po} = 'failure' THEN 1.0 ELSE 0.0 END + {D(w[1])} * CASE WHEN {po} = 'success' THEN 1.0 ELSE 0.0 END "
         f"+ {D(w[2])} * {sc(f'CAST(least(greatest({prior}, 0), 7) AS DOUBLE)', 'prior_contacts')} + {D(w[3])} * CASE WHEN {days} >= 999 THEN 1.0 ELSE 0.0 END "
         f"+ {D(w[4])} * {sc(f'CASE WHEN {days} >= 999 THEN CAST(0 AS DOUBLE) ELSE CAST(least(greatest({days}, 0), 30) AS DOUBLE) END', 'days_since_last_contact')} "
         f"+ {D(w[5])} * {sc(f'CAST(least(greatest({camp}, 1), 10) AS DOUBLE)', 'contacts_this_campaign')})")
    return f"(1.0 / (1.0 + exp(-{z})))"


def cal(p: str) -> str:
    q = f"least(greatest({p}, {D(1e-6)}), {D(1 - 1e-6)})"
    return f"(1.0 / (1.0 + exp(-({D(mdl.CALIBRATION[0])} * ln({q} / (1 - {q})) + {D(mdl.CALIBRATION[1])}))))"


BANK_P = cal(raw_p())

register("contact0", (), """
    SELECT o_orderkey AS order_id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, month(o_orderdate) AS month,
           lag(o_orderstatus) OVER w AS prev_status, lag(CAST(o_orderdate AS DATE)) OVER w AS prev_day, row_number() OVER w - 1 AS prior,
           CAST(o_totalprice AS DECIMAL(14,2)) AS price, sum(CAST(o_totalprice AS DECIMAL(14,2))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_sum
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""")
register("contact", ("contact0",), """
    SELECT order_id, customer, day, month, CASE WHEN prev_status IS NULL THEN 'nonexistent' WHEN prev_status = 'F' THEN 'success' ELSE 'failure' END AS previous_outcome, prior AS prior_contacts,
           CASE WHEN prev_day IS NULL THEN 999 ELSE day - prev_day END AS days_since_last_contact, 1 + order_id % 4 AS contacts_this_campaign,
           CASE WHEN prior > 0 AND price * prior > prior_sum THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY day, order_id) - 1 AS row_idx FROM contact0""")
register("split", ("contact",), """
    SELECT *, row_idx - lo AS idx, row_idx - lo >= floor(0.8 * n) AS hold_out FROM (SELECT *, min(row_idx) OVER () AS lo, count(*) OVER () AS n FROM contact WHERE year(day) >= 1996)""")
register("enc", ("contact",), """
    SELECT order_id, CASE WHEN previous_outcome = 'failure' THEN 1.0 ELSE 0.0 END AS x_failure, CASE WHEN previous_outcome = 'success' THEN 1.0 ELSE 0.0 END AS x_success,
           CAST(least(greatest(prior_contacts, 0), 7) AS DOUBLE) AS x_prior_contacts, CASE WHEN days_since_last_contact >= 999 THEN 1.0 ELSE 0.0 END AS x_never_contacted,
           CASE WHEN days_since_last_contact >= 999 THEN 0.0 ELSE CAST(least(greatest(days_since_last_contact, 0), 30) AS DOUBLE) END AS x_days_since_last_contact,
           CAST(least(greatest(contacts_this_campaign, 1), 10) AS DOUBLE) AS x_contacts_this_campaign FROM contact""")
register("gappy", ("contact",), """
    SELECT * REPLACE (CASE WHEN order_id % 60 = 0 THEN NULL ELSE prior_contacts END AS prior_contacts, CASE WHEN order_id % 70 = 0 THEN 'maybe' ELSE previous_outcome END AS previous_outcome),
           CASE WHEN order_id % 50 <> 0 THEN 'web' END AS channel FROM contact""")
register("miss", ("gappy",), """
    SELECT *, concat_ws(', ', CASE WHEN channel IS NULL THEN 'channel' END, CASE WHEN previous_outcome NOT IN ('nonexistent', 'failure', 'success') THEN 'previous_outcome' END,
                        CASE WHEN prior_contacts IS NULL THEN 'prior_contacts' END) AS missing FROM gappy""")
_R = mdl.REFERENCE
_alt_h = cal(raw_p(f"'{_R['previous_outcome']}'", str(_R["prior_contacts"]), str(_R["days_since_last_contact"])))
_alt_c = cal(raw_p(camp=str(_R["contacts_this_campaign"])))
register("contrib", ("miss",), f"""
    SELECT *, concat_ws('; ', CASE WHEN abs(h) >= abs(c) AND abs(h) >= 0.005 THEN 'contact_history ' || printf('%.3f', h) END,
                        CASE WHEN abs(c) >= 0.005 THEN 'contacts_this_campaign ' || printf('%.3f', c) END, CASE WHEN abs(h) < abs(c) AND abs(h) >= 0.005 THEN 'contact_history ' || printf('%.3f', h) END) AS factors
    FROM (SELECT *, {rnd(f'p - {_alt_h}', 3)} AS h, {rnd(f'p - {_alt_c}', 3)} AS c FROM (SELECT *, {BANK_P} AS p FROM miss WHERE missing = ''))""")
_MODELS = f"""SELECT idx, y, {raw_p()} AS p, 'uncalibrated' AS model FROM split WHERE hold_out UNION ALL SELECT idx, y, {BANK_P}, 'calibrated' FROM split WHERE hold_out
    UNION ALL SELECT idx, y, {D(mdl.BASE_RATE)}, 'constant' FROM split WHERE hold_out"""
register("scored0", ("split",), _MODELS)
register("scored", ("scored0",), f"SELECT idx, y, {rnd('p', 9)} AS p, model FROM scored0")
register("ranked_metric", ("scored",), f"""
    SELECT model, {rnd("sum(pos * tp / CAST(seen AS DOUBLE)) / max(tp)", 6)} AS pr_auc, {rnd("sum((n - pos) * (2 * tp - pos)) / (2.0 * max(tp) * (max(seen) - max(tp)))", 6)} AS roc_auc, CAST(max(seen) AS BIGINT) AS n
    FROM (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM (SELECT model, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
    GROUP BY 1""")
register("cal_metric", ("scored",), f"""
    SELECT model, {rnd('sum((p - y) * (p - y)) / count(*)', 6)} AS brier, {rnd(div('sum(y)', 'count(*)'), 6)} AS prevalence,
           (SELECT {rnd('sum(abs(sp - sy)) / sum(n)', 6)} FROM (SELECT model AS m, least(floor(p * 10), 9) AS bin, sum(p) AS sp, sum(y) AS sy, count(*) AS n FROM scored GROUP BY 1, 2) WHERE m = s.model) AS calibration_error,
           {rnd("avg(CASE WHEN place <= greatest(1, floor(cnt * 0.1)) THEN y END) / avg(y)", 6)} AS lift_at_10pct
    FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC, idx) AS place, count(*) OVER (PARTITION BY model) AS cnt FROM scored) s GROUP BY 1""")

ORACLES = {
    "h01_features": with_views("SELECT * FROM enc", "enc"),
    "h02_abstention": with_views("SELECT order_id, missing FROM miss WHERE missing <> ''", "miss"),
    "h03_scaling": with_views(f"SELECT {', '.join(f'{rnd(f(c), 6)} AS {k}_{c}' for c in _S for k, f in (('mean', lambda c: f'avg(x_{c})'), ('std', lambda c: f'stddev_pop(x_{c})')))} FROM enc", "enc"),
    "h04_probability": with_views(f"SELECT order_id, {rnd(raw_p(), 9)} AS raw_p FROM contact", "contact"),
    "h05_calibration": with_views(f"""
        SELECT order_id, {rnd(cal('p'), 9)} AS sigmoid, {rnd('CASE WHEN p <= 0 THEN 0.1 WHEN p < 0.5 THEN 0.1 + CAST(0.3 AS DOUBLE) * p / 0.5 WHEN p < 1 THEN 0.4 + CAST(0.5 AS DOUBLE) * (p - 0.5) / 0.5 ELSE 0.9 END', 9)} AS isotonic
        FROM (SELECT order_id, {raw_p()} AS p FROM contact)""", "contact"),
    "h06_contributions": with_views(f"SELECT order_id, {rnd('p', 3)} AS probability, factors FROM contrib", "contrib"),
    "h07_queue": with_views(f"""
        SELECT lead_id, probability, value, factors, missing, CASE WHEN probability IS NOT NULL THEN pos END AS rank FROM (
        SELECT *, row_number() OVER (ORDER BY probability IS NULL, coalesce(value, 0) DESC, lead_id) AS pos FROM (
        SELECT order_id AS lead_id, {rnd('p', 3)} AS probability, {rnd(f'{rnd("p", 3)} * (order_id % 1000)', 2)} AS value, factors, missing FROM contrib
        UNION ALL SELECT order_id, NULL, NULL, '', 'Missing key fields: ' || missing FROM miss WHERE missing <> '')) WHERE pos <= 50""", "contrib"),
    "h08_split": with_views("SELECT order_id, year(day) AS year, idx, hold_out FROM split", "split"),
    "h13_ranking_metrics": with_views("SELECT * FROM ranked_metric", "ranked_metric"),
    "h14_calibration_metrics": with_views("SELECT * FROM cal_metric", "cal_metric"),
}
