"""Section P in SQL: what each stream must have produced once everything has arrived."""

from __future__ import annotations

from bizlens.operators.leads import POINTS
from bizlens.oracles import imports as _im  # noqa: F401
from bizlens.oracles.views import register, with_views

register("arrival", ("biz_order",), """
    SELECT *, CAST((year(date) - 1992) // 2 AS BIGINT) + CASE WHEN order_id % 97 = 0 THEN 1 ELSE 0 END AS part FROM biz_order""")

ORACLES = {
    "p01_streaming_import": with_views("""SELECT import_id, count(DISTINCT CASE WHEN state = 'accepted' THEN c_id END) AS orders, count(CASE WHEN state = 'accepted' THEN 1 END) AS accepted,
        count(CASE WHEN state = 'merged' THEN 1 END) AS merged, count(CASE WHEN reason = 'conflicting_duplicate' THEN 1 END) AS conflicting, count(error_code) AS refused FROM judged2 GROUP BY 1""", "judged2"),
    "p02_streaming_lead_scores": with_views(f"SELECT business_id, lead_id, CAST(sum(CASE type {' '.join(f'WHEN {t!r} THEN {p}' for t, p in POINTS.items())} END) AS BIGINT) AS score FROM (SELECT DISTINCT business_id, lead_id, type FROM lead_signal) GROUP BY 1, 2", "lead_signal"),
    "p03_streaming_weekly_counts": with_views("""SELECT CAST(week AS VARCHAR) AS week, business_id, relationship, count(CASE WHEN mark IS NULL OR week + 7 > mark THEN 1 END) AS on_time,
        count(CASE WHEN week + 7 <= mark THEN 1 END) AS late
        FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS week, business_id, relationship, part FROM arrival)
        LEFT JOIN (SELECT k, (SELECT max(date) FROM arrival WHERE part < k) - 14 AS mark FROM range(0, 9) t(k)) ON k = part GROUP BY 1, 2, 3""", "arrival"),
}
