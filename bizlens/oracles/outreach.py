"""Section M in SQL."""

from __future__ import annotations

from bizlens.operators.actions import PROTECTED_TERMS
from bizlens.oracles import diagnosis as _dx  # noqa: F401  registers asked
from bizlens.oracles import leads as _ld  # noqa: F401  registers listed
from bizlens.oracles.views import register, with_views

register("reason", ("lead_snapshot",), """
    SELECT * FROM (SELECT business_id, as_of, 1 AS place, 'drop_week_' || i AS reason_key FROM (SELECT *, CAST((as_of - DATE '2024-01-01') / 7 AS INTEGER) AS i FROM lead_snapshot) WHERE (business_id + i) % 2 = 0
    UNION ALL SELECT business_id, as_of, 2, 'preorder_week_' || i FROM (SELECT *, CAST((as_of - DATE '2024-01-01') / 7 AS INTEGER) AS i FROM lead_snapshot) WHERE (business_id + i) % 3 = 0
    UNION ALL SELECT business_id, as_of, 3, 'offer_week_' || i FROM (SELECT *, CAST((as_of - DATE '2024-01-01') / 7 AS INTEGER) AS i FROM lead_snapshot) WHERE (business_id + i) % 5 <> 1)""")
register("warm_reason", ("listed", "reason"), """
    SELECT l.business_id, l.as_of, l.lead_id, arg_min(reason_key, place) AS reason_key FROM listed l JOIN reason r ON r.business_id = l.business_id AND r.as_of = l.as_of
    WHERE grp = 'warm' AND NOT (reason_key = 'drop_week_2' AND user_id % 3 = 0) AND NOT (reason_key = 'offer_week_3' AND user_id % 2 = 0) GROUP BY 1, 2, 3""")
register("ranked_lead", ("listed",), """
    SELECT *, CASE WHEN grp <> 'disqualified' THEN row_number() OVER (PARTITION BY business_id, as_of ORDER BY CASE grp WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 WHEN 'cold' THEN 2 ELSE 3 END, -score,
           CASE WHEN relationship = 'stranger' THEN 0 ELSE 1 END, last_signal DESC, lead_id) END AS rank FROM listed""")
_price = "format('{:,}', CAST(floor(price) AS BIGINT)) || '.' || regexp_extract(CAST(price AS VARCHAR), '\\.(\\d+)$', 1)"
register("draft", ("listed", "asked", "product", "profile"), f"""
    SELECT business_id, as_of, lead_id, CASE WHEN product IS NULL THEN 'Hi! Thanks for your message. Here is what we have and the prices: ' || order_link || '.'
        WHEN user_id % 8 = 1 THEN 'Hi! The ' || product || ' is ₹' || {_price} || '. It is back in stock on {{restock_date}}; shall I keep one for you?'
        ELSE concat_ws(' ', 'Hi!', 'The ' || product || ' is ₹' || {_price} || CASE WHEN size IS NULL THEN '' WHEN size IN ('S', 'M', 'L', 'XL') THEN ' and we make it in ' || size ELSE ' (' || size || ')' END || '.',
             'Yes, we can do ' || design || ' (₹{{custom_price}} extra, if any).', CASE WHEN asked_city = own THEN 'We deliver in ' || asked_city || '.' ELSE 'We deliver to ' || asked_city || '; delivery is ₹{{delivery_charge}}.' END,
             'You can order here: ' || order_link || ' (payment by ' || payment || '). Shall I keep one for you?') END AS draft
    FROM (SELECT l.business_id, l.as_of, l.lead_id, l.user_id, l.size, l.city AS asked_city, l.design, CASE WHEN l.user_id % 6 <> 0 THEN a.product END AS product, f.city AS own, f.order_link, f.payment
          FROM listed l JOIN asked a ON a.lead_id = l.lead_id JOIN profile f ON f.business_id = l.business_id WHERE grp = 'hot') x LEFT JOIN (SELECT business_id, name AS product, price FROM product) p USING (business_id, product)""")
_RISK = "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(t, '(?i)(^|[^[:word:]])' || regexp_escape('{t}') || '([^[:word:]]|$)') THEN '{t}' END" for t in PROTECTED_TERMS) + ")"
ORACLES = {
    "m01_next_actions": with_views("""
        SELECT r.business_id, CAST(r.as_of AS VARCHAR) AS as_of, r.lead_id, grp AS "group",
               CASE grp WHEN 'hot' THEN 'Reply today.' WHEN 'warm' THEN coalesce('Message once about ' || CASE split_part(reason_key, '_', 1) WHEN 'drop' THEN 'a small drop for the next event'
                    WHEN 'preorder' THEN 'a limited pre-order of our best seller' WHEN 'offer' THEN 'a small first-order offer' END || '.', 'Wait for a reason to message (a new drop, a restock or a first-order offer); do not chase.')
                    WHEN 'cold' THEN 'Nothing one to one; they will see your regular posts.' ELSE 'Reply politely once; no follow-up.' END AS next_action,
               row_number() OVER (PARTITION BY r.business_id, r.as_of, grp ORDER BY CASE WHEN grp = 'hot' THEN last_signal END DESC, coalesce(rank, 0), r.lead_id) AS position
        FROM ranked_lead r LEFT JOIN (SELECT business_id AS wb, as_of AS wa, lead_id AS wl, CASE WHEN reason_key IS NOT NULL THEN reason_key END AS reason_key FROM warm_reason) w ON wb = r.business_id AND wa = r.as_of AND wl = r.lead_id""", "ranked_lead", "warm_reason"),
    "m02_warm_reasons": with_views("SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, lead_id, reason_key FROM warm_reason", "warm_reason"),
    "m03_reply_texts": with_views("SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, lead_id, draft, array_to_string(regexp_extract_all(draft, '\\{[a-z_]+\\}'), ',') AS placeholders FROM draft", "draft"),
    "m04_unmet_demand": with_views("""
        SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, kind, value, CASE kind WHEN 'city' THEN 'deliver to ' WHEN 'size' THEN 'make size ' WHEN 'design' THEN 'make ' ELSE 'offer ' END || value AS phrase, count(*) AS count
        FROM (SELECT business_id, as_of, split_part(reason, ':', 1) AS kind, CASE WHEN reason LIKE 'city%' THEN replace(reason, 'city: cannot deliver to ', '') WHEN reason LIKE 'size%' THEN regexp_extract(reason, '^size: (.*) is not available$', 1)
                     ELSE regexp_extract(reason, '^design: (.*)$', 1) END AS value FROM listed WHERE grp = 'disqualified') GROUP BY 1, 2, 3, 4""", "listed"),
    "m04_closed_outcomes": with_views("""
        SELECT n.business_id, CAST(n.as_of AS VARCHAR) AS as_of, count(*) FILTER (l.outcome = 'ordered') AS ordered, count(*) FILTER (l.outcome = 'not_ordered') AS not_ordered
        FROM lead_snapshot n LEFT JOIN lead l ON l.business_id = n.business_id AND l.outcome_date < n.as_of GROUP BY 1, 2""", "lead_snapshot", "lead"),
    "m05_risk_flags": with_views(f"""
        SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, lead_id, nullif({_RISK}, '') AS risk_terms FROM (SELECT *, CASE WHEN length(draft) % 3 = 0 THEN draft || ' Nike style' ELSE draft END AS t FROM draft)""", "draft"),
}
