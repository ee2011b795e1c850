"""Section B in SQL."""

from __future__ import annotations

from bizlens.functions import clean as cl
from bizlens.operators.imports import ISSUE_ORDER, KPI_TRUST, SPECS
from bizlens.oracles import facts as _fact_views  # noqa: F401  registers the fact view
from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views

register("sheet0", (), """
    SELECT *, l_orderkey * 7 + l_linenumber AS k, CAST(l_shipdate AS DATE) AS d, CAST(floor(l_extendedprice / 10) AS BIGINT) AS a,
           (l_partkey * 100000 + (CAST(l_shipdate AS DATE) - DATE '1995-01-01')) * 64 + CAST(l_quantity AS BIGINT) AS pos FROM lineitem""")
register("sheet1", ("sheet0",), """
    SELECT k, 'imp_orders_' || (l_orderkey % 4) AS import_id, pos * 2 AS source_row,
           CASE WHEN k % 97 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END AS c_id,
           CASE WHEN k % 101 = 0 THEN 'not a date' WHEN k % 103 = 0 THEN '' WHEN k % 13 = 0 THEN strftime(d, '%d/%m/%Y')
                WHEN k % 14 = 0 THEN strftime(d, '%Y-%m-%d') || 'T10:30:00Z' WHEN k % 15 = 0 THEN strftime(d, '%d-%m-%Y') ELSE strftime(d, '%Y-%m-%d') END AS c_date,
           CAST(l_suppkey AS VARCHAR) AS c_customer,
           CASE WHEN k % 23 = 0 THEN 'TikTok' WHEN k % 29 = 0 THEN '' WHEN l_returnflag = 'A' THEN 'Instagram Ads' WHEN l_returnflag = 'R' THEN 'Google CPC' ELSE 'direct' END AS c_source,
           CASE WHEN k % 5 = 0 THEN '' ELSE 'camp_' || (l_suppkey % 7) END AS c_campaign,
           CASE k % 6 WHEN 0 THEN 'COD' WHEN 1 THEN 'UPI' WHEN 2 THEN 'Card' WHEN 3 THEN 'barter' WHEN 4 THEN '' ELSE 'Cash on Delivery' END AS c_pay,
           CASE WHEN k % 107 = 0 THEN 'abc' WHEN k % 109 = 0 THEN '-5' WHEN k % 103 = 1 THEN '' WHEN k % 17 = 0 THEN CAST(a * 100 AS VARCHAR)
                WHEN k % 19 = 0 THEN 'Rs. ' || format('{:,}', a) WHEN k % 2 = 0 THEN a || '.50' ELSE CAST(a AS VARCHAR) END AS c_amount,
           CASE WHEN k % 3 = 0 THEN '' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END AS c_discount,
           CASE WHEN k % 31 = 0 THEN 'lost in post' WHEN k % 37 = 0 THEN '' WHEN l_linestatus = 'F' THEN ' Delivered ' ELSE 'Returned to Origin' END AS c_status,
           CASE WHEN k % 4 = 1 THEN 'Item ' || (l_partkey % 50) || '|Mug' ELSE 'Item ' || (l_partkey % 50) || ' x' || CAST(l_quantity AS BIGINT) || '; Cap x1' END AS c_items,
           CASE k % 7 WHEN 0 THEN 'my friend' WHEN 1 THEN 'Friend of friend' WHEN 2 THEN 'Found on Insta!' WHEN 3 THEN 'FoF' WHEN 4 THEN 'cousin (family)' WHEN 5 THEN '???' ELSE '' END AS c_rel,
           CASE WHEN k % 5 = 2 THEN 'Item ' || (l_partkey % 50) ELSE '' END AS c_product,
           CASE WHEN k % 113 = 0 THEN '2.5' WHEN k % 8 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS c_qty,
           CASE WHEN k % 10 = 0 THEN 'p' || l_suppkey ELSE '' END AS c_post,
           CASE WHEN k % 127 = 0 THEN 'soon' WHEN k % 3 = 0 THEN '' WHEN k % 26 = 1 THEN strftime(d + 2, '%d/%m/%Y') ELSE strftime(d + 2, '%Y-%m-%d') END AS c_sent
    FROM sheet0""")
register("sheet", ("sheet1",), "SELECT * FROM sheet1 UNION ALL SELECT * REPLACE (source_row + 1 AS source_row) FROM sheet1 WHERE k % 11 = 0")

_ISO = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")
_DAY = ("%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%d-%m-%Y %H:%M", "%d-%m-%Y", "%d/%m/%y")


def iso(c: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in _ISO) + ")"


def any_date(c: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in _ISO + _DAY) + ")"


def money(c: str) -> str:
    v = f"try_cast(trim(replace(regexp_replace({c}, '(?i)(₹|rs\\.?|inr)', '', 'g'), ',', '')) AS DOUBLE)"
    return f"CASE WHEN {v} >= 0 THEN {v} END"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def words(c: str, table: dict, default: str) -> str:
    return f"coalesce(map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in table.items())}}}[{norm(c)}], '{default}')"


def rel(c: str) -> str:
    t = norm(c)
    has = lambda ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
    return (f"CASE WHEN {t} = '' THEN 'unknown' WHEN {has(cl.FRIEND_OF_FRIEND_WORDS)} OR list_contains(string_split({t}, ' '), 'fof') THEN 'friend_of_friend' "
            f"WHEN {has(cl.FRIEND_WORDS)} THEN 'friend' WHEN {has(cl.STRANGER_WORDS)} THEN 'stranger' ELSE 'unknown' END")


register("typed0", ("sheet",), f"""
    SELECT *, {iso('c_date')} AS d_iso, {any_date('c_date')} AS ordered_at, {iso('c_sent')} AS s_iso, {any_date('c_sent')} AS sent, {money('c_amount')} AS m,
           {money('c_discount')} AS disc, {money('c_qty')} AS q, {words('c_source', cl.CHANNEL_WORDS, 'other')} AS channel, {rel('c_rel')} AS relationship,
           CASE WHEN c_pay <> '' THEN {words('c_pay', cl.PAYMENT_WORDS, 'unknown')} END AS payment, CASE WHEN c_status <> '' THEN {words('c_status', cl.STATUS_WORDS, 'unknown')} END AS status
    FROM sheet""")
register("typed1", ("typed0",), f"""
    SELECT *, coalesce(m > 15000 AND m % 100 = 0 AND m / 100 <= 15000, false) AS minor,
           CASE WHEN c_id = '' THEN 'order_id' WHEN ordered_at IS NULL THEN 'ordered_at' WHEN m IS NULL THEN 'revenue' WHEN c_discount <> '' AND disc IS NULL THEN 'discount'
                WHEN c_qty <> '' AND (q IS NULL OR q <> floor(q)) THEN 'quantity' WHEN c_sent <> '' AND sent IS NULL THEN 'dispatched_at' END AS bad_field
    FROM typed0""")
register("typed", ("typed1",), f"""
    SELECT *, {rnd('CASE WHEN minor THEN m / 100 ELSE m END', 2)} AS revenue,
           coalesce(CASE bad_field WHEN 'order_id' THEN 'missing_required' WHEN 'ordered_at' THEN CASE WHEN c_date = '' THEN 'missing_required' ELSE 'invalid_date' END
                    WHEN 'revenue' THEN CASE WHEN c_amount = '' THEN 'missing_required' ELSE 'invalid_amount' END WHEN 'quantity' THEN 'invalid_amount'
                    WHEN 'discount' THEN 'invalid_amount' WHEN 'dispatched_at' THEN 'invalid_date' END,
                    CASE WHEN c_campaign = '' AND channel IN ('instagram', 'google') THEN 'missing_campaign_id' END) AS error_code,
           coalesce(bad_field, CASE WHEN c_campaign = '' AND channel IN ('instagram', 'google') THEN 'campaign_id' END) AS error_field,
           ordered_at IS NOT NULL AND d_iso IS NULL AND coalesce(bad_field, '') <> 'order_id' AS fix_date,
           minor AND coalesce(bad_field, '') NOT IN ('order_id', 'ordered_at') AS fix_unit,
           sent IS NOT NULL AND s_iso IS NULL AND bad_field IS NULL AS fix_sent
    FROM typed1""")
_REC = ("ordered_at, c_customer, channel, c_campaign, payment, revenue, disc, status, c_items, relationship, c_product, q, c_post, sent")
register("judged", ("typed",), f"""
    SELECT t.*, CASE WHEN error_code IS NOT NULL THEN 'quarantined' WHEN source_row = first_row THEN 'accepted'
                     WHEN ROW({_REC}) IS NOT DISTINCT FROM first_rec THEN 'merged' ELSE 'quarantined' END AS state
    FROM (SELECT *, CASE WHEN error_code IS NULL THEN first_value(source_row) OVER w END AS first_row, CASE WHEN error_code IS NULL THEN first_value(ROW({_REC})) OVER w END AS first_rec
          FROM typed WINDOW w AS (PARTITION BY import_id, c_id, error_code IS NULL ORDER BY source_row)) t""")
register("judged2", ("judged",), """
    SELECT *, CASE WHEN error_code IS NOT NULL THEN error_code WHEN state = 'quarantined' THEN 'conflicting_duplicate' END AS reason,
           state = 'accepted' AND c_campaign = '' AS unattributed,
           CASE WHEN error_code = 'missing_campaign_id' THEN 'campaign blank on a paid ' || channel || ' order (' || c_id || ')'
                WHEN error_code = 'missing_required' THEN bad_field || ' is blank (row ' || source_row || ')'
                WHEN error_code = 'invalid_date' THEN '''' || CASE bad_field WHEN 'ordered_at' THEN c_date ELSE c_sent END || ''' is not a date (row ' || source_row || ')'
                WHEN bad_field = 'revenue' THEN '''' || c_amount || ''' is not an amount (row ' || source_row || ')'
                WHEN bad_field = 'quantity' THEN '''' || c_qty || ''' is not a whole number (row ' || source_row || ')'
                WHEN state = 'merged' THEN c_id || ' appears twice with the same values'
                WHEN state = 'quarantined' THEN c_id || ' appears twice with different values' END AS message FROM judged""")
register("issue", ("judged2",), f"""
    SELECT import_id, source_row, 1 AS pos, 'mixed_date_format' AS code, 'repaired_to_iso' AS action, c_date || ' -> ' || strftime(ordered_at, '%Y-%m-%d') AS example FROM judged2 WHERE fix_date UNION ALL
    SELECT import_id, source_row, 2, 'amount_in_paise', 'repaired_units', CAST(m AS BIGINT) || ' -> ' || printf('%.2f', m / 100) || ' INR' FROM judged2 WHERE fix_unit UNION ALL
    SELECT import_id, source_row, 3, 'mixed_date_format', 'repaired_to_iso', c_sent || ' -> ' || strftime(sent, '%Y-%m-%d') FROM judged2 WHERE fix_sent UNION ALL
    SELECT import_id, source_row, 4, reason, 'quarantined', message FROM judged2 WHERE state = 'quarantined' UNION ALL
    SELECT import_id, source_row, 4, 'duplicate_order', 'merged', message FROM judged2 WHERE state = 'merged' UNION ALL
    SELECT import_id, source_row, 5, 'unattributed', 'kept_as_unattributed', channel || ' order with no campaign (' || c_id || ')' FROM judged2 WHERE unattributed""")
register("import_report", ("judged2",), f"""
    SELECT *, {rnd('greatest(0.0, CAST(1.0 AS DOUBLE) - 2 * (rows_quarantined / CAST(rows_total AS DOUBLE)) - CAST(0.5 AS DOUBLE) * (rows_repaired / CAST(rows_total AS DOUBLE)) - CAST(0.5 AS DOUBLE) * (unattributed / CAST(rows_total AS DOUBLE)))', 2)} AS confidence
    FROM (SELECT import_id, count(*) AS rows_total, count(CASE WHEN state = 'accepted' THEN 1 END) AS rows_loaded,
                 count(CASE WHEN state = 'accepted' AND (fix_date OR fix_unit OR fix_sent) THEN 1 END) AS rows_repaired,
                 count(CASE WHEN state = 'quarantined' THEN 1 END) AS rows_quarantined, count(CASE WHEN state = 'merged' THEN 1 END) AS duplicates_merged,
                 count(CASE WHEN unattributed THEN 1 END) AS unattributed,
                 {rnd('coalesce(sum(CASE WHEN unattributed THEN CAST(revenue AS DECIMAL(18,4)) END), 0)', 2)} AS unattributed_revenue,
                 {rnd("coalesce(sum(CASE WHEN state = 'accepted' THEN CAST(revenue AS DECIMAL(18,4)) END), 0)", 2)} AS loaded_revenue FROM judged2 GROUP BY 1)""")
_BADGE = "CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END"
register("item", ("judged2",), f"""
    SELECT import_id, c_id AS order_id, n AS item_no, {rnd('(revenue + coalesce(disc, 0)) / CASE WHEN pieces = 0 THEN 1 ELSE pieces END', 2)} AS price,
           CASE WHEN hit THEN trim(regexp_extract(p, '(?i)^(.+?)\\s*[x×]\\s*(\\d+)\\s*$', 1)) ELSE p END AS name, qty
    FROM (SELECT *, sum(qty) OVER (PARTITION BY import_id, c_id) AS pieces
          FROM (SELECT *, CASE WHEN c_product <> '' THEN CASE WHEN coalesce(q, 0) <> 0 THEN CAST(q AS BIGINT) ELSE 1 END
                               WHEN hit THEN CAST(regexp_extract(p, '(?i)^(.+?)\\s*[x×]\\s*(\\d+)\\s*$', 2) AS BIGINT) ELSE 1 END AS qty
                FROM (SELECT *, c_product = '' AND regexp_matches(p, '(?i)^(.+?)\\s*[x×]\\s*(\\d+)\\s*$') AS hit
                      FROM (SELECT *, trim(unnest(CASE WHEN c_product <> '' THEN [c_product] ELSE string_split_regex(c_items, '[;|]') END)) AS p,
                                   unnest(range(0, CASE WHEN c_product <> '' THEN 1 ELSE len(string_split_regex(c_items, '[;|]')) END)) AS n
                            FROM judged2 WHERE state = 'accepted'))))""")
register("cost_row", (), """
    SELECT import_id, i AS source_row, 'Item ' || i AS product, CAST(y AS DOUBLE) AS material, CAST(z AS DOUBLE) AS making, CASE WHEN i % 2 = 0 THEN 2.5 ELSE 0.0 END AS packaging,
           10.0 AS courier, y + z + CASE WHEN i % 2 = 0 THEN 2.5 ELSE 0.0 END + 10.0 AS "full", 'estimate' AS source
    FROM (SELECT p_partkey % 50 AS i, min(p_size) AS z, max(p_size) AS y FROM part GROUP BY 1), (VALUES ('imp_orders_0'), ('imp_orders_1'), ('imp_orders_2'), ('imp_orders_3')) t(import_id)
    WHERE i % 9 <> 0""")
_PSEUDO = "'buyer_' || sha1('bizlens' || lower(trim({0})))"
_TS = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"


def _cells(*cols: str) -> str:
    return f"(SELECT {', '.join(cols)}, count(*) AS n FROM sheet GROUP BY ALL)"


_HEAD = [["Order ID", "Order No.", "Invoice", "order_identifier"], ["Order Date", "Date", "Ordered At", "Odrer Date"],
         ["Order Amount (INR)", "Total", "Grand total", "Amnt"], ["UTM Source", "Channel", "Source", "Trafic source"],
         ["Customer", "Buyer", "Customer E-mail", "Client"], ["Discount", "Coupon discount", "Disc.", "Notes"]]
register("header", (), " UNION ALL ".join(
    f"SELECT 'sheet_' || s_suppkey AS import_id, [{', '.join(repr(x) for x in f)}][1 + (s_suppkey // {4 ** i} + {i} * s_suppkey) % 4] AS col FROM supplier" for i, f in enumerate(_HEAD)))
_SYN = ", ".join(f"('{f.name}', '{n}')" for f in SPECS["orders"] if f.required for n in (f.name.replace("_", " "), *f.synonyms))

ORACLES = {
    "b01_header_norm": "SELECT c_custkey, trim(regexp_replace(lower(c_name || '__(É) ' || c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS header FROM customer",
    "b03_missing_required": with_views(f"""
        SELECT h.import_id, r.field FROM (SELECT DISTINCT import_id FROM header) h, (VALUES ('order_id'), ('ordered_at'), ('revenue')) r(field)
        WHERE NOT EXISTS (SELECT 1 FROM header x JOIN (VALUES {_SYN}) s(f, name) ON {norm('x.col')} = s.name WHERE x.import_id = h.import_id AND s.f = r.field)""", "header"),
    "b04_parse_date": with_views(f"""
        SELECT c_date AS cell, n, {_TS.format(any_date('c_date'))} AS parsed, CASE WHEN {any_date('c_date')} IS NOT NULL THEN {iso('c_date')} IS NOT NULL END AS iso FROM {_cells('c_date')}""", "sheet"),
    "b05_parse_money": with_views(f"SELECT c_amount AS cell, n, {money('c_amount')} AS amount FROM {_cells('c_amount')}", "sheet"),
    "b06_unit_repair": with_views(f"""
        SELECT cell, n, {rnd('CASE WHEN m > 15000 AND m % 100 = 0 AND m / 100 <= 15000 THEN m / 100 ELSE m END', 2)} AS repaired, {rnd('m', 2)} AS unrepaired
        FROM (SELECT c_amount AS cell, n, {money('c_amount')} AS m FROM {_cells('c_amount')}) WHERE m IS NOT NULL""", "sheet"),
    "b07_whole_numbers": with_views(f"""
        SELECT cell, n, CASE WHEN q = floor(q) THEN CAST(q AS BIGINT) END AS whole, CASE WHEN cell <> '' AND (q IS NULL OR q <> floor(q)) THEN 'invalid_amount' END AS error
        FROM (SELECT c_qty AS cell, n, {money('c_qty')} AS q FROM {_cells('c_qty')})""", "sheet"),
    "b08_dictionaries": with_views(f"""
        SELECT c_source AS source, c_pay AS pay, c_status AS state, n, {words('c_source', cl.CHANNEL_WORDS, 'other')} AS channel,
               CASE WHEN c_pay <> '' THEN {words('c_pay', cl.PAYMENT_WORDS, 'unknown')} END AS payment, CASE WHEN trim(c_status) <> '' THEN {words('c_status', cl.STATUS_WORDS, 'unknown')} END AS status,
               CASE WHEN trim(c_status) = '' THEN 'new' ELSE {words('c_status', cl.STAGE_WORDS, 'new')} END AS stage FROM {_cells('c_source', 'c_pay', 'c_status')}""", "sheet"),
    "b09_relationship": with_views(f"SELECT c_rel AS cell, n, {rel('c_rel')} AS relationship FROM {_cells('c_rel')}", "sheet"),
    "b10_first_failing_field": with_views("""
        SELECT import_id, source_row, error_code, error_field, concat_ws(',', CASE WHEN fix_date THEN 'mixed_date_format' END, CASE WHEN fix_unit THEN 'amount_in_paise' END,
               CASE WHEN fix_sent THEN 'mixed_date_format' END) AS repairs FROM typed""", "typed"),
    "b11_quarantine": with_views("""
        SELECT import_id, source_row AS row_number, reason AS reason_code, message, c_id AS raw_id, trim(c_status) AS raw_status FROM judged2 WHERE state = 'quarantined'""", "judged2"),
    "b12_missing_campaign": with_views("SELECT import_id, source_row, c_id AS order_id, message FROM judged2 WHERE reason = 'missing_campaign_id'", "judged2"),
    "b13_merged_duplicates": with_views("SELECT import_id, source_row, c_id AS order_id FROM judged2 WHERE state = 'merged'", "judged2"),
    "b14_conflicting_duplicates": with_views("SELECT import_id, source_row, c_id AS order_id FROM judged2 WHERE reason = 'conflicting_duplicate'", "judged2"),
    "b15_unattributed": with_views(f"SELECT import_id, channel, count(*) AS orders, {rnd('sum(CAST(revenue AS DECIMAL(18,4)))', 2)} AS revenue FROM judged2 WHERE unattributed GROUP BY 1, 2", "judged2"),
    "b16_issue_summary": with_views(f"""
        SELECT import_id, CAST(list_position([{', '.join(repr(c) for c in ISSUE_ORDER)}], code) AS BIGINT) AS position, code, count(*) AS count, min(action) AS action,
               arg_min(example, source_row * 10 + pos) AS example FROM issue GROUP BY import_id, code""", "issue"),
    "b17_b18_import_report": with_views(f"SELECT *, {_BADGE} AS badge FROM import_report", "import_report"),
    "b19_business_quality": with_views(f"""
        SELECT *, {_BADGE} AS badge FROM (
        SELECT 'biz_' || (CAST(right(import_id, 1) AS INTEGER) % 2) AS business_id, count(*) AS imports, {rnd(div('sum(confidence * rows_total)', 'sum(rows_total)'), 2)} AS confidence,
               CAST(sum(rows_repaired) AS BIGINT) AS repaired, CAST(sum(rows_quarantined) AS BIGINT) AS quarantined,
               {rnd(div('sum(unattributed_revenue) * 100', 'sum(loaded_revenue)'), 1)} AS unattributed_revenue_pct FROM import_report GROUP BY 1)""", "import_report"),
    "b20_kpi_trust": with_views(f"""
        SELECT *, CASE kpi {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KPI_TRUST.items())} END AS trust FROM (
        SELECT business_id, week_no, value, CASE kpi WHEN 'repeat_customer_share' THEN 'repeat_rate' WHEN 'margin_pct' THEN 'contribution_roas' ELSE kpi END AS kpi
        FROM fact WHERE fact_id IN ('f_repeat_customer_share', 'f_margin_pct', 'f_stranger_share'))""", "fact"),
    "b21_item_split": with_views("SELECT import_id, name, count(*) AS lines, CAST(sum(qty) AS BIGINT) AS qty FROM item GROUP BY 1, 2", "item"),
    "b22_order_records": with_views(f"""
        SELECT j.import_id, c_id AS order_id, CAST(CAST(ordered_at AS DATE) AS VARCHAR) AS date, {_PSEUDO.format("coalesce(nullif(c_customer, ''), c_id)")} AS buyer_ref,
               {rnd('revenue + coalesce(disc, 0)', 2)} AS gross, coalesce(disc, 0) AS discount, revenue AS total, coalesce(payment, 'unknown') AS payment, channel, relationship,
               nullif(c_post, '') AS post_id, CAST(CAST(sent AS DATE) AS VARCHAR) AS dispatched_at, coalesce(status, CASE WHEN sent IS NOT NULL THEN 'delivered' ELSE 'open' END) AS status, items
        FROM judged2 j LEFT JOIN (SELECT i.import_id, order_id, string_agg(name || '/' || qty || '/' || printf('%.2f', price) || '/' || printf('%.2f', coalesce("full", 0)), ';' ORDER BY item_no) AS items
                             FROM item i LEFT JOIN cost_row c ON c.import_id = i.import_id AND c.product = i.name GROUP BY 1, 2) x
             ON x.import_id = j.import_id AND x.order_id = j.c_id WHERE state = 'accepted'""", "judged2", "item", "cost_row"),
    "b23_cost_sheet": with_views("SELECT * FROM cost_row", "cost_row"),
    "b24_post_records": with_views("""
        SELECT post_id, CAST(date AS VARCHAR) AS date, reach, CASE WHEN reach % 30 = 0 THEN 0 ELSE profile_visits END AS profile_visits,
               CASE WHEN reach % 70 = 0 THEN 0 ELSE follows END AS follows, CAST(0 AS BIGINT) AS saves, CAST(0 AS BIGINT) AS shares, topic FROM biz_post""", "biz_post"),
    "b25_first_order_flags": with_views("""
        SELECT business_id, order_id, buyer_ref FROM (SELECT *, row_number() OVER (PARTITION BY business_id, buyer_ref ORDER BY date, order_id) AS r FROM biz_order) WHERE r = 1""", "biz_order"),
    "b26_timeline": with_views("""
        SELECT business_id, CAST(a AS VARCHAR) AS history_start, CAST(b AS VARCHAR) AS advisory_start, (b - a) // 7 AS history_weeks
        FROM (SELECT business_id, CAST(date_trunc('week', min(date)) AS DATE) AS a, CAST(date_trunc('week', max(date)) AS DATE) + 7 AS b FROM biz_order GROUP BY 1)""", "biz_order"),
    "b27_profile_provenance": with_views("""
        SELECT business_id, field, value, CASE WHEN field IN ('city', 'payment') THEN 'exact' ELSE 'estimate' END AS source
        FROM (SELECT business_id, unnest(['capacity', 'ad_budget_inr', 'growth_minutes', 'city', 'payment']) AS field,
                     unnest([CAST(capacity AS VARCHAR), CAST(ad_budget_inr AS VARCHAR), CAST(growth_minutes AS VARCHAR), city, payment]) AS value FROM profile)""", "profile"),
}
