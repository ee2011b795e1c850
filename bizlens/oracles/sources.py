"""Section A in SQL."""

from __future__ import annotations

from bizlens.oracles import calendar as _cal  # noqa: F401
from bizlens.oracles import model as _model  # noqa: F401
from bizlens.oracles.views import with_views

ORACLES = {
    "a01_delimited_scan": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority || ', "noted"' AS note, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS status,
               CAST(1 AS BIGINT) AS rows_dense FROM orders""",
    "a02_labelled_file": with_views("SELECT previous_outcome AS poutcome, CASE WHEN y = 1 THEN 'yes' ELSE 'no' END AS y, count(*) AS rows, CAST(sum(days_since_last_contact) AS BIGINT) AS pdays FROM contact GROUP BY 1, 2", "contact"),
    "a03_json_documents": with_views("SELECT name, CAST(window_start AS VARCHAR) AS window_start, CAST(window_end AS VARCHAR) AS window_end FROM event_window", "event_window"),
    "a04_batch_identity": "SELECT doc_id, 'imp_orders_' || sha1(text) AS import_id, 'imp_orders_' || substr(sha1(text), 1, 8) AS label FROM documents",
    "a05_partitioned_sink": with_views("""
        SELECT business_id, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week, count(*) * CASE WHEN business_id = 3 THEN 10 ELSE 1 END AS orders FROM biz_order GROUP BY 1, 2""", "biz_order"),
    "a06_attach_new": with_views("SELECT business_id, order_id, CASE WHEN status <> 'F' THEN 'held' ELSE 'new' END AS src FROM order_business", "order_business"),
    "a06_attach_costs": with_views("SELECT business_id, name, CASE WHEN first_key % 2 = 0 THEN price * 2 ELSE price END AS \"full\" FROM product", "product"),
}
