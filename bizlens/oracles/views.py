"""The input views of `bizlens.plans.bindings`, spelled in SQL for the checking engine."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "businesses": ((), "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS business_id FROM nation"),
    "order_business": ((), """
        SELECT CAST(n_regionkey AS BIGINT) AS business_id, c_mktsegment, o_orderkey AS order_id, o_custkey AS buyer_ref,
               o_orderstatus AS status, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "biz_item": ((), """
        SELECT l_orderkey AS order_id, l_partkey AS part_id, CAST(l_quantity AS BIGINT) AS qty,
               CAST(l_extendedprice AS DECIMAL(18,4)) AS gross,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST((40 + 2 * (l_partkey % 10)) * 0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cost
        FROM lineitem"""),
    "biz_order": (("order_business", "biz_item"), """
        SELECT b.business_id, b.order_id, b.date, b.buyer_ref,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'friend' WHEN 'BUILDING' THEN 'friend_of_friend' WHEN 'FURNITURE' THEN 'stranger'
                    WHEN 'MACHINERY' THEN 'friend' WHEN 'HOUSEHOLD' THEN 'unknown' END AS relationship,
               b.priority AS channel, b.status, CAST(coalesce(t.qty, 0) AS BIGINT) AS qty, coalesce(t.gross, 0) AS gross,
               coalesce(t.discount, 0) AS discount, coalesce(t.cost, 0) AS cost, coalesce(t.gross - t.discount, 0) AS total,
               b.date + CAST(b.order_id % 7 AS INTEGER) AS dispatched_at,
               CASE WHEN b.order_id % 4 = 0 THEN 'post_' || b.business_id || '_' || CAST(CAST(date_trunc('week', b.date) AS DATE) AS VARCHAR) || '_0' END AS post_id
        FROM order_business b LEFT JOIN (SELECT order_id, sum(qty) AS qty, sum(gross) AS gross, sum(discount) AS discount, sum(cost) AS cost
                                         FROM biz_item GROUP BY 1) t ON b.order_id = t.order_id
        WHERE b.status <> 'P'"""),
    "biz_turned_away": (("order_business",), "SELECT business_id, date FROM order_business WHERE status = 'P' AND order_id % 2 = 0"),
    "biz_stockout": (("order_business",), "SELECT business_id, date FROM order_business WHERE status = 'P' AND order_id % 2 = 1"),
    "biz_post": (("order_business",), """
        SELECT business_id, 'post_' || business_id || '_' || CAST(week AS VARCHAR) || '_' || class AS post_id, week + CAST(class * 2 AS INTEGER) AS date,
               reach, profile_visits, follows, saves, 'topic ' || class AS topic
        FROM (SELECT b.business_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_partkey % 3 AS class,
                     CAST(10 * sum(l_quantity) AS BIGINT) AS reach, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS BIGINT) AS profile_visits,
                     count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS follows, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS saves
              FROM lineitem JOIN order_business b ON l_orderkey = b.order_id GROUP BY 1, 2, 3)"""),
    "profile": (("businesses",), """
        SELECT business_id, 'Shop ' || business_id AS name, business_id + 8 AS capacity, CASE WHEN business_id % 3 = 0 THEN 500 ELSE 0 END AS ad_budget_inr,
               CASE WHEN business_id % 3 = 0 THEN [] WHEN business_id = 4 THEN ['paid_ads', 'pricing'] ELSE ['paid_ads'] END AS forbidden_actions,
               60 + business_id * 40 AS growth_minutes, CASE WHEN business_id % 2 = 0 THEN 'Pune' ELSE 'Mumbai' END AS city,
               'topic' || (business_id % 4) AS topic, 'shop' || business_id || '.example/order' AS order_link, 'UPI' AS payment
        FROM businesses"""),
    "product": ((), """
        SELECT business_id, name, price, first_key,
               CASE WHEN business_id = 4 AND first_key % 7 = 0 THEN NULL ELSE price * (55 + first_key % 20) / 100 END AS unit_cost
        FROM (SELECT p_partkey % 5 AS business_id, p_name AS name, min(p_retailprice) AS price, min(p_partkey) AS first_key FROM part GROUP BY 1, 2)"""),
    "partner": ((), """
        SELECT s_suppkey % 5 AS business_id, 'partner_' || s_suppkey AS partner_id, s_name AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'fan_page' ELSE 'creator' END AS type,
               'topic' || (s_suppkey % 4) AS topic_a, 'topic' || (s_suppkey % 7) AS topic_b,
               CASE s_suppkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Mumbai' WHEN 2 THEN 'Delhi' END AS city,
               200 + (s_suppkey * 37) % 5000 AS followers, (s_suppkey * 13) % 40 AS avg_comments_per_post, (s_suppkey * 7) % 25 AS avg_shares_per_post,
               CASE WHEN s_suppkey % 6 = 0 THEN 800 ELSE 0 END AS cost_inr
        FROM supplier"""),
    "partner_result": ((), """
        SELECT 'partner_' || l_suppkey AS partner_id, year(l_shipdate) AS collab, count(*) % 9 AS stranger_leads
        FROM lineitem GROUP BY 1, 2"""),
    "snapshots": (("businesses",), """
        SELECT business_id, CAST(w AS BIGINT) AS week_no, DATE '2001-07-02' + CAST((w - 1) * 7 AS INTEGER) AS as_of, DATE '1995-01-02' AS history_start
        FROM businesses, range(1, 5) t(w)"""),
    "ev": ((), "SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day FROM events"),
    "purchase_day": (("ev",), "SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'purchase'"),
    "lead": (("ev", "purchase_day"), """
        SELECT e.user_id % 5 AS business_id, 'lead_' || e.user_id || '_' || CAST(e.day AS VARCHAR) AS lead_id, e.user_id, e.day AS created,
               '@user_' || e.user_id AS handle_ref, CASE e.user_id % 3 WHEN 0 THEN 'dm' WHEN 1 THEN 'comment' ELSE 'story' END AS source,
               CASE e.user_id % 4 WHEN 0 THEN 'friend' WHEN 1 THEN 'friend_of_friend' WHEN 2 THEN 'stranger' ELSE 'unknown' END AS relationship,
               CASE WHEN p.user_id IS NOT NULL THEN 'ordered' ELSE 'not_ordered' END AS outcome,
               e.day + CASE WHEN p.user_id IS NOT NULL THEN 2 ELSE 9 END AS outcome_date,
               CASE WHEN e.user_id % 11 = 3 THEN 'Jaipur' WHEN e.user_id % 5 = 1 THEN 'Pune' WHEN e.user_id % 5 = 2 THEN 'Delhi' END AS city,
               CASE WHEN e.user_id % 13 = 5 THEN 'XXL' WHEN e.user_id % 4 = 1 THEN 'M' WHEN e.user_id % 4 = 2 THEN 'L' END AS size,
               CASE WHEN (e.user_id + day(e.day)) % 9 = 0 THEN 'custom name' END AS design,
               CASE WHEN custom = 1 THEN 'custom_request' WHEN clicked = 1 THEN 'product_interest' ELSE 'general_praise' END AS intent
        FROM (SELECT user_id, day, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicked, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS custom
              FROM ev GROUP BY 1, 2) e LEFT JOIN purchase_day p ON p.user_id = e.user_id AND p.day - 2 = e.day"""),
    "lead_signal": (("ev", "purchase_day"), """
        SELECT DISTINCT user_id % 5 AS business_id, 'lead_' || user_id || '_' || CAST(day AS VARCHAR) AS lead_id,
               CASE event_type WHEN 'view' THEN 'follow_or_like' WHEN 'click' THEN 'comment' WHEN 'signup' THEN 'saved_or_shared'
                    WHEN 'error' THEN 'story_reply' ELSE 'price_question' END AS type, day AS date FROM ev
        UNION ALL
        SELECT DISTINCT e.user_id % 5, 'lead_' || e.user_id || '_' || CAST(e.day AS VARCHAR), 'bought_before', e.day
        FROM ev e JOIN purchase_day p ON p.user_id = e.user_id AND p.day + 1 = e.day"""),
    "lead_snapshot": (("businesses",), """
        SELECT business_id, CAST(d AS DATE) AS as_of FROM businesses,
               (VALUES ('2024-01-08'), ('2024-01-15'), ('2024-01-22'), ('2024-01-29'), ('2024-02-05')) t(d)"""),
    "d2c_daily": (("ev",), """
        SELECT CASE user_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'google' ELSE 'other' END AS channel, day AS date,
               coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS spend,
               count(CASE WHEN event_type = 'click' THEN 1 END) AS sessions, count(CASE WHEN event_type = 'signup' THEN 1 END) AS new_customers,
               coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS revenue
        FROM ev GROUP BY 1, 2"""),
    "d2c_order": (("ev",), """
        SELECT event_id AS order_id, user_id AS customer_id, ts AS ordered_at, day, CAST(value AS DECIMAL(18,4)) AS revenue,
               CAST(CAST(value AS DECIMAL(18,2)) * CAST((30 + event_id % 20) * 0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cogs,
               event_id = min(event_id) OVER (PARTITION BY user_id) AS is_first_order
        FROM ev WHERE event_type = 'purchase'"""),
    "d2c_lead": (("ev",), """
        SELECT event_id AS lead_id, user_id, CASE user_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'google' ELSE 'website_form' END AS channel, ts AS created_at,
               response AS first_response_at, win AS won_at, CAST(CAST(value AS DECIMAL(18,4)) * 100 AS DECIMAL(18,4)) AS expected_value_inr,
               CAST(value AS DECIMAL(18,4)) * 100 >= 15000 AS high_value,
               CASE WHEN win IS NOT NULL THEN 'won' WHEN response IS NOT NULL THEN 'qualified' WHEN event_id % 10 = 0 THEN 'lost' ELSE 'new' END AS stage
        FROM (SELECT *, min(CASE WHEN event_type = 'click' THEN ts END) OVER w AS response, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS win
              FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        WHERE event_type IN ('error', 'signup')"""),
}


def register(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a derived view another oracle builds on."""
    VIEWS[name] = (needs, sql)


def with_views(body: str, *names: str) -> str:
    """Prefix `body` with the named views and everything they build on, as common table expressions that run once each."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for dep in VIEWS[name][0]:
                visit(dep)
            done.append(name)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in done)
    return f"WITH {ctes}\n{body}" if ctes else body
