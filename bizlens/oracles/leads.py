"""Section G in SQL."""

from __future__ import annotations

from bizlens.functions import text as tx
from bizlens.operators.leads import POINTS
from bizlens.oracles import order_metrics as _segments  # noqa: F401  registers by_segment
from bizlens.oracles.model import BANK_P
from bizlens.oracles.sqltext import div, rnd
from bizlens.oracles.views import register, with_views
from bizlens.plans.queries.leads import LEARN_DAY


def pseudo(c: str, prefix: str = "user") -> str:
    return f"'{prefix}_' || sha1('bizlens' || lower(trim({c})))"


def short(c: str, prefix: str = "user") -> str:
    return f"substr({pseudo(c, prefix)}, 1, {len(prefix) + 7})"


register("chat", (), """
    SELECT conv_id % 5 AS business_id, conv_id * 1000 + turn AS msg_no, DATE '2026-09-01' + CAST(conv_id % 20 AS INTEGER) AS default_day,
           CASE (conv_id * 7 + turn) % 12 WHEN 0 THEN '@riya.k (dm): price of the ' || p_name || ' in size L? deliver to Pune' WHEN 1 THEN '@fan_' || (conv_id % 40) || ' (comment): this one 🔥 obsessed'
           WHEN 2 THEN '[04/10/26, 9:41 am] Riya Shah: is the ' || p_name || ' in stock?' WHEN 3 THEN '04/10/2026, 21:05 - Aman: love your page' WHEN 4 THEN '@shop_x (dm): collab? we promote small brands'
           WHEN 5 THEN '@neel' || (conv_id % 40) || ' (story): can you make one with my name, XL' WHEN 6 THEN 'just some text without a format'
           WHEN 7 THEN '@mira_' || (conv_id % 40) || ' (whatsapp): my number is +91 98765 43210 call me' WHEN 8 THEN '@zed_' || (conv_id % 40) || ' (dm): mail me at zed@mail.com about custom ' || p_name
           WHEN 9 THEN '[31/31/26, 9:41 am] Odd Date: do you ship to Jaipur?' WHEN 10 THEN '@a_' || (conv_id % 40) || ' (story): love this ' || p_name || ' need it'
           ELSE '  @Riya.K (DM): ask @someone.else about cod  ' END AS line
    FROM conversations JOIN part ON p_partkey = conv_id % (SELECT count(*) FROM part)""")
_APP, _EXP = tx.APP_LINE, tx.EXPORT_LINE
_MAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
_PHONE = r"(^|[^0-9])(?:\+?91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}($|[^0-9])"
_HANDLE = r"(^|[^\w.])@([A-Za-z0-9_.]{2,30})"
register("message", ("chat",), f"""
    SELECT business_id, msg_no, handle_ref, channel, date, CASE WHEN regexp_matches(t, '{_HANDLE}') THEN regexp_replace(t, '{_HANDLE}', '\\1@' || {short(f"regexp_extract(t, '{_HANDLE}', 2)")}) ELSE t END AS text FROM (
    SELECT *, regexp_replace(regexp_replace(raw, '{_MAIL}', '[email]', 'g'), '{_PHONE}', '\\1[phone]\\2', 'g') AS t FROM (
    SELECT business_id, msg_no, '@' || {pseudo(f"regexp_extract(line, '{_APP}', 1)")} AS handle_ref, lower(regexp_extract(line, '{_APP}', 2)) AS channel, default_day AS date,
           trim(regexp_extract(line, '{_APP}', 3)) AS raw FROM chat WHERE regexp_matches(line, '{_APP}')
    UNION ALL
    SELECT business_id, msg_no, '@' || {pseudo(f"regexp_extract(line, '{_EXP}', 2)")}, 'whatsapp',
           coalesce(CAST(coalesce(try_strptime(regexp_extract(line, '{_EXP}', 1), '%d/%m/%y'), try_strptime(regexp_extract(line, '{_EXP}', 1), '%d/%m/%Y'),
                                  try_strptime(regexp_extract(line, '{_EXP}', 1), '%d-%m-%y'), try_strptime(regexp_extract(line, '{_EXP}', 1), '%d-%m-%Y')) AS DATE), default_day),
           trim(regexp_extract(line, '{_EXP}', 3)) FROM chat WHERE NOT regexp_matches(line, '{_APP}') AND regexp_matches(line, '{_EXP}')))""")
_m = lambda p: f"regexp_matches(text, '{p}')"
_CITIES = sorted(tx.CITIES, key=len, reverse=True)
register("read0", ("message", "product"), f"""
    SELECT *, CASE WHEN {_m(tx.NOT_A_LEAD)} THEN ['not_a_lead']
                   WHEN {_m(tx.BUYING)} OR {_m(tx.CUSTOM)} OR {_m(tx.INTEREST)} THEN list_filter([CASE WHEN {_m(tx.BUYING)} THEN 'buying_question' END,
                        CASE WHEN {_m(tx.CUSTOM)} THEN 'custom_request' END, CASE WHEN {_m(tx.INTEREST)} THEN 'product_interest' END], lambda x: x IS NOT NULL)
                   ELSE ['general_praise'] END AS intents,
           upper(coalesce(nullif(regexp_extract(text, '{tx.SIZE}', 1), ''), nullif(regexp_extract(text, '{tx.SIZE}', 2), ''), nullif(regexp_extract(text, '{tx.SIZE}', 3), ''))) AS size,
           CASE {' '.join(f"WHEN regexp_matches(text, '(?i){chr(92)}b{c}{chr(92)}b') THEN '{c}'" for c in _CITIES)} END AS city,
           CASE WHEN contains(lower(text), 'my name') AND regexp_matches(lower(text), '(?:design|with)\\s+([a-z0-9 ]{{3,30}}?)(?:\\?|\\.|,|$)') THEN 'custom name' END AS design
    FROM message""")
register("hit", ("message", "product"), """
    SELECT msg_no, name, first_key, count(*) AS hits FROM message m JOIN (SELECT business_id, name, first_key, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS w FROM product) p
        ON p.business_id = m.business_id AND length(w) > 2 AND w NOT IN ('tee', 'box', 'the', 'for') AND contains(lower(text), w) GROUP BY 1, 2, 3""")
register("read", ("read0", "hit"), """
    SELECT r.*, h.name AS product,
           CASE WHEN list_contains(intents, 'not_a_lead') THEN [] WHEN list_contains(intents, 'buying_question') OR list_contains(intents, 'custom_request') OR list_contains(intents, 'product_interest')
                THEN list_filter([CASE WHEN list_contains(intents, 'buying_question') THEN 'price_question' END, CASE WHEN list_contains(intents, 'custom_request') THEN 'comment' END,
                                  CASE WHEN list_contains(intents, 'product_interest') THEN CASE WHEN channel = 'story' THEN 'story_reply' ELSE 'comment' END END], lambda x: x IS NOT NULL)
                WHEN list_contains(intents, 'general_praise') THEN ['follow_or_like'] ELSE [] END AS signals
    FROM read0 r LEFT JOIN (SELECT msg_no, arg_max(name, hits * 1000000000 - first_key) AS name FROM hit GROUP BY 1) h USING (msg_no)""")
register("held", ("message",), """
    SELECT business_id, handle_ref, 'dm' AS source, DATE '2026-08-01' AS created, CASE WHEN min(msg_no) % 2 = 0 THEN 'S' END AS size, 'Surat' AS city FROM message WHERE msg_no % 3 = 0 GROUP BY 1, 2""")
register("lead_full", ("lead",), "SELECT *, CASE WHEN user_id % 17 = 4 THEN 'mug' END AS product_text FROM lead")
register("lead_fit", ("lead_full",), """
    SELECT *, CASE WHEN city IS NOT NULL AND city NOT IN ('Pune', 'Mumbai', 'Delhi') THEN 'city: cannot deliver to ' || city
                   WHEN size IS NOT NULL AND size NOT IN ('S', 'M', 'L', 'XL') THEN 'size: ' || size || ' is not available' WHEN design IS NOT NULL AND intent = 'custom_request' THEN NULL
                   WHEN product_text IS NOT NULL AND intent <> 'custom_request' THEN 'design: ' || product_text || ' is not something the owner makes' END AS reason FROM lead_full""")


def score_view(name: str, base: str, needs: tuple) -> None:
    """Scores the (lead, as_of) rows of `base`."""
    has = lambda t: f"coalesce(bool_or(s.type = '{t}'), false) AS has_{t}"
    pts = " + ".join(f"CASE WHEN has_{t} THEN {p} ELSE 0 END" for t, p in POINTS.items())
    reasons = ", ".join(f"CASE WHEN has_{t} THEN '{t} +{p}' END" for t, p in POINTS.items())
    register(name, (*needs, "lead_signal", "lead_fit"), f"""
        SELECT *, CASE WHEN reason IS NOT NULL THEN 'disqualified' WHEN score >= 50 THEN 'hot' WHEN score >= 20 THEN 'warm' ELSE 'cold' END AS grp
        FROM (SELECT f.*, v.as_of, last_signal, {', '.join('has_' + t for t in POINTS)},
                     {pts} + CASE WHEN relationship = 'stranger' THEN 10 ELSE 0 END + CASE WHEN last_signal <= v.as_of - 30 THEN -20 ELSE 0 END AS score,
                     concat_ws('; ', {reasons}, CASE WHEN relationship = 'stranger' THEN 'stranger +10' END, CASE WHEN last_signal <= v.as_of - 30 THEN 'decay -20' END) AS reasons
              FROM (SELECT b.lead_id, b.as_of, max(s.date) AS last_signal, {', '.join(has(t) for t in POINTS)}
                    FROM ({base}) b LEFT JOIN lead_signal s ON s.lead_id = b.lead_id AND s.date < b.as_of GROUP BY 1, 2) v JOIN lead_fit f USING (lead_id))""")


score_view("listed", """SELECT l.lead_id, n.as_of FROM lead l JOIN lead_snapshot n USING (business_id) WHERE NOT (l.outcome_date < n.as_of)
           AND EXISTS (SELECT 1 FROM lead_signal s WHERE s.lead_id = l.lead_id AND s.date < n.as_of)""", ("lead", "lead_snapshot"))
score_view("learned0", f"SELECT lead_id, least(DATE '{LEARN_DAY}', outcome_date) AS as_of FROM lead WHERE outcome_date < DATE '{LEARN_DAY}'", ("lead",))
register("learned", ("learned0",), "SELECT *, CASE WHEN outcome = 'ordered' THEN 1 ELSE 0 END AS won FROM learned0 WHERE grp <> 'disqualified'")
register("by_group", ("learned",), f"SELECT business_id, grp, count(*) AS leads, CAST(sum(won) AS BIGINT) AS ordered, {rnd(div('sum(won)', 'count(*)'), 4)} AS conversion FROM learned GROUP BY 1, 2")
_SIG = " UNION ALL ".join(f"SELECT business_id, won, '{t}' AS signal, {f} AS has_it, {p} AS points_now FROM learned"
                          for t, f, p in [*[(t, f"has_{t}", p) for t, p in POINTS.items()], ("stranger", "relationship = 'stranger'", 10)])
register("bank_p", ("learned",), f"""
    SELECT business_id, score, {BANK_P} AS p FROM (SELECT *, CASE WHEN has_bought_before THEN 'success' ELSE 'nonexistent' END AS previous_outcome, CASE WHEN has_bought_before THEN 1 ELSE 0 END AS prior_contacts,
           CASE WHEN has_bought_before THEN greatest(0, as_of - last_signal) ELSE 999 END AS days_since_last_contact, 1 AS contacts_this_campaign FROM learned)""")

ORACLES = {
    "g02_pseudonym": f"SELECT c_custkey, {pseudo('c_name')} AS person_key, {short('c_name')} AS alias FROM customer",
    "g03_chat_lines": with_views("SELECT business_id, msg_no, handle_ref, channel, CAST(date AS VARCHAR) AS date, text FROM message", "message"),
    "g04_intents": with_views("SELECT msg_no, array_to_string(intents, ',') AS intents FROM read0", "read0"),
    "g05_details": with_views("SELECT msg_no, size, city, product, design FROM read", "read"),
    "g06_signals": with_views("SELECT msg_no, i - 1 AS pos, signals[i] AS signal FROM (SELECT *, unnest(range(1, len(signals) + 1)) AS i FROM read)", "read"),
    "g07_people": with_views("""
        WITH f AS (SELECT *, NOT list_contains(intents, 'not_a_lead') AS ok FROM read),
        n AS (SELECT business_id, handle_ref, arg_min(channel, msg_no) AS source, arg_min(date, msg_no) AS created, count(*) AS messages, arg_min(product, msg_no) FILTER (ok AND product IS NOT NULL) AS product,
                     arg_min(size, msg_no) FILTER (ok AND size IS NOT NULL) AS size, arg_min(design, msg_no) FILTER (ok AND design IS NOT NULL) AS design,
                     arg_min(city, msg_no) FILTER (ok AND city IS NOT NULL) AS city FROM f GROUP BY 1, 2),
        i AS (SELECT business_id, handle_ref, string_agg(intent, ',' ORDER BY k) AS others, bool_or(intent = 'general_praise') AS praise,
                     string_agg(CASE WHEN intent <> 'general_praise' THEN intent END, ',' ORDER BY k) AS rest
              FROM (SELECT business_id, handle_ref, intent, min(msg_no * 10 + pos) AS k FROM (SELECT *, unnest(intents) AS intent, unnest(range(0, len(intents))) AS pos FROM f) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        s AS (SELECT business_id, handle_ref, string_agg(type || '@' || CAST(d AS VARCHAR), ',' ORDER BY type || '@' || CAST(d AS VARCHAR)) AS signals
              FROM (SELECT business_id, handle_ref, type, arg_min(date, msg_no) AS d FROM (SELECT *, unnest(signals) AS type FROM f) GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT n.business_id, n.handle_ref, coalesce(h.source, n.source) AS source, CAST(coalesce(h.created, n.created) AS VARCHAR) AS created, messages AS new_messages, n.product,
               coalesce(h.size, n.size) AS size, n.design, coalesce(h.city, n.city) AS city,
               CASE WHEN h.source IS NULL THEN others ELSE concat_ws(',', 'general_praise', rest) END AS intents, CASE WHEN h.source IS NULL THEN 'created' ELSE 'updated' END AS change, s.signals
        FROM n JOIN i USING (business_id, handle_ref) LEFT JOIN held h USING (business_id, handle_ref) LEFT JOIN s USING (business_id, handle_ref)""".replace("WITH f AS", "SELECT * FROM (WITH f AS", 1) + ")", "read", "held"),
    "g08_fit": with_views("""
        SELECT lead_id, reason AS disqualified_reason, CASE WHEN reason IS NOT NULL THEN 'false' WHEN design IS NOT NULL AND intent = 'custom_request' THEN NULL ELSE 'true' END AS deliverable FROM lead_fit""", "lead_fit"),
    "g09_g10_score": with_views("SELECT business_id, lead_id, CAST(as_of AS VARCHAR) AS as_of, CAST(score AS BIGINT) AS score, grp AS \"group\", reasons FROM listed", "listed"),
    "g11_ranked_list": with_views("""
        SELECT business_id, lead_id, CAST(as_of AS VARCHAR) AS as_of, grp AS "group", score, CASE WHEN grp <> 'disqualified' THEN row_number() OVER (PARTITION BY business_id, as_of
               ORDER BY CASE grp WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 WHEN 'cold' THEN 2 ELSE 3 END, -score, CASE WHEN relationship = 'stranger' THEN 0 ELSE 1 END, last_signal DESC, lead_id) END AS rank
        FROM listed""", "listed"),
    "g12_last_activity": with_views("""
        SELECT s.business_id, s.lead_id, CAST(as_of AS VARCHAR) AS as_of, 'message ' || any_value(e) AS last_message, CAST(max(s.date) AS VARCHAR) AS last_activity
        FROM lead_signal s JOIN lead_snapshot USING (business_id) JOIN (SELECT 'lead_' || user_id || '_' || CAST(day AS VARCHAR) AS lead_id, max(event_id) AS e FROM ev GROUP BY 1) m USING (lead_id)
        WHERE s.date < as_of GROUP BY 1, 2, 3""", "lead_signal", "lead_snapshot"),
    "g13_group_counts": with_views("""
        SELECT business_id, CAST(as_of AS VARCHAR) AS as_of, grp AS "group", reason AS disqualified_reason, count(*) AS leads FROM listed GROUP BY 1, 2, 3, 4""", "listed"),
    "g15_conversion_by_group": with_views("SELECT business_id, grp AS \"group\", leads, ordered, conversion FROM by_group", "by_group"),
    "g16_conversion_by_signal": with_views(f"""
        SELECT business_id, signal, leads_with_signal, conversion_with, conversion_without, points_now, CASE WHEN leads_with_signal >= 30 AND w > 0 THEN {rnd('lift', 2)} END AS lift_vs_overall,
               CASE WHEN leads_with_signal < 30 OR w = 0 THEN 'not enough outcomes yet' WHEN lift > 1.3 THEN 'raise' WHEN lift < 0.7 THEN 'lower' ELSE 'keep' END AS suggestion
        FROM (SELECT business_id, signal, count(CASE WHEN has_it THEN 1 END) AS leads_with_signal, {rnd('avg(CASE WHEN has_it THEN won END)', 4)} AS conversion_with,
                     {rnd('avg(CASE WHEN NOT has_it THEN won END)', 4)} AS conversion_without, CAST(max(points_now) AS BIGINT) AS points_now, sum(won) AS w, avg(CASE WHEN has_it THEN won END) / nullif(avg(won), 0) AS lift
              FROM ({_SIG}) GROUP BY 1, 2)""", "learned"),
    "g17_health_checks": with_views("""
        SELECT business_id, h > w AND w > c AS hot_over_warm_over_cold, abs(h - w) > 0.05 AS hot_differs_from_warm
        FROM (SELECT business_id, max(CASE WHEN grp = 'hot' THEN conversion END) AS h, max(CASE WHEN grp = 'warm' THEN conversion END) AS w, max(CASE WHEN grp = 'cold' THEN conversion END) AS c FROM by_group GROUP BY 1)
        WHERE h IS NOT NULL AND w IS NOT NULL AND c IS NOT NULL""", "by_group"),
    "g18_spearman": with_views(f"""
        SELECT business_id, count(*) AS leads, CASE WHEN count(*) >= 3 THEN {rnd('corr(ra, rb)', 3)} END AS spearman
        FROM (SELECT business_id, rank() OVER (PARTITION BY business_id ORDER BY score) + (count(*) OVER (PARTITION BY business_id, score) - 1) / CAST(2 AS DOUBLE) AS ra,
                     rank() OVER (PARTITION BY business_id ORDER BY p) + (count(*) OVER (PARTITION BY business_id, p) - 1) / CAST(2 AS DOUBLE) AS rb FROM bank_p) GROUP BY 1""", "bank_p"),
    "g19_contact_attributes": with_views("""
        SELECT lead_id, CAST(score AS BIGINT) AS score, CASE WHEN has_bought_before THEN 'success' ELSE 'nonexistent' END AS previous_outcome, CAST(CASE WHEN has_bought_before THEN 1 ELSE 0 END AS BIGINT) AS prior_contacts,
               CASE WHEN has_bought_before THEN greatest(0, as_of - last_signal) ELSE 999 END AS days_since_last_contact FROM learned""", "learned"),
    "g20_direction_checks": with_views("""
        SELECT 'intent outweighs light interest' AS direction, max(CASE WHEN value = 'page_value > 0' THEN conversion END) > 5 * max(CASE WHEN value = 'page_value = 0' THEN conversion END) AS supported FROM by_segment
        UNION ALL SELECT 'new people behave differently', max(CASE WHEN value = 'New_Visitor' THEN conversion END) <> max(CASE WHEN value = 'Returning_Visitor' THEN conversion END) FROM by_segment""", "by_segment"),
}
register("correction", ("ev",), """
    SELECT *, (field = 'relationship' AND value IN ('friend', 'friend_of_friend', 'stranger', 'unknown')) OR (field = 'outcome' AND value IN ('open', 'ordered', 'not_ordered'))
              OR (field = 'intents' AND list_has_all(['buying_question', 'product_interest', 'general_praise', 'custom_request', 'not_a_lead'], string_split(value, ','))) AS ok
    FROM (SELECT 'lead_' || user_id || '_' || CAST(day AS VARCHAR) AS lead_id, event_id AS "at", CASE event_id % 3 WHEN 0 THEN 'relationship' WHEN 1 THEN 'outcome' ELSE 'intents' END AS field,
                 CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'stranger' ELSE 'enemy' END WHEN 1 THEN CASE WHEN event_id % 4 < 2 THEN 'ordered' ELSE 'open' END
                      ELSE CASE event_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'custom_request,buying_question' WHEN 2 THEN 'buying_question,maybe' ELSE 'buying_question' END END AS value,
                 CASE WHEN event_id % 3 = 1 AND event_id % 5 < 2 THEN CAST(day AS DATE) + 3 END AS outcome_date FROM ev WHERE event_type IN ('error', 'signup'))""")
register("corrected", ("lead", "correction"), """
    SELECT business_id, lead_id, coalesce(r, relationship) AS relationship, coalesce(o.v, outcome) AS outcome, coalesce(i[1], intent) AS intent,
           CASE WHEN o IS NULL THEN CAST(outcome_date AS DATE) WHEN o.v <> 'open' THEN coalesce(o.d, DATE '{day}' - 1) END AS outcome_date,
           array_to_string(coalesce(i, [intent]), ',') AS intents, i IS NOT NULL AS intents_corrected
    FROM lead LEFT JOIN (SELECT lead_id, max_by(value, "at") FILTER (field = 'relationship') AS r, max_by({{'v': value, 'd': outcome_date}}, "at") FILTER (field = 'outcome') AS o,
                                string_split(max_by(value, "at") FILTER (field = 'intents'), ',') AS i FROM correction WHERE ok GROUP BY 1) USING (lead_id)""".format(day=LEARN_DAY))
ORACLES["g14_corrections"] = with_views("""
    SELECT lead_id, relationship, outcome, intent, CAST(outcome_date AS VARCHAR) AS outcome_date, intents, intents_corrected, 'lead' AS kind FROM corrected
    UNION ALL SELECT lead_id, field, value, CAST("at" AS VARCHAR), NULL, NULL, NULL, 'refused' FROM correction WHERE NOT ok""", "corrected", "correction")
ORACLES["g14_closed_by_day"] = with_views(f"""
    SELECT business_id, CAST(outcome_date AS VARCHAR) AS day, count(*) AS closed, count(*) FILTER (outcome = 'ordered') AS ordered FROM corrected
    WHERE outcome IN ('ordered', 'not_ordered') AND outcome_date < DATE '{LEARN_DAY}' GROUP BY 1, 2""", "corrected")
