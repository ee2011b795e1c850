"""Sections K and L in SQL (and J6)."""

from __future__ import annotations

from bizlens.operators.actions import PROTECTED_TERMS, library_rows
from bizlens.operators.diagnosis import BOTTLENECKS, CLAIMS, DECISIVE, LIMIT_STEPS
from bizlens.operators.facts import FACT_IDS
from bizlens.oracles import projection as _proj  # noqa: F401  registers projection views
from bizlens.oracles.sqltext import rnd
from bizlens.oracles.views import register, with_views


def plain(c: str, digits: int) -> str:
    t = f"printf('%.{digits}f', {c})"
    return f"regexp_replace(regexp_replace({t}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')" if digits else t


def display(c: str, unit: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'n/a' WHEN {unit} = 'ratio' THEN {plain(f'{c} * 100', 1)} || '%' WHEN {unit} = 'INR' THEN 'INR ' || format('{{:,}}', CAST({rnd(c, 0)} AS BIGINT)) "
            f"WHEN {unit} = 'days' THEN {plain(c, 1)} || ' days' WHEN {unit} = 'orders/week' THEN {plain(c, 2)} || ' a week' ELSE {plain(c, 2)} END")


def values(rows, names) -> str:
    def lit(v):
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v))

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") t({names})"


register("decisive", (), values([(f, b, i) for b, fs in DECISIVE.items() for i, f in enumerate(fs)], "fact_id, b, place"))
register("fact_place", (), values([(f, i) for i, f in enumerate(FACT_IDS)], "fact_id, fplace"))
register("claim", (), values(list(CLAIMS.items()), "kpi, template"))
register("rated", ("fact",), f"""
    SELECT *, coalesce(amount >= threshold, false) AS material FROM (
    SELECT *, CASE WHEN m THEN {rnd("least(1.0, greatest(0.0, coalesce(gap_to_best, CASE WHEN baseline <> 0 THEN CASE WHEN better = 'higher' THEN (baseline - value) / baseline ELSE (value - baseline) / baseline END END)))", 4)} END AS gap,
           CASE WHEN m THEN CASE unit WHEN 'orders/week' THEN diff * 4 WHEN 'ratio' THEN diff * coalesce(denominator, 0) WHEN 'INR' THEN diff * coalesce(sample_size, 0) ELSE diff END END AS amount,
           CASE WHEN unit = 'orders/week' THEN 'orders' WHEN kpi IN ('margin_pct', 'discount_share') OR unit = 'INR' THEN 'INR' WHEN unit = 'days' THEN 'days' ELSE sample_kind END AS what,
           CASE WHEN kpi IN ('margin_pct', 'discount_share') OR unit = 'INR' THEN 500 WHEN unit = 'days' THEN 0.5 ELSE 2 END AS threshold
    FROM (SELECT *, better IN ('higher', 'lower') AND value IS NOT NULL AND baseline IS NOT NULL AS m, greatest(0.0, CASE WHEN better = 'higher' THEN baseline - value ELSE value - baseline END) AS diff FROM fact))""")
register("decided", ("rated", "decisive"), """
    SELECT r.*, row_number() OVER (PARTITION BY business_id, week_no, bottleneck ORDER BY material DESC, gap DESC, place) AS pos FROM rated r JOIN decisive d ON d.fact_id = r.fact_id AND r.gap IS NOT NULL""")
register("in_window", ("fact",), "SELECT business_id, week_no, coalesce(max(CASE WHEN sample_kind = 'orders' THEN sample_size END), 0) AS orders_in_window FROM fact GROUP BY 1, 2")
_U = "CASE WHEN kpi IN ('orders_turned_away', 'stockouts') OR unit = 'count' THEN 'count' ELSE unit END"
register("card", ("decided", "in_window", "claim"), f"""
    SELECT *, replace(replace(template, '{{v}}', shown), '{{b}}', shown_best) AS claim FROM (
    SELECT *, {display('value', _U)} AS shown, {display('baseline', _U)} AS shown_best,
           CASE WHEN orders_in_window < 40 OR quality_flag IN ('partial', 'low') THEN 'estimate' ELSE coalesce(source, 'derived') END AS confidence
    FROM decided JOIN in_window USING (business_id, week_no) JOIN claim USING (kpi))""")
# ---- actions
register("lib", (), values(library_rows(), "place, action_key, bottleneck, kind, effort_min, impact, cost_inr, timing_sensitive, raises_visibility, needs, target_fact, rule, amount, base_fit"))
register("ranked_partner", ("partner", "profile", "partner_result"), f"""
    SELECT *, CASE WHEN NOT blocked THEN row_number() OVER (PARTITION BY business_id, blocked ORDER BY score DESC, partner_id) END AS rank FROM (
    SELECT *, {rnd('100 * (0.35::DOUBLE * audience + 0.20::DOUBLE * location + 0.25::DOUBLE * engagement + 0.20::DOUBLE * past)', 1)} AS score FROM (
    SELECT p.business_id, p.partner_id, p.type, CASE WHEN f.topic IN (topic_a, topic_b) THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS audience,
           CASE WHEN p.city = f.city THEN 1.0::DOUBLE WHEN p.city IS NULL THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS location,
           {rnd('least(1.0, (avg_comments_per_post + avg_shares_per_post) / CAST(greatest(1, followers) AS DOUBLE) / 0.02::DOUBLE)', 3)} AS engagement,
           CASE WHEN a IS NOT NULL THEN {rnd('least(1.0, a / 5)', 3)} ELSE 0.5 END AS past, cost_inr > ad_budget_inr AS blocked
    FROM partner p JOIN profile f USING (business_id) LEFT JOIN (SELECT partner_id, avg(stranger_leads) AS a FROM partner_result GROUP BY 1) h USING (partner_id)))""")
register("asked", ("lead", "product"), """
    SELECT l.business_id, lead_id, names[1 + (user_id * user_id) % len(names)] AS product FROM lead l JOIN (SELECT business_id, list(name ORDER BY name) AS names FROM product GROUP BY 1) USING (business_id)""")
register("ask_count", ("asked",), "SELECT business_id, product, count(*) AS asks FROM asked GROUP BY 1, 2")
register("sit", ("snapshots", "profile", "ranked_partner", "product", "ask_count", "event_window", "fact"), """
    SELECT s.*, p.growth_minutes, p.ad_budget_inr, p.forbidden_actions, t.partner_id AS top_partner, t.score AS top_score, c.partner_id AS community, c.score AS community_score, low_margin, missing_costs, most_asked,
           (SELECT min(window_start) FROM event_window WHERE window_start > s.as_of AND window_start <= s.as_of + 21) - s.as_of AS window_days,
           (SELECT denominator FROM fact f WHERE f.business_id = s.business_id AND f.week_no = s.week_no AND f.fact_id = 'f_repeat_customer_share') AS past_buyers
    FROM snapshots s JOIN profile p USING (business_id) LEFT JOIN (SELECT * FROM ranked_partner WHERE rank = 1) t USING (business_id)
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY rank) AS k FROM ranked_partner WHERE type = 'community' AND rank > 1) WHERE k = 1) c USING (business_id)
    LEFT JOIN (SELECT business_id, arg_min(name, ROW(CASE WHEN price > 0 THEN (price - coalesce(unit_cost, 0)) / price ELSE 1 END, first_key, name)) AS low_margin, count(CASE WHEN unit_cost IS NULL THEN 1 END) AS missing_costs FROM product GROUP BY 1) l USING (business_id)
    LEFT JOIN (SELECT business_id, arg_min(product, ROW(-asks, product)) AS most_asked FROM ask_count GROUP BY 1) m USING (business_id)""")
register("cand0", ("sit", "lib"), f"""
    SELECT *, CASE WHEN kind = 'paid_ads' OR list_contains(forbidden_actions, kind) OR cost_inr > ad_budget_inr THEN 'Needs INR ' || format('{{:,}}', cost_inr) || ' for ads; your ad budget is INR ' || format('{{:,}}', ad_budget_inr) || ', so paid ads are not an option.'
                   WHEN effort_min > growth_minutes THEN 'Needs ' || effort_min || ' minutes; you have ' || growth_minutes || ' minutes a week for growth.'
                   WHEN needs = 'reach_candidates' AND top_partner IS NULL THEN 'No reach partners are listed (add a few fan pages, creators or communities).'
                   WHEN needs = 'demand_window' AND window_days IS NULL THEN 'No demand window in the next 3 weeks.' WHEN needs = 'past_buyers' AND coalesce(past_buyers, 0) < 5 THEN 'Fewer than 5 past buyers.'
                   WHEN needs = 'unit_cost' AND missing_costs > 0 THEN 'Unit costs are missing for some products.' END AS blocked_reason,
           {rnd('''CASE WHEN action_key = 'reach_partner_collab' AND top_partner IS NOT NULL THEN top_score / 100 WHEN action_key = 'reach_community_share' AND community IS NOT NULL THEN greatest(base_fit, community_score / 100)
                        WHEN action_key = 'reach_demand_window_drop' AND window_days IS NOT NULL THEN CASE WHEN window_days <= 7 THEN 1.0 ELSE 0.7 END ELSE base_fit END''', 3)} AS fit,
           CASE WHEN NOT timing_sensitive THEN 0.5::DOUBLE WHEN window_days IS NULL THEN 0.0::DOUBLE WHEN window_days <= 7 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS timing,
           CASE action_key WHEN 'reach_partner_collab' THEN top_partner WHEN 'reach_community_share' THEN community END AS partner_id,
           CASE WHEN bottleneck = 'capacity' THEN coalesce(most_asked, low_margin) ELSE low_margin END AS product_name FROM sit, lib""")
_SC = "100 * (0.5::DOUBLE * impact + 0.3::DOUBLE * fit + 0.2::DOUBLE * timing) * (1 - 0.5::DOUBLE * least(1.0::DOUBLE, effort_min / CAST(greatest(1, growth_minutes) AS DOUBLE)))"
register("cand", ("cand0", "fact"), f"""
    SELECT c.*, blocked_reason IS NULL AS eligible, {rnd(_SC, 1)} AS score, f.value AS current, f.direction,
           CASE WHEN f.value IS NULL THEN NULL WHEN rule = 'add' THEN f.value + amount WHEN rule = 'relative' THEN {rnd('f.value * (1 + CAST(amount AS DOUBLE))', 3)} WHEN rule = 'to_best' THEN {rnd('f.baseline', 2)} ELSE 0 END AS target_value
    FROM cand0 c LEFT JOIN fact f ON f.business_id = c.business_id AND f.week_no = c.week_no AND f.fact_id = c.target_fact""")
register("actionable", ("cand",), """
    SELECT business_id, week_no, bottleneck, bool_or(eligible) AS has_action, min(CASE WHEN eligible THEN effort_min END) AS min_effort,
           CASE WHEN NOT bool_or(eligible) THEN 'every action for it is blocked: ' || string_agg(DISTINCT blocked_reason, ' ' ORDER BY blocked_reason) END AS why_not FROM cand GROUP BY 1, 2, 3""")


def picks(name: str, source: str, needs: tuple, group: str) -> None:
    """Greedy choice written as a recursive walk down each group's ranked eligible actions."""
    register(name, needs, f"""
        SELECT * FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, effort_min, place) AS k FROM {source} WHERE eligible),
        walk AS (SELECT {group}, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS action_key, false AS taken FROM (SELECT DISTINCT {group} FROM o)
                 UNION ALL SELECT {', '.join('w.' + g.strip() for g in group.split(','))}, o.k, w.used + CASE WHEN w.used + o.effort_min <= o.growth_minutes AND w.n < 3 THEN o.effort_min ELSE 0 END,
                        w.n + CASE WHEN w.used + o.effort_min <= o.growth_minutes AND w.n < 3 THEN 1 ELSE 0 END, o.action_key, w.used + o.effort_min <= o.growth_minutes AND w.n < 3
                 FROM walk w JOIN o ON {' AND '.join(f'o.{g.strip()} = w.{g.strip()}' for g in group.split(','))} AND o.k = w.k + 1)
        SELECT {group}, action_key FROM walk WHERE taken)""")


picks("picked", "cand", ("cand",), "business_id, week_no, bottleneck")
# ---- findings
register("located", ("decided", "rated", "fact_place"), f"""
    SELECT d.*, CASE d.bottleneck WHEN 'reach' THEN CASE WHEN has_stranger THEN 'the gap is in orders from strangers: ' || printf('%.0f', coalesce(circle, 0)) || ' of ' || d.sample_size || ' orders in the last 4 weeks came from friends and friends of friends' END
        WHEN 'conversion' THEN 'the biggest drop is in ' || replace(worst, '_', ' ')
        WHEN 'margin' THEN coalesce('it comes from ' || (SELECT string_agg(replace(r.kpi, '_', ' '), ' and ' ORDER BY fplace) FROM rated r JOIN fact_place USING (fact_id)
             WHERE r.business_id = d.business_id AND r.week_no = d.week_no AND r.bottleneck = 'margin' AND r.gap >= 0.2 AND r.material AND r.fact_id <> d.fact_id), 'price is low for the full unit cost')
        WHEN 'repeat_orders' THEN CASE WHEN has_gaps THEN 'first-time buyers are not coming back' END
        ELSE 'the limit is ' || CASE d.kpi {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LIMIT_STEPS.items())} END END AS where_text
    FROM (SELECT * FROM decided WHERE pos = 1) d JOIN (
        SELECT business_id, week_no, sum(CASE WHEN dimension IN ('friend', 'friend_of_friend') THEN numerator END) AS circle, coalesce(bool_or(dimension = 'stranger'), false) AS has_stranger,
               arg_max(kpi, ROW(gap, -fplace)) FILTER (bottleneck = 'conversion' AND gap IS NOT NULL) AS worst, bool_or(kpi = 'days_between_orders') AS has_gaps
        FROM rated JOIN fact_place USING (fact_id) GROUP BY 1, 2) g USING (business_id, week_no)""")
_IMP = (f"CASE what WHEN 'INR' THEN 'about INR ' || format('{{:,}}', CAST({rnd('amount', 0)} AS BIGINT)) || ' in the last 4 weeks' WHEN 'days' THEN 'about ' || {plain('amount', 1)} || ' days slower' "
        f"ELSE 'about ' || {plain('amount', 1)} || ' ' || what || ' in the last 4 weeks' END")
register("finding", ("located", "in_window", "actionable", "card"), f"""
    SELECT business_id, week_no, bottleneck, gap, key_fact, materiality, deviation, localised, has_action, passed, where_text, impact, min_effort,
           CASE WHEN NOT passed THEN concat_ws('; ', CASE WHEN NOT materiality THEN 'too small to matter yet' END, CASE WHEN NOT deviation THEN 'within 20% of your best weeks' END,
                CASE WHEN NOT localised THEN 'cannot say where the problem is' END, CASE WHEN NOT has_action THEN coalesce(why_not, 'no eligible action this week') END) END AS reason,
           CASE WHEN orders_in_window < 20 THEN 'estimate' ELSE confidence END AS confidence, orders_in_window
    FROM (SELECT *, materiality AND deviation AND localised AND has_action AS passed FROM (
    SELECT l.business_id, l.week_no, l.bottleneck, l.gap, l.fact_id AS key_fact, w.orders_in_window >= 20 AND l.material AS materiality, l.gap >= 0.2 AS deviation, where_text IS NOT NULL AS localised,
           coalesce(a.has_action, false) AS has_action, where_text, {_IMP.replace('amount', 'l.amount').replace('what', 'l.what')} AS impact, a.min_effort, a.why_not, w.orders_in_window, c.confidence
    FROM located l JOIN in_window w USING (business_id, week_no) LEFT JOIN actionable a USING (business_id, week_no, bottleneck) JOIN (SELECT * FROM card WHERE pos = 1) c USING (business_id, week_no, bottleneck)))""")
_P = f"list_position([{', '.join(repr(b) for b in BOTTLENECKS)}], bottleneck)"
register("verdict0", ("finding",), f"""
    SELECT business_id, week_no, max(orders_in_window) AS orders_in_window, CASE WHEN max(orders_in_window) >= 20 THEN arg_min(bottleneck, ROW(-gap, coalesce(min_effort, 1000000), {_P})) FILTER (passed) END AS "primary"
    FROM finding GROUP BY 1, 2""")
register("verdict", ("verdict0", "finding"), f"""
    SELECT v.*, CASE WHEN orders_in_window < 20 THEN 'not_enough_data' WHEN "primary" IS NULL THEN 'no_clear_bottleneck' ELSE 'ok' END AS status,
           (SELECT coalesce(string_agg(bottleneck, ',' ORDER BY k), '') FROM (SELECT bottleneck, row_number() OVER (ORDER BY NOT materiality, -gap, {_P}) AS k FROM finding f
            WHERE f.business_id = v.business_id AND f.week_no = v.week_no AND f.bottleneck IS DISTINCT FROM v."primary") WHERE k <= 2) AS runners_up,
           (SELECT coalesce(string_agg(bottleneck || ': ' || reason, ' | ' ORDER BY {_P}), '') FROM finding f WHERE f.business_id = v.business_id AND f.week_no = v.week_no AND NOT passed) AS rejected FROM verdict0 v""")
register("target", ("verdict",), """
    SELECT v.business_id, v.week_no, CASE WHEN v."primary" IS NULL AND v.status = 'no_clear_bottleneck' THEN 'maintain' ELSE 'fix' END AS mode,
           CASE WHEN v."primary" IS NULL AND v.status = 'no_clear_bottleneck' THEN coalesce(p."primary", 'reach') ELSE v."primary" END AS bottleneck
    FROM verdict v LEFT JOIN verdict p ON p.business_id = v.business_id AND p.week_no = v.week_no - 1""")
register("mine", ("cand", "target"), "SELECT c.*, t.mode FROM cand c JOIN target t USING (business_id, week_no, bottleneck)")
picks("week_pick", "mine", ("mine",), "business_id, week_no")
register("mark", ("snapshots", "lib"), """
    SELECT 'act_' || business_id || '_w' || week_no || '_' || action_key AS action_id, CASE WHEN (business_id + week_no + place) % 5 < 3 THEN 'done' WHEN (business_id + week_no + place) % 5 = 3 THEN 'skipped' ELSE 'todo' END AS status FROM snapshots, lib""")
register("week_action", ("mine", "week_pick", "mark"), """
    SELECT m.business_id, m.week_no, 'act_' || m.business_id || '_w' || m.week_no || '_' || m.action_key AS action_id, m.action_key, bottleneck, mode,
           CASE WHEN w.action_key IS NOT NULL THEN 'action' WHEN NOT eligible THEN 'blocked' ELSE 'not_chosen' END AS kind, effort_min, score, blocked_reason, target_fact, target_value, current, direction,
           CASE WHEN w.action_key IS NOT NULL THEN CAST(as_of + 7 AS VARCHAR) END AS due, CASE WHEN w.action_key IS NOT NULL THEN coalesce(s.status, 'todo') END AS status, partner_id, product_name
    FROM mine m LEFT JOIN week_pick w ON w.business_id = m.business_id AND w.week_no = m.week_no AND w.action_key = m.action_key
    LEFT JOIN mark s ON s.action_id = 'act_' || m.business_id || '_w' || m.week_no || '_' || m.action_key""")
_NAMES = "(SELECT DISTINCT p_partkey % 5 AS business_id, p_name || CASE p_partkey % 9 WHEN 0 THEN ' nike edition' WHEN 3 THEN ' Ferrarista' WHEN 6 THEN ' (Hello Kitty)' ELSE '' END AS name FROM part)"
_PREF = "(SELECT business_id, week_no, action_key, CASE WHEN (place + week_no) % 4 = 0 THEN 'exclude' ELSE 'boost' END AS preference FROM snapshots, lib WHERE (place + week_no) % 4 = 0 OR (place + week_no) % 5 = 1)"
ORACLES = {
    "k01_k02_gap_and_shortfall": with_views(f"SELECT business_id, week_no, fact_id, gap, what, material, {rnd('amount', 4)} AS amount FROM rated", "rated"),
    "k03_decisive_facts": with_views("SELECT business_id, week_no, bottleneck, fact_id, gap, material, pos FROM decided", "decided"),
    "k04_k05_findings": with_views("SELECT * FROM finding", "finding"),
    "k06_evidence_cards": with_views("SELECT business_id, week_no, bottleneck, fact_id, claim, shown, shown_best, confidence, sample_size, origin FROM card", "card"),
    "k07_k08_verdict": with_views("SELECT * FROM verdict", "verdict"),
    "j06_next_month": with_views("""
        SELECT p.business_id, p.week_no, 'ok' AS status, month_from, month_to, orders_expected, demand_exceeds_capacity AS limited_by_capacity, CASE WHEN demand_exceeds_capacity THEN 'capacity' ELSE v."primary" END AS limiting_bottleneck,
               v."primary" AS primary_bottleneck, (SELECT coalesce(string_agg(CAST(window_start AS VARCHAR) || ' ' || name, '; ' ORDER BY window_start), '') FROM event_window WHERE CAST(month_from AS DATE) <= window_end AND window_start <= CAST(month_to AS DATE)) AS demand_windows
        FROM projection p LEFT JOIN verdict v USING (business_id, week_no)""", "projection", "verdict", "event_window"),
    "l01_l02_gate": with_views("SELECT business_id, week_no, action_key, eligible, blocked_reason FROM cand", "cand"),
    "l03_l04_score": with_views("SELECT business_id, week_no, action_key, fit, timing, score, partner_id, product_name FROM cand", "cand"),
    "l05_targets": with_views("SELECT business_id, week_no, action_key, target_fact, current, CAST(target_value AS DOUBLE) AS target_value FROM cand", "cand"),
    "l06_actionability": with_views("SELECT * FROM actionable", "actionable"),
    "l07_selection": with_views("SELECT business_id, week_no, bottleneck, action_key, score FROM cand JOIN picked USING (business_id, week_no, bottleneck, action_key)", "cand", "picked"),
    "l08_partner_ranking": with_views("SELECT business_id, partner_id, audience, location, engagement, CAST(past AS DOUBLE) AS past, score, blocked, rank FROM ranked_partner", "ranked_partner"),
    "l09_protected_terms": f"SELECT business_id, name, term FROM {_NAMES}, ({values([(t,) for t in PROTECTED_TERMS], 'term')}) WHERE regexp_matches(name, '(?i)(^|[^[:word:]])' || regexp_escape(term) || '([^[:word:]]|$)')",
    "l09_action_risk": with_views(f"""
        SELECT c.business_id, c.week_no, c.action_key, CASE WHEN raises_visibility THEN 'high' ELSE 'medium' END AS level, terms, products FROM cand c
        JOIN (SELECT business_id, string_agg(DISTINCT term, ', ' ORDER BY term) AS terms, count(DISTINCT name) AS products FROM {_NAMES}, ({values([(t,) for t in PROTECTED_TERMS], 'term')})
              WHERE regexp_matches(name, '(?i)(^|[^[:word:]])' || regexp_escape(term) || '([^[:word:]]|$)') GROUP BY 1) r ON r.business_id = c.business_id""", "cand"),
    "l10_product_demand": with_views("SELECT * FROM ask_count", "ask_count"),
    "l11_preferences": with_views(f"""
        SELECT business_id, week_no, action_key, eligible AND preference IS DISTINCT FROM 'exclude' AS eligible,
               CASE WHEN eligible AND preference = 'exclude' THEN 'Dropped after last week''s follow-up: the number did not move.' ELSE blocked_reason END AS blocked_reason,
               CASE WHEN preference = 'boost' THEN {rnd('score + 10', 1)} ELSE score END AS score FROM cand LEFT JOIN {_PREF} p USING (business_id, week_no, action_key)""", "cand"),
    "l12_week_actions": with_views("SELECT * REPLACE (CAST(target_value AS DOUBLE) AS target_value) FROM week_action", "week_action"),
}
