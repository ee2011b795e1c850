"""Section O in SQL (numbers need look-behind, which the checking engine's patterns lack: the generated sentences keep numbers after spaces)."""

from __future__ import annotations

from bizlens.operators.facts import FACT_IDS
from bizlens.operators.grounding import PAID_ADS, kpi_words
from bizlens.oracles import facts as _f  # noqa: F401  registers fact
from bizlens.oracles.views import register, with_views

_PLACE = f"list_position([{', '.join(repr(f) for f in FACT_IDS)}], fact_id)"
register("sentence", ("fact",), f"""
    SELECT business_id, week_no, doc_fact, CASE WHEN k % 31 = 0 THEN 'Too short' ELSE 'On ' || period_to || ' the ' || replace(kpi, '_', ' ') || ' stood at ' || CAST(value AS VARCHAR) || ' from a sample of ' || sample_size || '.'
           || CASE WHEN k % 9 = 0 THEN ' Expect ' || printf('%.1f', sample_size + 7777.5) || ' next week.' ELSE '' END || CASE WHEN k % 7 = 0 THEN ' You could run ads.' ELSE '' END END AS text,
           k % 9 = 0 AND k % 31 <> 0 AS wrong, printf('%.1f', sample_size + 7777.5) AS token, CASE WHEN k % 11 = 0 THEN fact_id || '_old' END AS unknown, business_id % 3 <> 0 AS no_paid_ads
    FROM (SELECT *, fact_id AS doc_fact, business_id * 100 + week_no * 23 + {_PLACE} AS k FROM fact)""")
_WORDS = ", ".join(f"('{k}', '{w}')" for k, w in kpi_words())
ORACLES = {
    "o03_ungrounded_numbers": with_views("SELECT business_id, week_no, doc_fact, token FROM sentence WHERE wrong", "sentence"),
    "o04_text_errors": with_views(f"""
        SELECT business_id, week_no, doc_fact, CASE WHEN length(text) < 20 OR length(text) > 900 THEN 'schema' ELSE concat_ws('; ', 'unknown evidence_ids: ' || unknown, CASE WHEN wrong THEN 'numbers not in the evidence packet: ' || token END,
               CASE WHEN no_paid_ads AND regexp_matches(text, '{PAID_ADS}') THEN 'constraint violation: suggests paid ads' END) END AS errors FROM sentence""", "sentence"),
    "o04_answer_errors": with_views("""
        SELECT business_id, week_no, doc_fact, CASE WHEN coalesce(length(text), 0) NOT BETWEEN 1 AND 900 THEN 'schema' ELSE concat_ws('; ', CASE WHEN week_no % 2 = 1 THEN 'unknown citations: ' || unknown END,
               CASE WHEN wrong THEN 'numbers not in the evidence packet: ' || token END, CASE WHEN NOT wrong AND week_no % 2 = 0 AND text <> 'Too short' THEN 'numbers without a cited fact' END) END AS errors
        FROM sentence""", "sentence"),
    "o05_fact_retrieval": with_views(f"""
        SELECT question_id, fact_id, hits, pos FROM (SELECT question_id, fact_id, hits, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, {_PLACE}) AS pos FROM (
            SELECT question_id, business_id, week_no, kpi, count(*) AS hits FROM (
                SELECT conv_id * 1000 + turn AS question_id, conv_id % 5 AS business_id, turn % 4 + 1 AS week_no, lower(['How many new customers came from outside my circle?', 'Is my margin or profit falling, what do I earn?',
                       'Why are deliveries late and slow?', 'Do people come back, how often do they repeat?', 'Can we keep up or are orders turned away?', 'What is the weather?'][1 + (conv_id * 3 + turn) % 6]) AS q
                FROM conversations WHERE role = 'user') JOIN (VALUES {_WORDS}) w(kpi, word) ON regexp_matches(q, '\\b' || regexp_escape(word)) GROUP BY 1, 2, 3, 4) JOIN fact USING (business_id, week_no, kpi)) WHERE pos <= 4""", "fact"),
}
