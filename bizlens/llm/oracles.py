"""SQL forms of the operators that a second engine can express."""

from __future__ import annotations

from itertools import permutations

from bizlens.llm import url_filter as uf

BLANK = r"[\x20\x09-\x0D]"

EXACT_DEDUP = rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def _url_filter() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in uf.RULES)
    patterns = " OR ".join(f"regexp_matches(host || path, '{p.pattern}')" for p in uf.PATTERNS)
    return rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {rules}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hit AS (SELECT page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
  FROM part JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT part.page_id, host, path, rule, coalesce(hit.verdict, CASE WHEN {patterns} THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN hit ON part.page_id = hit.page_id
"""


WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM g
"""

#: The given pages mark their article, and hold five character references; what is left of them by those rules.
HTML = r"""
WITH cut AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS inner_html FROM pages),
block AS (SELECT page_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM (SELECT page_id, regexp_split_to_array(inner_html, '</?(?:p|h1)>') AS parts FROM cut)),
plain AS (SELECT page_id, k, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(part, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);', chr(39), 'g'), '&nbsp;?', ' ', 'g'), '&amp;?', '&', 'g'), chr(160), ' ') AS t FROM block),
tidy AS (SELECT page_id, k, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM plain),
whole AS (SELECT page_id, string_agg(t, chr(10) ORDER BY k) AS text FROM tidy WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN whole USING (page_id)
"""

#: crc32 bit by bit: a byte is exclusive-ored in, then eight shifts (marked -1) follow.
SPELLING = r"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
seen AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM run WHERE length(raw) >= 5 GROUP BY 1, 2),
code AS (SELECT w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes FROM seen),
sums AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(bytes, lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM code),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM sums),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
holes AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS near, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY 1),
pick AS (SELECT b.word, b.n_near, b.top, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.top GROUP BY 1, 2, 3),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM words w LEFT JOIN pick USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM form UNION ALL SELECT walk.word, form.word, form.form FROM walk JOIN form ON walk.next = form.word)
SELECT form.word, form.form, walk.root, form.n, form.n_near, CAST(form.form_n AS BIGINT) AS form_n FROM form JOIN walk ON walk.word = form.word AND walk.next IS NULL
"""


def _filter_audit() -> str:
    orders = ", ".join(f"('{''.join(p)}', {k + 1}, {sum(1 << 'ABCDE'.index(x) for x in p[:k])}, {1 << 'ABCDE'.index(p[k])})" for p in permutations("ABCDE") for k in range(5))
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
mark AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
m AS (SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN first_id < d.doc_id THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM d JOIN first ON first.text = d.text LEFT JOIN mark ON mark.doc_id = d.doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY 1, 2),
o(filter_order, step, before, own) AS (VALUES {orders}),
s AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN o GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s
"""


ORACLES = {"op3_exact_dedup": EXACT_DEDUP, "op4_url_filter": _url_filter(), "op5_warc_salvage": WARC, "op11_html_extraction": HTML, "op12_spelling_variants": SPELLING,
           "op13_filter_audit": _filter_audit()}
