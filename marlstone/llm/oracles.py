"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_reputation import LONG_SUFFIXES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Prior strength from the moments of counts (n, good) around their prior means.
STRENGTH = "1 / least(greatest(coalesce((sum(pow(good - n * prior, 2)) - sum(n * prior * (1 - prior))) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.0), 1e-3), 0.5) - 1"
ESCAPED = "length(regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"

ORACLES: dict[str, str] = {
    "op1_url_reputation": rf"""
WITH split AS (SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
counted AS (SELECT host, count(*) AS n, sum((quality = 1 AND toxic = 0)::INT) AS good FROM split JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
named AS (SELECT h.host, h.name, coalesce(n, 0) AS n, coalesce(good, 0) AS good, CASE WHEN long <> '' THEN long ELSE split_part(h.name, '.', -1) END AS suffix FROM (SELECT *, regexp_extract(name, '(?:^|\.)({"|".join(s.replace(".", "[.]") for s in LONG_SUFFIXES)})$', 1) AS long FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', '') AS name FROM split) AS every_host) AS h LEFT JOIN counted c ON c.host = h.host),
hosts AS (SELECT *, CASE WHEN length(name) - length(suffix) - 1 <= 0 THEN name ELSE split_part(substr(name, 1, length(name) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM named),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 2)::DOUBLE ELSE 0.5 END AS prior FROM hosts),
s1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(prior) AS prior FROM hosts, overall GROUP BY 1), k1 AS (SELECT {STRENGTH} AS s FROM s1), p1 AS (SELECT suffix, (prior * s + good) / (s + n) AS prior FROM s1, k1),
s2 AS (SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.good) AS good, any_value(p1.prior) AS prior FROM hosts h JOIN p1 USING (suffix) GROUP BY 1, 2), k2 AS (SELECT {STRENGTH} AS s FROM s2), p2 AS (SELECT domain, (prior * s + good) / (s + n) AS prior FROM s2, k2),
s3 AS (SELECT h.host, h.n, h.good, p2.prior FROM hosts h JOIN p2 USING (domain)), k3 AS (SELECT {STRENGTH} AS s FROM s3), ab AS (SELECT host, n, good, prior * s + good AS a, (1 - prior) * s + n - good AS b FROM s3, k3),
post AS (SELECT host, n, good, a / (a + b) AS mean, sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS sd FROM ab),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
fit AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path, page_id FROM split) AS u JOIN parts ON (u.host = parts.h OR ends_with(u.host, '.' || parts.h)) AND starts_with(u.path, parts.p) GROUP BY 1, 2, 3)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN least(1.0, mean + 1.64 * sd) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n AS host_labels, good AS host_good, round(mean, 9) AS host_mean, round(greatest(0.0, mean - 1.64 * sd), 9) AS host_lower, round(least(1.0, mean + 1.64 * sd), 9) AS host_upper
FROM split s JOIN post USING (host) LEFT JOIN fit f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path
""",
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.node, ways.b FROM reach r JOIN ways ON r.other = ways.a),
least_of AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of ON node = doc_id
""",
    "op8_chat_format": rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(12 + length(role) + 1 + {ESCAPED.format("text")} + 11)::BIGINT AS formatted_chars FROM turns GROUP BY conv_id
""",
    "op7_site_lines": """
WITH pages AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
counts AS (SELECT source, line, count(*) AS pages_with FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages) AS each_line WHERE line <> '' GROUP BY source, line),
bad AS (SELECT c.source, list(c.line) AS boilerplate FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.pages_with >= 5 AND c.pages_with >= 0.02 * t.host_pages GROUP BY c.source),
cleaned AS (SELECT p.doc_id, p.source, p.lines, list_filter(p.lines, lambda x: NOT list_contains(coalesce(b.boilerplate, []), x)) AS kept FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS clean_sha256, length(array_to_string(kept, chr(10))) AS clean_chars FROM cleaned
""",
    "op9_decontaminate": r"""
WITH rows_ AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM rows_),
sets AS (SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
docs AS (SELECT id, unnest(s) AS x FROM sets WHERE kind = 0),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets WHERE kind = 1)
SELECT d.id AS doc_id, i.id AS item_id, max(i.n) AS n_shingles, count(*) AS n_common, count(*)::DOUBLE / max(i.n) AS containment
FROM docs d JOIN items i ON d.x = i.x GROUP BY 1, 2 HAVING count(*) >= 0.8 * max(i.n)
""",
    "op10_exact_dedup": """
WITH groups AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256 FROM documents d JOIN groups g ON coalesce(d.text, '') = g.t
""",
}
