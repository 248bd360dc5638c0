"""DuckDB SQL for the rows of the queries that SQL can express."""

_HOST = "CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"



def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _alnum(text: str) -> str:
    """Words of letters, digits and what isn't ASCII."""
    return f"regexp_extract_all({_lower(text)}, " + r"'[0-9a-z\x{80}-\x{10FFFF}]+')"


ORACLES = {
    "op2_decontaminate": f"""
WITH iw AS (SELECT item_id, {_alnum("coalesce(text, '')")} AS w FROM benchmark),
ik AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
i AS (SELECT item_id, k, list_sort(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j : j + k - 1], ' ')))) AS s FROM ik),
c AS (SELECT row_number() OVER () AS cls, coalesce(min(item_id), -1) AS item_id, count(*) AS n_copies, k, s, len(s) AS n_item FROM i GROUP BY k, s),
cs AS (SELECT cls, k, unnest(s) AS shingle FROM c),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum("coalesce(text, '')")} AS w FROM documents),
ds AS (
  SELECT DISTINCT rid, k, array_to_string(w[j : j + k - 1], ' ') AS shingle
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM dw, (SELECT DISTINCT k FROM c) WHERE len(w) >= k)
),
m AS (SELECT rid, cls, count(*) AS n_held FROM ds JOIN cs USING (k, shingle) GROUP BY rid, cls)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_copies, n_held, n_held / n_item AS containment
FROM m JOIN c USING (cls) JOIN dw USING (rid) WHERE n_held * 100 >= n_item * 80
""",
    # Distinct documents of a host are distinct texts.
    "op4_line_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS v FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM v) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM r, range(8) t(j) GROUP BY rid),
l AS (SELECT rid, source, text, line, length(line) AS n, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm FROM (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
h AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
f AS (
  SELECT x.source, x.norm FROM (SELECT source, norm, count(DISTINCT text) AS held_by, max(n) AS n FROM l GROUP BY source, norm) x
  JOIN h ON x.source IS NOT DISTINCT FROM h.source WHERE held_by > 20 AND (held_by > 0.02 * docs OR (n >= 100 AND held_by > 1000))
),
g AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(n) AS total, coalesce(sum(n) FILTER (f.norm IS NOT NULL), 0) AS lost, count(DISTINCT f.norm) AS removed
  FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY rid
),
o AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_lines, CASE WHEN total > 0 THEN 1 - lost / total ELSE 1.0 END::DOUBLE AS kept_part
  FROM d LEFT JOIN g USING (rid) LEFT JOIN p USING (rid)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_part >= 0.2 AS kept, removed_lines, kept_part FROM b
""",
    # All pairs of documents with a shingle in common, and what links reach from each document.
    "op7_jaccard_components": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM m JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN r ON w.doc_id = r.doc_id GROUP BY w.doc_id
""",
    "op6_url_rules": f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
""",
    "op8_mix": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix-1'), 1, 15))::BIGINT AS key
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w
  FROM d GROUP BY source
),
o AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS total,
    coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s
),
-- The level is that of the first source, by the ratio of its limit to its weight, that stays within its limit.
l AS (SELECT (total - full_before) / w_left AS level FROM o WHERE (total - full_before) / w_left * w <= 2.0 * source_size ORDER BY 2.0 * source_size / w, source LIMIT 1),
t AS (SELECT source, source_size, least(2.0 * source_size, level * w)::DOUBLE AS target FROM o, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, g.source_size, g.target, g.epochs, round(g.target)::BIGINT - g.epochs * g.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM p
""",
}
