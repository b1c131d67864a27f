"""DuckDB SQL of operators' rows, written from the definitions: plain joins, windows and counts without any of the
operators' methods. Documents are taken to have distinct ids here."""

from __future__ import annotations

from relspark.llm import jaccard, repetition, secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

WARC = """
SELECT page_id, url, payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again
  FROM (SELECT page_id, url, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages))"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
dw AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
ten AS (SELECT doc_id, k, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM dw),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_PLAIN} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, w[k:k + least(len(w), 10) - 1] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM iw),
hits AS (SELECT doc_id, k, n, item FROM (SELECT doc_id, k, n, g[1:n] AS g FROM ten, sizes WHERE len(g) >= n) JOIN iw USING (g)),
words AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
dw AS (SELECT doc_id, k, len(w) AS n, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
five AS (SELECT doc_id, k, n, list(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {jaccard.SHINGLE - 1} FOLLOWING) AS g FROM dw),
grams AS (SELECT DISTINCT doc_id, g FROM five WHERE len(g) = {jaccard.SHINGLE} OR k = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE c >= {jaccard.THRESHOLD} * (s.n + t.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM reach r LEFT JOIN counts c ON r.a = c.a GROUP BY r.a"""

_WORD = r"[^\x20\x09-\x0D]+"
REPETITION = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
dw AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
frames AS (
  SELECT doc_id, k, list(word) OVER (p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS short, list(word) OVER (p ROWS BETWEEN CURRENT ROW AND {repetition.MIN_SPAN - 1} FOLLOWING) AS span,
    count(*) OVER (p ROWS BETWEEN CURRENT ROW AND {repetition.MAX_LONGEST} FOLLOWING) AS n, md5(string_agg(word, ' ') OVER (p ROWS BETWEEN CURRENT ROW AND {repetition.MAX_LONGEST} FOLLOWING)) AS long
  FROM dw WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
repeated AS (
  SELECT doc_id, k, len(short) = 3 AND count(*) OVER (PARTITION BY doc_id, short) > 1 AS a, len(span) = {repetition.MIN_SPAN} AND count(*) OVER (PARTITION BY doc_id, span) > 1 AS b,
    n = {repetition.MAX_LONGEST + 1} AND count(*) OVER (PARTITION BY doc_id, n, long) > 1 AS c
  FROM frames),
spread AS (
  SELECT doc_id, max(CAST(a AS INT)) OVER (p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, max(CAST(b AS INT)) OVER (p ROWS BETWEEN {repetition.MIN_SPAN - 1} PRECEDING AND CURRENT ROW) AS b, c
  FROM repeated WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
figures AS (SELECT doc_id, CAST(sum(a) AS BIGINT) AS n_repeat_words, CAST(sum(b) AS BIGINT) AS n_covered_words, bool_or(c) AS too_long FROM spread GROUP BY doc_id),
lines AS (SELECT doc_id, l[k] AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM d)),
again AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY doc_id),
rules AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered_words, 0) AS n_covered_words, coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN figures USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_covered_words <= CAST({repetition.MAX_COVERED} AS DOUBLE) * n_words AND NOT too_long AS kept, n_covered_words
FROM (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM rules)"""


def _places(name: str, pattern: str, group: int = 0) -> str:
    """doc_id, s, e, m, v (the group) of a pattern's matches: what lies between the matches gives the offsets."""
    quoted = pattern.replace("'", "''")
    return f"""
{name}_found AS (SELECT doc_id, regexp_split_to_array(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d),
{name}_at AS (SELECT doc_id, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM {name}_found WHERE len(m) > 0),
{name}_all AS (
  SELECT doc_id, m[i] AS m, v[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_at)"""


def _secrets() -> str:
    allowed, wide = secrets.ALLOWED, secrets.WINDOW
    fit = lambda needs, lacks: " AND ".join(f"regexp_matches(m, '{x}')" for x in ("[0-9]", "[A-Za-z]", needs)) + " AND NOT " + " AND NOT ".join(f"regexp_matches(m, '{x}')" for x in (lacks, secrets.UUID))
    places = ",".join(_places(name, pattern) for name, pattern, *_ in secrets.CLASSES)
    candidates = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS class, {bits} AS bits, s, m FROM {name}_all WHERE {fit(needs, lacks)}" for name, _, needs, lacks, bits in secrets.CLASSES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{_places("assign", secrets.ASSIGN, 2)},{_places("access", secrets.ACCESS)},{_places("run", secrets.HEX)},{places},
candidates AS ({candidates}),
cut AS (SELECT *, regexp_split_to_array(m, '{allowed}') AS p, regexp_extract_all(m, '{allowed}') AS g FROM candidates),
placed AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut),
parts AS (
  SELECT doc_id, class, bits, p[i] AS t, CAST(s + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM placed),
windows AS (SELECT doc_id, class, s, s + i AS place FROM (SELECT *, unnest(range(0, length(t) - {wide - 1})) AS i FROM parts WHERE length(t) >= {wide}) WHERE list_aggregate(string_split(substr(t, i + 1, {wide}), ''), 'entropy') >= bits),
marked AS (SELECT *, CASE WHEN place <= lag(place) OVER w + {wide} THEN 0 ELSE 1 END AS fresh FROM windows WINDOW w AS (PARTITION BY doc_id, class, s ORDER BY place)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, class, s ORDER BY place) AS k FROM marked),
spans AS (
  SELECT doc_id, s, 0 AS k, s + length(m) AS e FROM assign_all WHERE length(v) >= 8
  UNION ALL SELECT doc_id, s, 1, s + length(m) FROM access_all WHERE length(m) >= 16
  UNION ALL SELECT doc_id, s, 2, s + length(m) FROM run_all
  UNION ALL SELECT doc_id, min(place), 3, max(place) + {wide} FROM numbered GROUP BY doc_id, class, s, k),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS x FROM spans),
grouped AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k, e) AS every
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN grouped USING (doc_id)"""


SECRETS = _secrets()
