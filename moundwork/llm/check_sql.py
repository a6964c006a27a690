"""Check SQL of the queries that SQL can express on the same tables."""

from __future__ import annotations

from moundwork.llm import quality_rules as q

W, G = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def quality_sql() -> str:
    """Measures, certified cutoffs and verdicts of ``op2_quality_rules``."""
    signals = {
        "symbols": "n_symbols / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)",
        "exclaims": "n_exclaims / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)", "digits": "n_digits / greatest(word_chars, 1)",
    }
    share, error = q.RISK, q.DELTA / (len(q.STRATA) + 1)
    grid = ", ".join(
        f"('{rule}', {place}, {cut}::DOUBLE)" for rule, cuts in q.RULES.items() for place, cut in enumerate(cuts))
    values = " UNION ALL ".join(f"SELECT rn, doc_id, stratum, '{rule}' AS rule, {rule} AS value FROM measured" for rule in q.RULES)
    order = ", ".join(f"'{rule}'" for rule in q.RULES)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text,
    CASE WHEN lang IN ({', '.join(f"'{s}'" for s in q.STRATA)}) THEN lang ELSE 'other' END AS stratum FROM documents),
parts AS (
  SELECT *, regexp_extract_all(text, '{W}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines FROM texts),
triples AS (
  SELECT rn, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) AS triple,
    unnest(range(1, len(words) - 1)) AS i FROM parts WHERE len(words) >= 3),
repeated AS (
  SELECT rn, count(DISTINCT j) AS n FROM (
    SELECT rn, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rn, i FROM triples QUALIFY count(*) OVER (PARTITION BY rn, triple) > 1)) GROUP BY 1),
counted AS (
  SELECT p.rn, doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '{G}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
    len(regexp_extract_all(text, '!')) AS n_exclaims, len(regexp_extract_all(text, '[0-9]')) AS n_digits
  FROM parts p LEFT JOIN repeated r ON p.rn = r.rn),
measured AS (SELECT *, {', '.join(f'{expr} AS {rule}' for rule, expr in signals.items())} FROM counted),
signal AS ({values}),
marks AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
grid(rule, place, cut) AS (VALUES {grid}),
levels AS (
  SELECT s.rn, s.doc_id, stratum, place, max(value > cut) AS breaks
  FROM signal s JOIN grid g ON s.rule = g.rule WHERE rn IN (SELECT rn FROM measured WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words))
  GROUP BY ALL),
cells AS (
  SELECT stratum, place, count(*) FILTER (good) AS n, count(*) FILTER (good AND breaks) AS k, count(*) FILTER (NOT good AND breaks) AS caught
  FROM levels l JOIN marks m ON l.doc_id = m.doc_id GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN n = 0 OR k >= n * {share}::DOUBLE THEN 1 ELSE
    list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}::DOUBLE) + (n - i) * ln(1 - {share}::DOUBLE)) for i in range(0, k + 1)]) END AS p FROM cells),
chosen AS (
  SELECT stratum, arg_max(place, (caught, -place)) AS place FROM (
    SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY place) AS worst FROM tested) WHERE worst <= {error}::DOUBLE AND caught > 0 GROUP BY 1),
cuts AS (SELECT stratum, rule, cut FROM chosen c JOIN grid g ON c.place = g.place),
broken AS (
  SELECT rn, string_agg(s.rule, ',' ORDER BY list_position([{order}], s.rule)) AS broken
  FROM signal s JOIN cuts c ON s.stratum = c.stratum AND s.rule = c.rule WHERE value > cut GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken
FROM (SELECT m.*, b.broken, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured m LEFT JOIN broken b ON m.rn = b.rn)"""


def revisit_sql() -> str:
    """Archive records of the pages and their resolved revisits, as ``op7_warc_revisits`` gives them."""
    host = r"regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\d*\.|\.$', '', 'g')"
    port = r"regexp_extract(url, '^[^:/?#]+://(?:[^/?#@]*@)?[^/?#:]*:(\d+)', 1)"
    path = r"regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = r"list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p != '' AND NOT regexp_matches(lower(p), '^(?:phpsessid|jsessionid|sid|utm_[a-z]+)=')))"
    return rf"""
WITH captured AS (
  SELECT page_id, url, coalesce(html, '') AS body, html, '"' || left(sha256(coalesce(html, '')), 16) || '"' AS tag,
    make_timestamp((1700000000 + (page_id * 7919) % 2000 * 3600) * 1000000) AS t0 FROM pages),
records AS (
  SELECT page_id * 4 AS record_id, 0 AS n, url, t0 AS seen, tag, body, html FROM captured
  UNION ALL SELECT page_id * 4 + 1, 1, url, t0 + CASE WHEN page_id % 7 = 0 THEN -INTERVAL 1 HOUR ELSE INTERVAL 5 HOUR END, tag, NULL, NULL FROM captured
  UNION ALL SELECT page_id * 4 + 2, 2, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') || '#again', t0 + INTERVAL 30 HOUR, 'W/' || tag, NULL, NULL FROM captured
  UNION ALL SELECT page_id * 4 + 3, 3, url, t0 + INTERVAL 60 HOUR, '"old"', NULL, NULL FROM captured),
named AS (
  SELECT *, CASE WHEN url IS NOT NULL AND host != '' THEN host || CASE WHEN port IN ('', CASE WHEN lower(url) LIKE 'https://%' THEN '443' ELSE '80' END) THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) = 0 THEN '' ELSE '?' || array_to_string(query, '&') END END AS page
  FROM (SELECT *, {host} AS host, {port} AS port, {path} AS path, {query} AS query FROM records)),
paired AS (
  SELECT r.record_id, any_value(r.url) AS url, any_value(r.seen) AS seen, any_value(r.tag) AS tag, arg_max(o.record_id, (o.seen, o.record_id)) AS origin
  FROM named r LEFT JOIN named o ON o.n = 0 AND r.page = o.page AND o.seen <= r.seen WHERE r.n > 0 GROUP BY 1),
judged AS (
  SELECT p.*, o.body, o.html, CASE WHEN origin IS NULL THEN 'no earlier response' WHEN regexp_replace(p.tag, '^W/', '') != o.tag THEN 'validator mismatch' ELSE 'resolved' END AS verdict
  FROM paired p LEFT JOIN named o ON p.origin = o.record_id)
SELECT record_id, url, strftime(seen, '%Y-%m-%d %H:%M:%S') AS captured_at, CASE WHEN verdict = 'resolved' THEN origin END AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN array_to_string(['cache-control: max-age=60', 'content-length: ' || strlen(body), 'content-type: text/html',
    'date: ' || strftime(seen, '%Y-%m-%d %H:%M:%S'), 'etag: ' || tag], chr(10)) END AS headers,
  CASE WHEN verdict = 'resolved' THEN length(html) END AS n_chars FROM judged"""


def topk_sql() -> str:
    """The ten highest inner products of every vector whose id is divisible by 100, by all pairs."""
    return """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
    coalesce(list_sum(list_transform(list_zip(q.parts, d.parts), lambda z: coalesce(z[1] * z[2], 0))), 0) AS score
  FROM vectors q JOIN vectors d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""
