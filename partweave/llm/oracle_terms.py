"""DuckDB SQL of the operators that count terms, with constants of its own."""

from __future__ import annotations

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

DIVERGENCE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), {UPPER}, {LOWER}) AS term FROM d),
    kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    sized AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM d),
    total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY ALL),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p
        FROM groups g JOIN kept k USING (lang) JOIN sized USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (any_value(t) + 2 * any_value(v)) AS q
          FROM n JOIN sized USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS t FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY ALL),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY coalesce(value, 0) DESC, item))::INT AS rank
    FROM every QUALIFY part = 'pair' OR rank <= 10"""

# The table of the checksum follows from its polynomial; checksums are taken of distinct words only.
RESAMPLING = f"""
    WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
    used AS (
        SELECT 'd' AS part, doc_id AS id, row_number() OVER () AS r, translate(text, {UPPER}, {LOWER}) AS text FROM documents
        UNION ALL SELECT 'b', item_id, row_number() OVER (), translate(text, {UPPER}, {LOWER}) FROM benchmark),
    words AS (SELECT part, r, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM used),
    byte AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda j: ('0x' || substr(hex(encode(w)), 2 * j - 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT w FROM words)),
    bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM byte, crc),
    n AS (SELECT part, b, count(*) AS n FROM words JOIN bucket USING (w) GROUP BY ALL),
    total AS (SELECT coalesce(sum(n) FILTER (part = 'd'), 0) AS s, coalesce(sum(n) FILTER (part = 'b'), 0) AS t FROM n),
    gain AS (
        SELECT b, floor(1000 * ln((coalesce(max(n) FILTER (part = 'b'), 0) + 1)::DOUBLE * (any_value(total.s) + 10000)::DOUBLE / ((coalesce(max(n) FILTER (part = 'd'), 0) + 1)::DOUBLE * (any_value(total.t) + 10000)::DOUBLE)))::BIGINT AS g
        FROM n, total GROUP BY b),
    weight AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE part = 'd' GROUP BY r),
    scored AS (
        SELECT id AS doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(g::DOUBLE / n)::BIGINT END AS weight,
               floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
        FROM used LEFT JOIN weight USING (r) WHERE part = 'd'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place, (count(*) OVER (PARTITION BY n_features >= 20)) * 10 // 100 AS most FROM scored)
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM ranked"""
