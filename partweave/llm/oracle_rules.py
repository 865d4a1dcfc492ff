"""DuckDB SQL of the quality rules: base measures, exact binomial tests, cutoffs and verdicts.

Its constants are written out here and not taken from the operator, so that a wrong one shows.
"""

from __future__ import annotations

#: Cutoffs from lenient to strict, ends of the strata, largest share of good documents rejected and the chance that a promise fails.
_CUTOFFS = {
    "symbol_share": "0.5 0.4 0.3 0.25 0.2 0.15 0.12 0.1 0.08 0.06 0.05 0.04 0.03",
    "dup_line_share": "0.9 0.8 0.7 0.6 0.5 0.4 0.35 0.3",
    "repeat_share": "0.19 0.18 0.17 0.16 0.15 0.14 0.13 0.12 0.11 0.1",
}
_ENDS, _ALPHA, _DELTA = (100, 400, 1600), 0.01, 0.05


def sql() -> str:
    cutoffs = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, steps in _CUTOFFS.items() for i, c in enumerate(steps.split()))
    # Four strata of document length and three rules share the chance.
    level = _DELTA / 12
    stratum = " + ".join(f"(n_words >= {n})::INT" for n in _ENDS)
    values = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{rule}' AS rule, {a}::DOUBLE / greatest({b}, 1) AS value FROM base"
        for rule, a, b in (("symbol_share", "n_symbols", "word_chars"), ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"))
    )
    return rf"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS t,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
        FROM documents),
    grams AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
        FROM (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM t, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i))),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM grams, range(5) r(j) WHERE n > 1 GROUP BY doc_id),
    base AS (
        SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
               len(words) < 10 OR 100 * coalesce(n, 0) > 20 * len(words) AS base_failed, {stratum} AS stratum
        FROM t LEFT JOIN covered USING (doc_id)),
    vals AS ({values}),
    steps(rule, i, cutoff) AS (VALUES {cutoffs}),
    held AS (SELECT v.* FROM vals v JOIN base b USING (doc_id) JOIN labels l USING (doc_id) WHERE l.quality = 1 AND NOT b.base_failed),
    counts AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (WHERE value > cutoff) AS k FROM held JOIN steps USING (rule) GROUP BY ALL),
    tests AS (
        SELECT *, CASE WHEN k >= n * {_ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
            exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln({_ALPHA}) + (n - j) * ln(1 - {_ALPHA})))) END AS p
        FROM counts),
    proven AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY i) <= {level} AS ok FROM tests),
    chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM proven WHERE ok GROUP BY stratum, rule),
    rejected AS (SELECT DISTINCT doc_id FROM vals JOIN chosen USING (stratum, rule) WHERE value > cutoff)
    SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept
    FROM base b LEFT JOIN rejected r USING (doc_id)"""
