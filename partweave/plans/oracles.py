"""DuckDB SQL of the registered queries, written for that engine and not derived from the plans."""

from __future__ import annotations

from partweave.plans import inputs
from partweave.plans.inputs import duck

P3, P2 = "77-[0-9]{3}-[A-Za-z0-9]{6,7}-[0-9]{2,3}", "77-[0-9]{3}-[A-Za-z0-9]+"
CORPUS, MAPPING, BOXES, TEXTBOXES, RESULTS, FILES, RUNS, ARCHIVED = (
    duck(x) for x in (inputs.CORPUS, inputs.MAPPING, inputs.BOXES, inputs.TEXTBOXES, inputs.RESULTS, inputs.FILES, inputs.RUNS, inputs.ARCHIVED.format(b="\\", g=", 'g'"))
)

# RE2 has no look-behind: matches are found plainly, then a start after a run of exactly one digit is dropped.
# Tags in the corpus are parted by blanks, so dropping one never uncovers another.


def _hits(guard: bool = True) -> str:
    keep = "WHERE NOT (regexp_matches(substr(text, start_pos, 1), '[0-9]') AND start_pos > 0 AND NOT regexp_matches(substr(text, start_pos - 1, 1), '[0-9]'))" if guard else ""
    return f"""
    raw AS (
        SELECT unit_id, text, {P3_GAPS} FROM corpus),
    hits AS (
        SELECT unit_id, text, pattern_name, matched_text, start_pos::INT AS start_pos, (start_pos + length(matched_text))::INT AS end_pos FROM (
            SELECT unit_id, text, CASE WHEN regexp_full_match(m, '{P3}') THEN 'pattern_77_enforced_structure' ELSE 'pattern_77_two_dash_structure' END AS pattern_name, m AS matched_text,
                   (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_pos
            FROM (SELECT unit_id, text, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM raw)) {keep})"""


_ANY = f"{P3}|{P2}"
P3_GAPS = f"regexp_extract_all(text, '{_ANY}', 0, 'i') AS ms, string_split_regex(text, '{_ANY}', 'i') AS gaps"


def _with(*parts: str, guard: bool = True) -> str:
    return f"WITH corpus AS {CORPUS}, {', '.join((_hits(guard), *parts))}"


_MAP = f"mapping AS {MAPPING}"
_NORM = "lower(regexp_replace({x}, '[\\s-]', '', 'g'))"
_TIERS = f"""{_MAP},
    t1 AS (SELECT key AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1), t2 AS (SELECT lower(key) AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1),
    t3 AS (SELECT {_NORM.format(x='key')} AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1),
    found AS (SELECT h.*, coalesce(t1.v, t2.v, t3.v) AS replacement, CASE WHEN t1.v IS NOT NULL THEN 'exact' WHEN t2.v IS NOT NULL THEN 'lower' WHEN t3.v IS NOT NULL THEN 'normalized' END AS tier
              FROM hits h LEFT JOIN t1 ON matched_text = t1.k LEFT JOIN t2 ON lower(matched_text) = t2.k LEFT JOIN t3 ON {_NORM.format(x='matched_text')} = t3.k)"""
# With the three-dash tag unmapped the two-dash pattern may still map its beginning; no two-dash key exists in the mapping.
_REWRITE = """spans AS (SELECT unit_id, list({{'s': start_pos, 'e': end_pos, 'f': {final}}} ORDER BY start_pos) AS sp FROM found WHERE {keep} GROUP BY unit_id)
    SELECT c.unit_id, CASE WHEN sp IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(sp) + 1), lambda i:
        substr(text, CASE WHEN i = 1 THEN 1 ELSE (sp[i - 1].e + 1)::INT END, (sp[i].s - CASE WHEN i = 1 THEN 0 ELSE sp[i - 1].e END)::INT) || sp[i].f), '') || substr(text, (sp[len(sp)].e + 1)::INT) END AS final_text
    FROM corpus c LEFT JOIN spans USING (unit_id)"""
_OVERLAP = f"""b AS {BOXES},
    pairs AS (SELECT * FROM (
        SELECT e.image_id, e.ord AS easy_ord, t.ord AS tess_ord, greatest(least(e.x + e.w, t.x + t.w) - greatest(e.x, t.x), 0) * greatest(least(e.y + e.h, t.y + t.h) - greatest(e.y, t.y), 0) AS common,
               e.w * e.h + t.w * t.h AS both_areas FROM b e JOIN b t ON e.image_id = t.image_id AND e.engine = 'easyocr' AND t.engine = 'tesseract') WHERE common::DOUBLE / (both_areas - common) > 0.5)"""
_LINES = f"(SELECT path, string_split(text, chr(10)) AS l FROM {ARCHIVED})"
_METRIC = lambda i: "CASE lower(family) WHEN 'arial' THEN {} WHEN 'times new roman' THEN {} WHEN 'pmingliu' THEN {} ELSE {} END".format(*(((0.597, 1.494, 0.113, 0.96), (0.554, 1.494, 0.12, 0.96), (0.651, 1.757, 0.18, 0.92), (0.6, 1.25, 0.15, 0.96))[k][i] for k in range(4)))
_D = lambda x: f"CAST({x} AS DOUBLE)"


def _capacity(size: str = "size") -> str:
    return (
        f"floor((width / 72.0::DOUBLE * (1.0::DOUBLE - {_D(_METRIC(2))})) / ({size} * {_D(_METRIC(0))} / 72.0::DOUBLE))::INT AS cpl, "
        f"floor((height / 72.0::DOUBLE * (1.0::DOUBLE - {_D(_METRIC(2))})) / ({size} * {_D(_METRIC(1))} / 72.0::DOUBLE))::INT AS lines"
    )


def _classic(size: str) -> str:
    return f"""CASE WHEN has_dimensions THEN greatest(1, trunc(height * 0.94::DOUBLE / ({size} * 1.25::DOUBLE))::INT) ELSE greatest(1, trunc(20 / {size})::INT) END AS max_lines,
        CASE WHEN has_dimensions THEN greatest(8, trunc(width * 0.94::DOUBLE / ({size} * 0.6::DOUBLE))::INT) ELSE greatest(10, trunc(600 / {size})::INT) END AS max_cpl"""


def _wrapped(source: str, keys: str) -> str:
    """CTEs ending in ``wrapped`` (keys, lines): the words of ``source`` (keys, text, width) dealt to lines one by one. The only words with hyphens are tags of four parts (2, 4, 8 and 3 characters)."""
    return f"""src AS ({source}), f AS (
        SELECT {keys}, width, string_split(text, ' ') AS words, 1 AS i, ''::VARCHAR AS cur, []::VARCHAR[] AS lines, length(text) <= width * 1.1::DOUBLE AS whole, text FROM src
        UNION ALL
        SELECT {keys}, width, words, i + 1, CASE WHEN length(longer) <= width THEN longer ELSE pieces[len(pieces)] END,
               CASE WHEN length(longer) <= width THEN lines ELSE list_concat(lines, list_concat(CASE WHEN cur <> '' THEN [cur] ELSE []::VARCHAR[] END, pieces[1:len(pieces) - 1])) END, whole, text
        FROM (SELECT *, CASE WHEN cur <> '' THEN cur || ' ' || words[i] ELSE words[i] END AS longer,
                     CASE WHEN length(words[i]) <= width THEN [words[i]] WHEN contains(words[i], '-') THEN CASE WHEN width < 11 THEN [substr(words[i], 1, 6), substr(words[i], 7, 8), substr(words[i], 15)] WHEN width < 14 THEN [substr(words[i], 1, 6), substr(words[i], 7)] ELSE [substr(words[i], 1, 14), substr(words[i], 15)] END
                     ELSE list_transform(range(0, ceil(length(words[i]) / width)::BIGINT), lambda k: substr(words[i], (k * width + 1)::BIGINT, width)) END AS pieces
              FROM f WHERE NOT whole AND i <= len(words))),
        wrapped AS (SELECT {keys}, CASE WHEN whole THEN [text] WHEN cur <> '' THEN list_append(lines, cur) ELSE lines END AS lines FROM f WHERE whole OR i > len(words))"""


def _optimal(least: str) -> str:
    """CTE ``optimal`` (box_id, size, optimal_size): the largest quarter point from the size to three quarters of it, and ``least``, at which the wrapped text fits."""
    grid = f"SELECT b.*, size - k / 4.0::DOUBLE AS q FROM b, (SELECT unnest(range(0, 20)) AS k) WHERE has_dimensions AND size - k / 4.0::DOUBLE >= greatest({least}, size * 0.75::DOUBLE)"
    rooms = f"SELECT g.box_id, g.q, g.text, max_lines, max_cpl AS width FROM (SELECT box_id, q, text, greatest(1, trunc(height * 0.94::DOUBLE / (q * 1.25::DOUBLE))::INT) AS max_lines, greatest(8, trunc(width * 0.94::DOUBLE / (q * 0.6::DOUBLE))::INT) AS max_cpl FROM ({grid})) g"
    return f"""b AS {TEXTBOXES}, {_wrapped(rooms, 'box_id, q, max_lines')},
        best AS (SELECT wrapped.box_id, max(wrapped.q) AS q FROM wrapped JOIN src USING (box_id, q) WHERE len(lines) <= wrapped.max_lines AND list_max(list_transform(lines, lambda x: length(x))) <= width GROUP BY wrapped.box_id),
        optimal AS (SELECT box_id, size, CASE WHEN has_dimensions THEN coalesce(q, {least}) WHEN length(text) > 150 THEN greatest({least}, size * 0.85::DOUBLE) WHEN length(text) > 100 THEN greatest({least}, size * 0.9::DOUBLE) WHEN length(text) > 70 THEN greatest({least}, size * 0.95::DOUBLE) ELSE size END AS optimal_size FROM b LEFT JOIN best USING (box_id))"""


_SKIP = """CASE WHEN lower(ext) NOT IN ('.doc', '.docx') THEN 'unsupported extension' WHEN NOT regexp_matches(stem, '^[a-zA-Z0-9]') THEN 'not alphanumeric start'
    WHEN regexp_matches(stem || ext, '[<>:"/\\\\|?*]') THEN 'invalid characters' WHEN replace(stem, '.', '') = '' THEN 'invalid filename' WHEN stem LIKE '~%' THEN 'temporary file'
    WHEN list_contains(string_split(parent, '/'), 'processed') THEN 'excluded directory' WHEN lower(ext) = '.docx' AND stem LIKE '%\\_12NC\\_processed' ESCAPE '\\' THEN 'already processed'
    WHEN length < 0 THEN 'too small' WHEN length > 300 * 1048576 THEN 'too large' WHEN length = 0 OR (lower(ext) = '.docx' AND magic <> 'PK34') THEN 'not a valid document' END"""
_GUIDE_FAMILIES = "lower(family) IN ('arial', 'times new roman')"
_SEVERITY = """CASE WHEN t IN ('MemoryError', 'OSError', 'PermissionError') THEN 'critical' WHEN t IN ('ValueError', 'TypeError', 'AttributeError') THEN 'high'
    WHEN t IN ('FileNotFoundError', 'ImportError', 'ConnectionError') THEN 'medium' ELSE 'low' END"""
_CATEGORY = """CASE WHEN contains(lower(m), 'conver') AND (contains(lower(m), 'conversion') OR contains(lower(m), 'convert')) THEN 'conversion' WHEN contains(lower(m), 'load') OR contains(lower(m), 'parse') OR contains(lower(m), 'open') THEN 'loading'
    WHEN t = 'MemoryError' OR contains(lower(m), 'memory') THEN 'memory' WHEN t = 'PermissionError' OR contains(lower(m), 'permission') THEN 'permission' WHEN contains(lower(m), 'network') OR contains(lower(m), 'connection') THEN 'network'
    WHEN contains(lower(m), 'validation') OR contains(lower(m), 'invalid') THEN 'validation' ELSE 'processing' END"""
_RUNS = f"""{_with()}, cut AS (SELECT unit_id, text, unnest(range(0, (floor((length(text) - 1) / 7))::INT + 1))::INT AS run_idx FROM corpus),
    r AS (SELECT unit_id, run_idx, substr(text, run_idx * 7 + 1, 7) AS piece, (run_idx * 7)::INT AS a, (run_idx * 7 + length(substr(text, run_idx * 7 + 1, 7)))::INT AS z FROM cut),
    f AS (SELECT unit_id, matched_text AS mt, start_pos AS s, end_pos AS e FROM hits)"""
_R4 = "round({}, 4)"

ORACLES: dict[str, str] = {
    "detect_all": f"{_with()} SELECT unit_id, pattern_name, matched_text, start_pos, end_pos FROM hits",
    "detect_plain": f"{_with(guard=False)} SELECT unit_id, pattern_name, matched_text, start_pos, end_pos FROM hits",
    "detect_mapped": f"{_with(_TIERS)} SELECT unit_id, pattern_name, matched_text, start_pos, end_pos, replacement FROM found WHERE replacement IS NOT NULL",
    "match_context": f"{_with()} SELECT unit_id, start_pos, substr(text, (greatest(start_pos - 5, 0) + 1)::INT, (start_pos - greatest(start_pos - 5, 0))::INT) AS preceding_context, substr(text, end_pos + 1, 5) AS following_context FROM hits",
    "pattern_part": f"""WITH corpus AS {CORPUS} SELECT unit_id, nullif(regexp_extract(text, '77-[0-9]{{3}}-[A-Za-z0-9]+(?:-[0-9]{{2,3}})?'), '') AS part,
        nullif(regexp_extract(text, '(?:77|4022)-[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*'), '') AS token FROM corpus""",
    "char_profile": """WITH t AS (SELECT coalesce(text, '') AS t FROM documents), n AS (SELECT
        sum(length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) AS digit, sum(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g'))) AS ascii_letter, sum(length(t) - length(regexp_replace(t, '[ \\t\\n\\r]', '', 'g'))) AS space,
        sum(length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{-~]', '', 'g'))) AS punctuation, sum(length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))) AS unicode FROM t)
        SELECT unnest(['digit', 'ascii_letter', 'space', 'punctuation', 'unicode']) AS class, unnest([digit, ascii_letter, space, punctuation, unicode])::BIGINT AS n FROM n""",
    "top_characters": "SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch",
    "character_classes": """SELECT ch, CASE WHEN regexp_matches(ch, '^\\p{Nd}$') THEN 'digit' WHEN regexp_matches(ch, '^\\p{L}$') THEN 'letter' WHEN regexp_matches(ch, '^[\\s\\x{0B}\\x{85}\\p{Z}]$') THEN 'space' WHEN regexp_matches(ch, '^[\\x21-\\x7E]$') THEN 'punctuation' ELSE 'unicode' END AS class, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch""",
    "paragraph_scan": """SELECT doc_id, (i - 1)::INT AS paragraph, length(t)::INT AS n_chars, regexp_matches(t, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+') AS has_address FROM
        (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(t) <> ''""",
    "lookup_exact": f"{_with(_TIERS)} SELECT unit_id, start_pos, matched_text, t1.v AS replacement FROM hits LEFT JOIN t1 ON matched_text = t1.k",
    "lookup_tiered": f"{_with(_TIERS)} SELECT unit_id, start_pos, matched_text, replacement, tier FROM found",
    "mapped_only": f"{_with(_MAP)} SELECT unit_id, start_pos, matched_text FROM hits WHERE matched_text IN (SELECT key FROM mapping)",
    "unmapped_default": f"{_with(_TIERS)} SELECT t1.v IS NULL AS is_default, pattern_name, count(*) AS n FROM hits LEFT JOIN t1 ON matched_text = t1.k GROUP BY ALL",
    "match_debug": f"""{_with(_TIERS)} SELECT *, CASE WHEN raw = 0 THEN 'no_pattern_match' WHEN mapped = 0 THEN 'no_mapping' ELSE 'ok' END AS reason FROM
        (SELECT c.unit_id, count(h.matched_text) AS raw, count(t1.v) AS mapped FROM corpus c LEFT JOIN hits h USING (unit_id) LEFT JOIN t1 ON h.matched_text = t1.k GROUP BY 1)""",
    "rewrite_append": f"{_with(_TIERS)}, {_REWRITE.format(final=chr(34) + 'matched_text' + chr(34) + ' || ' + chr(39) + ';' + chr(39) + ' || coalesce(replacement, ' + chr(39) + '4022-NA' + chr(39) + ')', keep='TRUE')}",
    "rewrite_replace": f"{_with(_TIERS)}, {_REWRITE.format(final='replacement', keep='replacement IS NOT NULL')}",
    "run_spans": f"{_RUNS} SELECT unit_id, s AS start_pos, run_idx, a AS start, z AS \"end\" FROM r JOIN f USING (unit_id) WHERE a < e AND z > s",
    "run_rewrite": f"""{_RUNS}, t AS (SELECT unit_id, run_idx, list({{'s': s, 'e': e, 'm': mt}} ORDER BY s) AS sp FROM r JOIN f USING (unit_id) WHERE a < e AND z > s GROUP BY ALL)
        SELECT unit_id, run_idx, CASE WHEN sp IS NULL THEN piece ELSE array_to_string(list_transform(range(1, len(sp) + 1), lambda i:
            substr(piece, CASE WHEN i = 1 THEN 1 ELSE (sp[i - 1].e - a + 1)::INT END, (greatest(sp[i].s - a, 0) - CASE WHEN i = 1 THEN 0 ELSE sp[i - 1].e - a END)::INT) || CASE WHEN sp[i].s >= a THEN sp[i].m || ';4022-NA' ELSE '' END), '')
            || substr(piece, (least(sp[len(sp)].e, z) - a + 1)::INT) END AS text
        FROM r LEFT JOIN t USING (unit_id, run_idx) WHERE unit_id IN (SELECT unit_id FROM f)""",
    "split_around": f"""WITH corpus AS {CORPUS}, p AS (SELECT unit_id, text, nullif(regexp_extract(text, '77-[0-9]{{3}}-[A-Za-z0-9]+(?:-[0-9]{{2,3}})?'), '') AS part FROM corpus)
        SELECT unit_id, substr(text, 1, strpos(text, part) - 1) AS before, substr(text, strpos(text, part) + length(part)) AS after, substr(text, 1, strpos(text, part) - 1) || 'X' || substr(text, strpos(text, part) + length(part)) AS replaced FROM p WHERE part IS NOT NULL""",
    "dedupe_cells": """WITH r AS (SELECT o_orderkey % 97 AS doc_id, o_orderkey AS ord, (o_custkey % 40)::VARCHAR AS matched_text,
        CASE WHEN o_orderkey % 2 = 0 THEN 'section_0_table_' || (o_orderkey % 3) || '_row_' || (o_orderkey % 11) || '_cell_1' ELSE 'paragraph_' || (o_orderkey % 5) END AS location FROM orders)
        SELECT doc_id, ord, location, matched_text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN location LIKE 'section%' THEN regexp_extract(location, '^section_0_table_[0-9]+') ELSE location END, matched_text ORDER BY ord) = 1""",
    "dedupe_textbox": "SELECT o_orderkey % 500 AS unit_id, o_orderkey AS start_pos, (o_custkey % 9)::VARCHAR AS matched_text, o_orderstatus AS replacement FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 500, o_custkey % 9, o_orderstatus ORDER BY o_orderkey DESC) = 1",
    "dedupe_ocr": f"SELECT image_id, engine, ord, x, y FROM {BOXES} QUALIFY row_number() OVER (PARTITION BY image_id, lower(trim(text)), x // 10, y // 10 ORDER BY ord, engine) = 1",
    "dedupe_image_best": f"""WITH r AS (SELECT image_id, substr(text, 1, 3) AS text, confidence, ord % 3 = 0 AS is_mapped, (ord * 2 + (engine = 'easyocr')::INT)::INT AS o FROM {BOXES}),
        k AS (SELECT *, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS key FROM r)
        SELECT image_id, key, text, confidence, is_mapped, o AS kept_ord, min(o) OVER (PARTITION BY image_id, key) AS first_ord FROM k QUALIFY row_number() OVER (PARTITION BY image_id, key ORDER BY is_mapped DESC, confidence DESC, o) = 1""",
    "dedupe_variants": f"SELECT engine, count(*) AS n FROM (SELECT DISTINCT w, h, engine FROM {BOXES}) GROUP BY engine",
    "file_filter_reason": f"SELECT coalesce({_SKIP}, 'accepted') AS reason, count(*) AS n FROM {FILES} GROUP BY 1",
    "stem_dedupe": f"SELECT stem, ext, file_id FROM {FILES} WHERE ({_SKIP}) IS NULL QUALIFY row_number() OVER (PARTITION BY stem ORDER BY ext <> '.doc', file_id) = 1",
    "output_names": f"""SELECT file_id, CASE WHEN stem LIKE '%\\_12NC\\_processed' ESCAPE '\\' THEN stem ELSE stem || '_12NC_processed' END AS output_stem, regexp_replace(stem, '[<>:"/\\\\|?*]', '_', 'g') AS safe_name,
        CASE WHEN length = 0 THEN '0 B' ELSE (length // 1048576) || '.0 MB' END AS size_text FROM {FILES}""",
    "capacity": f"""SELECT box_id, lines, cpl, greatest(lines * cpl, 0) AS total, round(greatest(lines * cpl, 0) / (width / 72.0::DOUBLE * (height / 72.0::DOUBLE)), 4) AS per_sq_in FROM (SELECT *, {_capacity()} FROM {TEXTBOXES})""",
    "capacity_root": f"SELECT box_id, {_classic('size')} FROM {TEXTBOXES}",
    "line_map": f"SELECT box_id, font_size, max_lines FROM (SELECT box_id, font_size, {_classic('font_size')} FROM {TEXTBOXES}, (SELECT unnest([14, 12, 11, 10, 9, 8, 7, 6, 5.5, 5]::DOUBLE[]) AS font_size))",
    "size_for_lines": f"""WITH t AS (SELECT *, box_id % 6 + 1 AS target FROM {TEXTBOXES}), g AS (SELECT box_id, max(q / 4.0) AS font_size FROM t, (SELECT unnest(range(20, 57)) AS q) WHERE greatest(1, trunc(height * 0.94::DOUBLE / ((q::DOUBLE / 4) * 1.25::DOUBLE))::INT) >= target GROUP BY box_id)
        SELECT box_id, round((CASE WHEN has_dimensions THEN coalesce(font_size, 5.0) WHEN target <= 1 THEN 14.0 WHEN target <= 2 THEN 11.2 ELSE 8.4 END)::DOUBLE, 4) AS font_size FROM t LEFT JOIN g USING (box_id)""",
    "size_grid": f"""SELECT box_id, grid_size, lines, cpl, greatest(lines * cpl, 0) AS total, CASE WHEN greatest(lines * cpl, 0) >= length(text) THEN 'Y' ELSE 'N' END AS fits FROM (SELECT box_id, text, g AS grid_size, floor((height / 72.0::DOUBLE) / (g * 1.3::DOUBLE / 72.0::DOUBLE))::INT AS lines,
        floor((width / 72.0::DOUBLE) / (g * (CASE lower(family) WHEN 'times new roman' THEN 0.55 WHEN 'pmingliu' THEN 0.65 ELSE 0.6 END)::DOUBLE / 72.0::DOUBLE))::INT AS cpl FROM {TEXTBOXES}, (SELECT unnest([6, 7, 8, 9, 10, 12]::DOUBLE[]) AS g))""",
    "guideline_nearest": f"""WITH t AS {TEXTBOXES}, g AS (SELECT unnest([15, 25, 40, 60]) AS h)
        SELECT box_id, coalesce(max_lines, -1) AS max_lines FROM (SELECT box_id, CASE WHEN {_GUIDE_FAMILIES} AND size BETWEEN 6 AND 12 THEN floor(h * 2 / (size * 2 * 1.5::DOUBLE))::INT END AS max_lines, row_number() OVER (PARTITION BY box_id ORDER BY abs(h - height), h) AS rn FROM t, g) WHERE rn = 1""",
    "guided_fit": f"""WITH t AS (SELECT *, {_GUIDE_FAMILIES} AS known, length(text) AS n, CASE WHEN height < 25 THEN 15 WHEN height < 40 THEN 25 WHEN height < 60 THEN 40 ELSE 60 END AS gh, CASE WHEN width < 130 THEN 80 WHEN width < 200 THEN 130 ELSE 200 END AS gw FROM {TEXTBOXES}),
        g AS (SELECT t.*, s, floor(gh * 2 / (s * 2 * 1.5::DOUBLE))::INT AS gl, floor(gw * 4 / (s * 2))::INT AS gc FROM t, (SELECT unnest(range(12, 25)) / 2.0::DOUBLE AS s) WHERE known),
        c AS (SELECT *, {_capacity('s')} FROM g), need AS (SELECT box_id, greatest(1, ceil(n / gc)) AS req FROM g WHERE s = size),
        best AS (SELECT box_id, max(s) AS b FROM g WHERE s <= size AND greatest(1, ceil(n / gc)) <= gl AND n <= gl * gc GROUP BY box_id),
        p AS (SELECT c.* FROM c JOIN need USING (box_id) WHERE s NOT IN (11.5, 11, 10.5) AND gl >= req QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY s DESC) = 1),
        q AS (SELECT box_id, s AS pref FROM p WHERE lines > 0 AND cpl > 0 AND greatest(1, ceil(n / gc)) <= gl)
        SELECT box_id, round(CASE WHEN has_dimensions THEN coalesce(b, pref, 6) ELSE greatest(size * CASE WHEN n > 100 THEN 0.8 WHEN n > 50 THEN 0.85 ELSE 0.9 END::DOUBLE, 6) END, 4) AS fit_size FROM t LEFT JOIN best USING (box_id) LEFT JOIN q USING (box_id)""",
    "guideline_exact": f"""SELECT box_id, CASE WHEN h IN (15, 25, 40, 60) THEN floor(h * 2 / (size * 2 * 1.5::DOUBLE))::INT ELSE -1 END AS max_lines, CASE WHEN w IN (80, 130, 200) THEN floor(w * 4 / (size * 2))::INT ELSE -1 END AS max_cpl
        FROM (SELECT *, floor(width) AS w, floor(height) AS h FROM {TEXTBOXES}) WHERE {_GUIDE_FAMILIES} AND size BETWEEN 6 AND 12 AND (h IN (15, 25, 40, 60) OR w IN (80, 130, 200))""",
    "guideline_fallback": f"""WITH t AS (SELECT *, {_capacity()} FROM {TEXTBOXES}), g AS (SELECT unnest([15, 25, 40, 60]) AS h)
        SELECT box_id, coalesce(near, lines) AS max_lines FROM (SELECT box_id, lines, CASE WHEN {_GUIDE_FAMILIES} AND size BETWEEN 6 AND 12 THEN floor(h * 2 / (size * 2 * 1.5::DOUBLE))::INT END AS near, row_number() OVER (PARTITION BY box_id ORDER BY abs(h - height), h) AS rn FROM t, g) WHERE rn = 1""",
    "guideline_interp": f"""WITH t AS {TEXTBOXES} SELECT box_id, CASE WHEN {_GUIDE_FAMILIES} AND size BETWEEN 6 AND 12 THEN floor((CASE WHEN width < 130 THEN 80 WHEN width < 200 THEN 130 ELSE 200 END) * 4 / (size * 2))::INT ELSE -1 END AS max_cpl FROM t""",
    "band_lookup": f"""SELECT box_id, CASE WHEN size BETWEEN 0 AND 6.5 THEN 0 WHEN size BETWEEN 6 AND 8 THEN 1 WHEN size BETWEEN 8.5 AND 12 THEN 2 END AS rule_ord,
        CASE WHEN size BETWEEN 0 AND 6.5 THEN 5 WHEN size BETWEEN 6 AND 8 THEN 4 WHEN size BETWEEN 8.5 AND 12 THEN 2 END AS max_lines, CASE WHEN size BETWEEN 0 AND 6.5 THEN 40 WHEN size BETWEEN 6 AND 8 THEN 30 WHEN size BETWEEN 8.5 AND 12 THEN 20 END AS max_cpl FROM {TEXTBOXES}""",
    "font_fit": f"""WITH t AS {TEXTBOXES}, g AS (SELECT *, {_capacity('s')} FROM (SELECT t.*, h / 2.0::DOUBLE AS s FROM t, (SELECT unnest(range(12, 40)) AS h) WHERE h / 2.0 <= size)),
        b AS (SELECT box_id, max(s) AS best FROM g WHERE cpl > 0 AND lines > 0 AND greatest(1, ceil(length(text) / cpl)) <= lines AND length(text) <= trunc(lines * cpl * {_D(_METRIC(3))}) GROUP BY box_id)
        SELECT box_id, round(CASE WHEN has_dimensions THEN coalesce(best, 6.0) ELSE greatest(size * CASE WHEN length(text) > 100 THEN 0.8 WHEN length(text) > 50 THEN 0.85 ELSE 0.9 END::DOUBLE, 6.0) END, 4) AS fit_size FROM t LEFT JOIN b USING (box_id)""",
    "overflow_scale": f"""WITH t AS (SELECT *, length(text) * (size * 0.4::DOUBLE) AS tw, size * 1.2::DOUBLE AS th, width - width * 0.05::DOUBLE AS rw, height - height * 0.05::DOUBLE AS rh FROM {TEXTBOXES})
        SELECT box_id, has_dimensions AND (tw > rw OR th > rh) AS overflow, round(CASE WHEN has_dimensions THEN least(rw / tw, rh / th, 1.0) ELSE 1.0 END::DOUBLE, 9) AS factor FROM t""",
    "source_lines": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_lines FROM documents",
    "iou_pairs": f"WITH {_OVERLAP} SELECT image_id, easy_ord, tess_ord, round(common::DOUBLE / (both_areas - common), 5) AS iou FROM pairs",
    "unique_boxes": f"WITH {_OVERLAP} SELECT image_id, engine, ord FROM b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.image_id = b.image_id AND ((engine = 'easyocr' AND easy_ord = ord) OR (engine = 'tesseract' AND tess_ord = ord)))",
    "hybrid_merge": f"""WITH {_OVERLAP}, own AS (SELECT image_id, tess_ord, min(easy_ord) AS g FROM pairs GROUP BY ALL),
        m AS (SELECT image_id, g, 'tesseract' AS engine, tess_ord AS ord FROM own UNION SELECT image_id, g, 'easyocr', g FROM own)
        SELECT image_id, engine, ord, confidence, 'unique_' || engine || '_detection' AS reason FROM b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.image_id = b.image_id AND ((engine = 'easyocr' AND easy_ord = ord) OR (engine = 'tesseract' AND tess_ord = ord)))
        UNION ALL (SELECT image_id, engine, ord, confidence, 'highest_confidence' FROM m JOIN b USING (image_id, engine, ord) QUALIFY row_number() OVER (PARTITION BY image_id, g ORDER BY confidence DESC, engine, ord) = 1)""",
    "region_merge": f"""WITH b AS (SELECT * FROM {BOXES} WHERE engine = 'easyocr'), l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM b WINDOW o AS (PARTITION BY image_id ORDER BY y, x, ord)),
        j AS (SELECT *, CASE WHEN px IS NOT NULL AND abs((y + h / 2.0) - (py + ph / 2.0)) < (h + ph) / 2.0 * 0.5 AND greatest(x - (px + pw), px - (x + w), 0) < (h + ph) / 2.0 * 3 THEN 0 ELSE 1 END AS fresh FROM l),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) AS grp FROM j)
        SELECT image_id, grp::BIGINT AS "group", string_agg(trim(text), ' ' ORDER BY x, y, ord) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n, round(avg(confidence), 5) AS confidence FROM g GROUP BY image_id, grp""",
    "sub_box": f"SELECT engine, ord, x + trunc((2::DOUBLE / length(text)) * w)::INT AS x, greatest(1, trunc((5::DOUBLE / length(text)) * w)::INT) AS w FROM {BOXES}",
    "clear_rect": f"""WITH RECURSIVE b AS {BOXES}, o AS (SELECT image_id, x AS ox, y AS oy, w AS ow, h AS oh, row_number() OVER (PARTITION BY image_id ORDER BY ord, engine) AS k FROM b),
        p AS (SELECT *, x + 5 AS px, y + 1 AS py, w // 2 AS pw, h - 2 AS ph, CASE WHEN ord % 4 = 0 THEN x + w // 2 + 9 END AS nx, x + trunc(least(2::DOUBLE / length(text), 1) * w)::INT AS el, x + trunc(least(7::DOUBLE / length(text), 1) * w)::INT AS er FROM b),
        q AS (SELECT *, greatest(x, px - greatest(5, trunc(pw * 0.15::DOUBLE)::INT)) AS kx, least(x + w + 15, px + pw + greatest(5, trunc(pw * 0.15::DOUBLE)::INT), nx - 3) AS kz, greatest(0, py - greatest(8, trunc(ph * 0.6::DOUBLE)::INT)) AS ky,
                     least(150, py + ph + greatest(8, trunc(ph * 0.6::DOUBLE)::INT) + 20) AS kb, greatest(x, el - 5) AS fx, greatest(0, y - 5) AS fy FROM p),
        f AS (
            SELECT image_id, engine, ord, x AS ax, y AS ay, w AS aw, h AS ah, 0::BIGINT AS k, CASE WHEN ord % 2 = 0 THEN kx ELSE fx END::INT AS rx, CASE WHEN ord % 2 = 0 THEN ky ELSE fy END::INT AS ry,
                   CASE WHEN ord % 2 = 0 THEN greatest(10, kz - kx) ELSE least(greatest(trunc(w * 0.8::DOUBLE)::INT, er - el + 20), x + w - fx + 10) END::INT AS rw,
                   CASE WHEN ord % 2 = 0 THEN greatest(10, kb - ky) ELSE least(greatest(trunc(h * 1.2::DOUBLE)::INT, h + 15), 150 - fy) END::INT AS rh FROM q
            UNION ALL
            SELECT image_id, engine, ord, ax, ay, aw, ah, k,
                   CASE WHEN t AND NOT ox > rx + rw / 2 AND ox + ow < rx + rw / 2 THEN ox + ow + 3 ELSE rx END::INT, CASE WHEN t AND NOT oy > ry + rh / 2 AND oy + oh < ry + rh / 2 THEN oy + oh + 3 ELSE ry END::INT,
                   CASE WHEN t AND ox > rx + rw / 2 THEN greatest(10, ox - 3 - rx) WHEN t AND ox + ow < rx + rw / 2 THEN greatest(10, rx + rw - (ox + ow + 3)) ELSE rw END::INT,
                   CASE WHEN t AND oy > ry + rh / 2 THEN greatest(10, oy - 3 - ry) WHEN t AND oy + oh < ry + rh / 2 THEN greatest(10, ry + rh - (oy + oh + 3)) ELSE rh END::INT
            FROM (SELECT f.image_id, engine, ord, ax, ay, aw, ah, o.k AS k, rx, ry, rw, rh, ox, oy, ow, oh, NOT (ox = ax AND oy = ay AND ow = aw AND oh = ah) AND ox < rx + rw AND rx < ox + ow AND oy < ry + rh AND ry < oy + oh
                         AND (least(abs(ox - (rx + rw)), abs(ox + ow - rx)) < 10 OR least(abs(oy - (ry + rh)), abs(oy + oh - ry)) < 10) AS t
                  FROM f JOIN o ON o.image_id = f.image_id AND o.k = f.k + 1)),
        z AS (SELECT *, greatest(0, least(rx, 490)) AS cx, greatest(0, least(ry, 140)) AS cy FROM f QUALIFY row_number() OVER (PARTITION BY image_id, engine, ord ORDER BY k DESC) = 1)
        SELECT image_id, engine, ord, cx, cy, greatest(10, least(rw, 500 - cx)) AS cw, greatest(10, least(rh, 150 - cy)) AS ch FROM z""",
    "token_rectangle": f"""WITH t AS (SELECT image_id, y // 40 AS line, ord, split_part(text, ' ', 1) AS tok, x, y, w, h, row_number() OVER (PARTITION BY image_id, y // 40 ORDER BY ord) AS i FROM {BOXES} WHERE engine = 'easyocr'),
        g AS (SELECT a.*, b.tok AS target, lead(a.x) OVER (PARTITION BY a.image_id, a.line ORDER BY a.i) AS nx FROM t a JOIN t b ON a.image_id = b.image_id AND a.line = b.line AND b.i = 3)
        SELECT image_id, line, x, y, w, h, coalesce(nx, -1) AS next_left FROM (SELECT * FROM g WHERE starts_with(target, tok) QUALIFY row_number() OVER (PARTITION BY image_id, line ORDER BY i) = 1) WHERE tok = target""",
    "polygon_boxes": f"""SELECT engine, ord, trunc(least(x + 0.7::DOUBLE, x + (w + 0.3::DOUBLE), x + (w + 0.0::DOUBLE), x - 0.6::DOUBLE))::INT AS x, trunc(y - 0.4::DOUBLE)::INT AS y, trunc(x + (w + 0.3::DOUBLE) - (x - 0.6::DOUBLE))::INT AS w, trunc(y + (h + 0.9::DOUBLE) - (y - 0.4::DOUBLE))::INT AS h FROM {BOXES}""",
    "estimated_sizes": f"""WITH e AS (SELECT *, ord % 8 * 45 < 45 OR abs(ord % 8 * 45 - 180) < 45 AS flat FROM {BOXES})
        SELECT engine, ord, least(greatest(CASE WHEN flat THEN h ELSE w END, 8), 72) AS font_size, round(CASE WHEN flat THEN h * 0.8::DOUBLE ELSE h // 2 END, 4) AS baseline, round(CASE WHEN flat THEN h ELSE w END * 1.2::DOUBLE, 4) AS line_height, confidence > 0.3::DOUBLE AS bold FROM e""",
    "confident_boxes": f"""WITH b AS {BOXES} SELECT 'canonical' AS profile, image_id, engine, ord FROM b WHERE confidence >= 0.4::DOUBLE AND trim(text) <> '' UNION ALL SELECT 'classic', image_id, engine, ord FROM b WHERE engine = 'easyocr' AND confidence >= 0.7::DOUBLE AND trim(text) <> ''""",
    "image_matches": f"""WITH b AS (SELECT *, {inputs.tag("ord")} AS mt FROM {BOXES}), {_MAP}, t1 AS (SELECT key AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1), t2 AS (SELECT lower(key) AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1),
        t3 AS (SELECT {_NORM.format(x='key')} AS k, arg_min(value, ord) AS v FROM mapping GROUP BY 1)
        SELECT 'canonical' AS profile, engine, ord, mt AS matched_text, t1.v IS NULL AS is_default, mt || ';' || coalesce(t1.v, '4022-NA') AS final FROM b LEFT JOIN t1 ON mt = t1.k WHERE confidence >= 0.4::DOUBLE
        UNION ALL SELECT 'classic', engine, ord, mt, false, coalesce(t1.v, t2.v, t3.v) FROM b LEFT JOIN t1 ON mt = t1.k LEFT JOIN t2 ON lower(mt) = t2.k LEFT JOIN t3 ON {_NORM.format(x='mt')} = t3.k WHERE engine = 'easyocr' AND confidence >= 0.7::DOUBLE AND coalesce(t1.v, t2.v, t3.v) IS NOT NULL""",
    "analysis_score": """WITH r AS (SELECT p_partkey, p_partkey % 2000 AS area, p_partkey * 45 % 360 AS angle, p_partkey % 100 AS contrast, p_partkey % 10 + 6 AS size, (p_partkey % 700) * (p_partkey % 600) >= 200000 AS oriented FROM part),
        c AS (SELECT *, least(1, 0.5::DOUBLE + CASE WHEN area > 1000 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN angle IN (0, 90, 180, 270) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contrast > 50 THEN 0.1::DOUBLE ELSE 0 END) AS confidence FROM r)
        SELECT p_partkey, oriented, round(confidence, 4) AS confidence, CASE WHEN angle = 0 AND size >= 10 AND confidence >= 0.7::DOUBLE THEN 'standard' ELSE
            concat_ws(',', CASE WHEN angle <> 0 THEN 'rotation_correction' END, CASE WHEN size < 10 THEN 'upscaling' END, CASE WHEN confidence < 0.7::DOUBLE THEN 'preprocessing_enhancement' END) END AS recommended FROM c""",
    # A box that touches counts. Neighbours of a band are taken one after another, by number and engine.
    "band_shrink": f"""WITH RECURSIVE b AS {BOXES}, o AS (SELECT image_id, x AS ox, y AS oy, w AS ow, h AS oh, row_number() OVER (PARTITION BY image_id ORDER BY ord, engine) AS k FROM b),
        a AS (SELECT *, x + w // 2 + 10 AS sx, least(500, x + w) AS far, x + 5 AS bx, greatest(10, w // 2) AS bw FROM b),
        r AS (SELECT a.image_id, engine, ord, greatest(0, least(any_value(far), coalesce(min(CASE WHEN NOT (oy + oh < y OR oy > y + h) AND ox >= sx THEN ox - 2 END), 100000)) - any_value(sx)) AS safe_width FROM a JOIN o USING (image_id) GROUP BY ALL),
        f AS (
            SELECT image_id, engine, ord, y, bx, bw, 0::BIGINT AS k, y - 2 * h AS t, least(149, y + 3 * h) AS z FROM a
            UNION ALL
            SELECT f.image_id, engine, ord, y, bx, bw, o.k, CASE WHEN NOT (ox + ow < bx OR ox > bx + bw) AND oy <= z AND oy + oh >= t AND oy < y THEN greatest(t, oy + oh + 2) ELSE t END,
                   CASE WHEN NOT (ox + ow < bx OR ox > bx + bw) AND oy <= z AND oy + oh >= t AND oy >= y THEN least(z, oy - 2) ELSE z END
            FROM f JOIN o ON o.image_id = f.image_id AND o.k = f.k + 1)
        SELECT r.*, t AS safe_top, greatest(0, z - t) AS safe_height FROM r JOIN (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY image_id, engine, ord)) USING (image_id, engine, ord)""",
    "variant_pick": f"SELECT image_id, (ord % 3)::INT AS variant, round(avg(confidence), 5) AS mean_confidence, count(*) AS n FROM {BOXES} GROUP BY image_id, ord % 3 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY avg(confidence) DESC, ord % 3) = 1",
    "orientation_score": f"""SELECT image_id, ((ord % 4) * 90)::INT AS angle, round(greatest(count(*) * 10 + avg(confidence) * 50 + least(sum(length(text)) * 0.1::DOUBLE, 20) + 5 * count(*) FILTER (WHERE confidence > 0.8) - 2 * count(*) FILTER (WHERE confidence < 0.3), 0), 4) AS score FROM {BOXES} GROUP BY 1, 2""",
    "orientation_vote": f"""WITH a AS (SELECT image_id, (ord * 47) % 360 AS g FROM {BOXES}), q AS (SELECT image_id, CASE WHEN g <= 45 THEN 0 WHEN g <= 135 THEN 90 WHEN g <= 225 THEN 180 WHEN g < 315 THEN 270 ELSE 0 END AS turn FROM a)
        SELECT image_id, turn FROM q GROUP BY image_id, turn QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, turn) = 1""",
    "strategy_select": """WITH q AS (SELECT p_partkey, p_partkey % 10 / 10.0 AS contrast, p_partkey * 7 % 300 AS noise, p_partkey * 3 % 90 AS sharpness, p_partkey * 11 % 255 AS brightness FROM part)
        SELECT p_partkey, concat_ws(',', CASE WHEN contrast < 0.3 THEN 'contrast' END, CASE WHEN noise > 200 THEN 'denoise' END, CASE WHEN sharpness < 30 THEN 'sharpen' END, 'rotate', CASE WHEN brightness < 80 THEN 'brighten' END, CASE WHEN brightness > 200 THEN 'darken' END, 'standard') AS strategies FROM q""",
    "quality_bands": """WITH q AS (SELECT p_partkey, p_partkey * 11 % 255 AS brightness, p_partkey * 7 % 90 AS contrast, p_partkey * 3 % 300 AS sharpness, p_partkey % 40 / 1000.0 AS edges FROM part),
        i AS (SELECT p_partkey, concat_ws(', ', CASE WHEN brightness < 50 THEN 'Too dark' WHEN brightness > 200 THEN 'Too bright' END, CASE WHEN contrast < 30 THEN 'Low contrast' END, CASE WHEN sharpness < 100 THEN 'Blurry/Low sharpness' END, CASE WHEN edges < 0.01 THEN 'Very few edges (may not contain text)' END) AS issues FROM q)
        SELECT p_partkey, CASE WHEN issues = '' THEN 'Good quality for OCR' ELSE 'Issues: ' || issues END AS quality FROM i""",
    "box_format": f"SELECT engine, ord, format('x={{}}, y={{}}, w={{}}, h={{}}', x, y, w, h) AS named, format('({{}},{{}})-({{}},{{}})', x, y, x + w, y + h) AS corners, format('{{}},{{}},{{}},{{}}', x, y, x + w, y + h) AS plain FROM {BOXES}",
    "reconstruction": f"SELECT engine, ord, CASE WHEN h < 20 THEN 12 WHEN h < 40 THEN 16 ELSE 20 END AS font_size, CASE WHEN length(text) <= 30 THEN 1 ELSE 2 END AS num_lines, greatest(w + 20, 100) AS width, h * CASE WHEN length(text) <= 30 THEN 1 ELSE 2 END + 20 AS height FROM {BOXES}",
    "top_images": f"""SELECT image_id, round((100 * count(*) FILTER (WHERE w > 80) + 50 * count(*) FILTER (WHERE h > 16) + 10 * count(*) FILTER (WHERE x < 50) + 1000 * max(confidence))::DOUBLE, 4) AS score FROM {BOXES} GROUP BY image_id ORDER BY 2 DESC, 1 LIMIT 10""",
    "doc_stats": f"""SELECT doc_type, count(*) AS documents, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed, sum(matches)::BIGINT AS total_matches, round(count(*) FILTER (WHERE success) * 100.0 / count(*), 4) AS success_rate,
        round(avg(millis) FILTER (WHERE success), 4) AS mean_millis FROM {RESULTS} GROUP BY 1""",
    "batch_report": f"""SELECT batch, count(*) AS documents, sum(matches)::BIGINT AS total_matches, max(memory_mb) AS peak_memory_mb, max(cpu) AS peak_cpu, max(millis) AS longest_millis, round(avg(size_before) / 1048576, 4) AS mean_mb, round(coalesce(count(*) / nullif(sum(millis) / 1000, 0), 0), 4) AS throughput,
        round(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 4) AS success_rate, round(sum(size_before) / 1048576, 4) AS input_mb, round(sum(size_after) / 1048576, 4) AS output_mb, round(avg(size_after) / 1048576, 4) AS mean_output_mb,
        round((sum(size_after) - sum(size_before)) * 100.0::DOUBLE / sum(size_before), 4) AS size_change_percent, count(*) FILTER (WHERE matches > 50 OR NOT success OR abs((size_after - size_before) * 100.0::DOUBLE / size_before) > 20) AS review_documents,
        round(count(*) FILTER (WHERE matches > 50 OR NOT success OR abs((size_after - size_before) * 100.0::DOUBLE / size_before) > 20) * 100.0::DOUBLE / count(*), 4) AS review_percent, round(avg(matches), 4) AS mean_matches FROM {RESULTS} GROUP BY 1""",
    "activity_shares": "SELECT batch, "
    + ", ".join(f"coalesce(sum(matches) FILTER (WHERE processor = '{k}'), 0)::BIGINT AS {k}_matches, round(coalesce(sum(matches) FILTER (WHERE processor = '{k}'), 0) / count(*)::DOUBLE, 4) AS {k}_mean, round(coalesce(sum(matches) FILTER (WHERE processor = '{k}'), 0) * 100.0::DOUBLE / sum(matches), 4) AS {k}_percent" for k in ("click", "view", "purchase"))
    + f" FROM {RESULTS} GROUP BY 1",
    "corner_boxes": f"""SELECT engine, ord, CASE WHEN ord % 3 = 0 THEN x ELSE trunc(x + 0.4::DOUBLE) END::INT AS x, y, CASE WHEN ord % 3 = 0 THEN trunc(x + w + 0.6::DOUBLE - x) ELSE trunc(x + w + 0.6::DOUBLE - (x + 0.4::DOUBLE)) END::INT AS w,
        CASE WHEN ord % 3 = 0 THEN trunc(y + h + 0.3::DOUBLE - y) ELSE trunc(y + h + 0.3::DOUBLE - (y + 0.2::DOUBLE)) END::INT AS h FROM {BOXES} WHERE ord % 3 = 0 OR ord % 10 <> 1""",
    "detection_rows": f"""{_with(_TIERS)}, n AS (SELECT 'Graphics' AS processor, box_id AS doc_id, 'textbox_' || box_id AS location, {inputs.tag("box_id")} AS mt, family AS font_family, size AS font_size, -1::DOUBLE AS confidence, -1 AS x, -1 AS y, -1 AS w, -1 AS h FROM {TEXTBOXES}
            UNION ALL SELECT 'Image', image_id, 'image_' || image_id, {inputs.tag("ord")}, NULL, -1, confidence, x, y, w, h FROM {BOXES})
        SELECT 'Text' AS processor, unit_id AS doc_id, 'paragraph_0' AS location, matched_text, replacement, start_pos, end_pos, NULL::VARCHAR AS font_family, -1::DOUBLE AS font_size, -1::DOUBLE AS confidence, -1 AS x, -1 AS y, -1 AS w, -1 AS h FROM found
        UNION ALL SELECT processor, doc_id, location, mt, coalesce(t1.v, t2.v, t3.v), -1, -1, font_family, font_size, confidence, x, y, w, h FROM n LEFT JOIN t1 ON mt = t1.k LEFT JOIN t2 ON lower(mt) = t2.k LEFT JOIN t3 ON {_NORM.format(x='mt')} = t3.k""",
    "activity_by_type": f"""SELECT coalesce(doc_type, 'all') AS doc_type, coalesce(processor, 'all') AS processor, count(*) AS documents, sum(matches)::BIGINT AS matches, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS share FROM {RESULTS} GROUP BY ROLLUP (doc_type, processor)""",
    "review_files": f"""SELECT event_id, reasons FROM (SELECT event_id, concat_ws(',', CASE WHEN matches > 50 THEN 'high_matches' END, CASE WHEN NOT success THEN 'failed' END, CASE WHEN abs((size_after - size_before) * 100.0::DOUBLE / size_before) > 20 THEN 'size_change' END) AS reasons FROM {RESULTS}) WHERE reasons <> ''""",
    "error_summary": f"""WITH r AS (SELECT event_id AS ord, user_id % 20 AS batch, ['ValueError', 'OSError', 'MemoryError', 'ImportError', 'KeyError', 'PermissionError'][(event_id % 6) + 1] AS t, ['could not parse', 'conversion failed', 'out of memory', 'bad value', 'connection lost', 'invalid mapping', 'denied'][(event_id % 7) + 1] AS m FROM events),
        e AS (SELECT *, {_CATEGORY} AS category, {_SEVERITY} AS severity FROM r),
        c AS (SELECT batch, category FROM e GROUP BY batch, category QUALIFY row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, min(ord)) = 1), s AS (SELECT batch, severity FROM e GROUP BY batch, severity QUALIFY row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, min(ord)) = 1)
        SELECT batch, count(*) AS total_errors, round(count(*) FILTER (WHERE ord % 4 = 0) * 100.0 / count(*), 4) AS fallback_percent, any_value(c.category) AS most_common_category, any_value(s.severity) AS most_common_severity FROM e JOIN c USING (batch) JOIN s USING (batch) GROUP BY batch""",
    "sr_no": f"SELECT batch, event_id, row_number() OVER (PARTITION BY batch ORDER BY processor, event_id)::INT AS sr_no FROM {RESULTS}",
    "perf_indicators": f"""SELECT batch, max(memory_mb) AS peak_memory_mb, round(avg(memory_mb), 4) AS mean_memory_mb, round((max(memory_mb) * 0.7 + arg_max(memory_mb, event_id) * 0.3)::DOUBLE, 4) AS blended_memory_mb, max(cpu) AS peak_cpu, round(count(*) FILTER (WHERE success) * 100.0 / count(*), 4) AS success_rate,
        round(coalesce(count(*) / nullif(sum(millis) / 1000, 0), 0), 4) AS files_per_second, round(sum(size_before + size_after)::DOUBLE / count(*), 4) AS bytes_per_file FROM {RESULTS} GROUP BY 1""",
    "recent_samples": f"SELECT batch, event_id FROM {RESULTS} QUALIFY row_number() OVER (PARTITION BY batch ORDER BY event_id DESC) <= 5",
    "union_matches": f"{_with()}, u AS (SELECT 'text' AS kind, matched_text AS value FROM hits UNION ALL SELECT engine, text FROM {BOXES}) SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM u GROUP BY kind",
    "metadata_leaves": f"""SELECT event_id, t.fullkey AS path, CASE WHEN t.type = 'NULL' THEN 'null' WHEN t.type = 'OBJECT' THEN 'object' WHEN t.type = 'ARRAY' THEN 'array' WHEN t.type = 'VARCHAR' THEN 'text' WHEN t.type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind,
            CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' WHEN t.type <> 'NULL' THEN t.value::VARCHAR END AS value
        FROM {duck(inputs.METADATA)} m, json_tree(m.metadata::JSON) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('{{}}', '[]')""",
    "reports_by_document": f"""{_with(_TIERS)} SELECT unit_id, CASE WHEN unit_id % 2 = 0 THEN 'second' ELSE 'first' END AS run, (row_number() OVER (PARTITION BY unit_id ORDER BY start_pos) - 1)::INT AS pos, start_pos, matched_text,
        CASE WHEN unit_id % 2 = 0 THEN coalesce(replacement, '4022-NA') ELSE replacement END AS replacement FROM found""",
    "json_report": f"""SELECT event_id, '{{"event_id":' || event_id || ',"doc_type":"' || doc_type || '","matches":' || matches || ',"success":' || CASE WHEN success THEN 'true' ELSE 'false' END || '}}' AS report FROM {RESULTS}""",
    "docx_scan": f"""WITH t AS {ARCHIVED}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM t), w AS (SELECT path, p, unnest(string_split(line, ' ')) AS word, unnest(range(0, len(string_split(line, ' ')))) AS i FROM l)
        SELECT path, 'paragraph_' || p AS location, i::INT AS run_idx, CASE WHEN i = 0 THEN word ELSE ' ' || word END AS text FROM w""",
    "docx_tables": f"""WITH l AS {_LINES} SELECT path, 0 AS row_idx, 0 AS cell_idx, false AS merged, l[1] AS text FROM l UNION ALL SELECT path, 0, 1, false, l[len(l)] FROM l UNION ALL SELECT path, 1, 0, true, l[1] FROM l UNION ALL SELECT path, 1, 1, false, len(l)::VARCHAR FROM l""",
    "docx_headers": f"WITH l AS {_LINES} SELECT path, 'header1_paragraph_0' AS location, l[1] AS text FROM l",
    "docx_textboxes": f"""WITH l AS {_LINES}, b AS (SELECT path, len(l) AS n, array_to_string(list_filter([l[1], l[len(l)]], lambda x: regexp_matches(x, '[^[:space:]]')), chr(10)) AS text FROM l)
        SELECT path, 'textbox_0' AS location, text, (100 + n)::DOUBLE AS width, 50::DOUBLE AS height, true AS has_dimensions, false AS estimated FROM b""",
    "docx_shapes": f"""WITH l AS {_LINES}, b AS (SELECT path, len(l) AS n, l[1] AS first, array_to_string(list_filter([l[1], l[len(l)]], lambda x: regexp_matches(x, '[^[:space:]]')), chr(10)) AS pair FROM l),
        one AS (SELECT path, CASE WHEN regexp_matches(first, '[^[:space:]]') THEN first ELSE '' END AS t FROM b)
        SELECT path, 'textbox_0' AS location, pair AS text, (80 + n)::DOUBLE AS width, 40::DOUBLE AS height, true AS has_dimensions, false AS estimated FROM b
        UNION ALL SELECT path, 'textbox_1', t, 70.5, 30, true, false FROM one
        UNION ALL SELECT path, 'textbox_2', pair, 6.0 * list_max(list_transform(string_split(pair, chr(10)), lambda x: length(x))), 12.0 * len(string_split(pair, chr(10))), pair <> '', true FROM b""",
    "docx_images": f"""WITH l AS {_LINES} SELECT path, 'image_0' AS location, 'media/image1.png' AS name, 'png' AS extension, len(l)::BIGINT AS length, '' AS problem FROM l UNION ALL SELECT path, 'image_1', 'media/absent.jpeg', 'jpeg', -1, 'missing part' FROM l""",
    "docx_properties": f"WITH t AS {ARCHIVED} SELECT path, len(string_split(text, chr(10)))::INT AS pages, len(string_split(text, ' '))::INT AS words, 'Writer' AS application FROM t",
    "docx_parsers": """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 0 OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'lenient' ELSE 'standard' END AS parser FROM documents""",
    "stream_detect": f"{_with()} SELECT unit_id, pattern_name, matched_text, start_pos, end_pos FROM hits",
    "docx_by_size": f"""SELECT path, size_class, CASE WHEN size_class = 'unsupported_size' THEN NULL WHEN n % 10 = 0 THEN 'custom' ELSE size_class END AS parser, CASE WHEN size_class = 'unsupported_size' THEN 'unsupported size' ELSE '' END AS problem,
            CASE WHEN size_class = 'unsupported_size' THEN 0 ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS n_runs
        FROM (SELECT *, path::BIGINT AS n, CASE WHEN path::BIGINT * 37 % 600 > 500 THEN 'unsupported_size' WHEN path::BIGINT * 37 % 600 < 100 THEN 'standard' WHEN path::BIGINT * 37 % 600 < 200 THEN 'enhanced' ELSE 'custom' END AS size_class FROM {ARCHIVED})""",
    "docx_fallbacks": f"""SELECT path, CASE WHEN n % 7 = 0 THEN 4 WHEN n % 10 = 0 THEN 3 ELSE 1 END AS tries, CASE WHEN n % 7 = 0 THEN 'name_only' WHEN n % 10 = 0 THEN 'without_forbidden' ELSE 'primary' END AS strategy, n % 7 = 0 OR n % 10 = 0 AS fallback_used,
            CASE WHEN n % 7 = 0 THEN 'BadZipFile' WHEN n % 10 = 0 THEN 'ParseError' ELSE '' END AS error_type, CASE WHEN n % 7 = 0 THEN 10 WHEN n % 10 = 0 THEN length(text) + 1 ELSE length(text) END::INT AS n_chars
        FROM (SELECT *, path::BIGINT AS n FROM {ARCHIVED})""",
    "fallback_summary": f"""WITH e AS (SELECT doc_id AS ord, doc_id % 10 AS batch, CASE WHEN doc_id % 7 = 0 THEN 'processing' ELSE 'validation' END AS category FROM documents WHERE doc_id % 7 = 0 OR doc_id % 10 = 0)
        SELECT batch, sum(n)::BIGINT AS total_errors, 100.0::DOUBLE AS fallback_percent, arg_max(category, n * 1000000000 - first) AS most_common_category, 'low' AS most_common_severity FROM (SELECT batch, category, count(*) AS n, min(ord) AS first FROM e GROUP BY ALL) GROUP BY batch""",
    "routed_files": f"SELECT file_id, CASE ext WHEN '.docx' THEN stem ELSE upper(stem) END AS stem, CASE ext WHEN '.docx' THEN 0 ELSE length(stem) END::INT AS n, CASE ext WHEN '.docx' THEN 'word' ELSE 'any' END AS processor FROM {FILES} WHERE ext IN ('.docx', '.doc')",
    "stream_fresh": "SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id % 3000",
    "stream_intake": "SELECT o_orderstatus AS status, count(*) AS n_orders FROM orders GROUP BY 1",
    "stream_windows": """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n FROM w WHERE s + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "wrap_lines": f"""WITH RECURSIVE {_wrapped(f"SELECT box_id, text, max_cpl AS width FROM (SELECT box_id, text, {_classic('size')} FROM {TEXTBOXES})", 'box_id')}
        SELECT box_id, len(lines)::INT AS required_lines, list_max(list_transform(lines, lambda x: length(x)))::INT AS max_line_length, array_to_string(lines, chr(10)) AS wrapped FROM wrapped""",
    "optimal_size": f"WITH RECURSIVE {_optimal('6.0::DOUBLE')} SELECT box_id, round(optimal_size, 4) AS optimal_size FROM optimal",
    "overflow_handler": f"""WITH RECURSIVE {_optimal('greatest(8.0::DOUBLE, size * 0.7::DOUBLE)')} SELECT box_id, round(CASE WHEN abs(optimal_size - size) > 0.1 THEN optimal_size ELSE size END, 4) AS new_size, abs(optimal_size - size) > 0.1 AS adjusted FROM optimal""",
    "guided_capacity": f"""WITH t AS (SELECT box_id, floor(width) AS width, floor(height) AS height, family, size FROM {TEXTBOXES}), c AS (SELECT *, {_capacity()} FROM t),
        g AS (SELECT *, {_GUIDE_FAMILIES} AS known, CASE WHEN height < 25 THEN 15 WHEN height < 40 THEN 25 WHEN height < 60 THEN 40 ELSE 60 END AS gh, CASE WHEN width < 130 THEN 80 WHEN width < 200 THEN 130 ELSE 200 END AS gw FROM c),
        m AS (SELECT *, CASE WHEN known THEN floor(gh * 2 / (size * 2 * 1.5::DOUBLE))::INT END AS gl, CASE WHEN known THEN floor(gw * 4 / (size * 2))::INT END AS gc FROM g)
        SELECT box_id, coalesce(gl, -1) AS guide_lines, coalesce(gc, -1) AS guide_cpl, CASE WHEN NOT known THEN 'No font guidelines available' ELSE 'Height: ' || CASE WHEN height IN (15, 25, 40, 60) THEN 'exact match' ELSE 'interpolated' END || '; Width: ' || CASE WHEN width IN (80, 130, 200) THEN 'exact match' ELSE 'interpolated' END END AS guide_details,
               least(lines, gl) AS lines_minimum, coalesce(gl, lines) AS lines_replace, least(cpl, gc) AS cpl_minimum, coalesce(gc, cpl) AS cpl_replace FROM m""",
    "size_reasoning": f"""WITH t AS (SELECT *, text || ';4022-NA' AS new, floor(size * 2 * 0.9::DOUBLE) / 2 AS half FROM {TEXTBOXES}), c AS (SELECT *, {_capacity('half')} FROM t)
        SELECT box_id, length(text) AS orig_total_char, 1 AS orig_total_lines, length(new) AS new_total_char, CASE WHEN has_dimensions AND cpl > 0 THEN greatest(1, ceil(length(new) / cpl))::INT ELSE 1 END AS new_total_lines,
               CASE WHEN NOT has_dimensions THEN 'No Dimensions' WHEN lines * cpl <= 0 THEN 'Unknown' ELSE printf('%.0f', length(new)::DOUBLE / (lines * cpl) * 100) || CASE WHEN length(new) > lines * cpl THEN '% Over' ELSE '% Fit' END END AS new_size_fit_percent,
               printf('%.0f', (size - half) / size * 100) || '% Font Reduction' AS reduction_percent, printf('%.1f', size) || ' -> ' || printf('%.1f', half) AS new_size_change,
               CASE WHEN {_GUIDE_FAMILIES} THEN 'Height: interpolated; Width: interpolated' ELSE 'No font guidelines available' END AS interpolation_details FROM c""",
    "best_font": f"""WITH r AS (SELECT *, CASE WHEN family <> 'Arial' THEN 2 ELSE 0 END + CASE WHEN size <> 12 THEN 2 ELSE 0 END AS score FROM {RUNS}), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, run_idx) = 1),
        d AS (SELECT unit_id, list(DISTINCT size) FILTER (WHERE size IS NOT NULL) AS sizes FROM r GROUP BY unit_id), e AS (SELECT unit_id, list_sort(coalesce(sizes, [])) AS sizes FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY run_idx) AS i, count(*) OVER (PARTITION BY unit_id) AS n FROM r),
        g AS (SELECT unit_id, max(n) AS n, string_agg('Seg' || i || ': ' || CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END || ' (' || printf('%.1f', coalesce(size, sizes[1])) || 'pt ' || coalesce(family, 'Unknown') || ')', ' | ' ORDER BY i) FILTER (WHERE i <= 5) AS segs FROM n JOIN e USING (unit_id) GROUP BY unit_id)
        SELECT unit_id, b.run_idx, coalesce(family, '-') AS family, coalesce(size, -1) AS size, coalesce(sizes[1], 12) AS baseline, CASE WHEN len(sizes) = 0 THEN '12.0pt' ELSE CASE WHEN len(sizes) = 1 THEN printf('%.1f', sizes[1]) || 'pt' ELSE 'Distinct sizes: ' || array_to_string(list_transform(sizes, lambda x: printf('%.1f', x) || 'pt'), ', ') END
            || ' | ' || segs || CASE WHEN n > 5 THEN ' | ... and ' || (n - 5) || ' more segments' ELSE '' END END AS description FROM b JOIN e USING (unit_id) JOIN g USING (unit_id)""",
    "normalize_fonts": f"""WITH r AS (SELECT *, CASE WHEN family <> 'Arial' THEN 2 ELSE 0 END + CASE WHEN size <> 12 THEN 2 ELSE 0 END AS score FROM {RUNS})
        SELECT unit_id, run_idx, text, coalesce(first_value(family) OVER (PARTITION BY unit_id ORDER BY score DESC, run_idx), 'Arial') AS family, coalesce(min(size) OVER (PARTITION BY unit_id), 12) AS size FROM r""",
    "classic_files": f"SELECT file_id, CASE WHEN stem LIKE '%\\_processed' ESCAPE '\\' THEN stem ELSE stem || '_processed' END AS output_stem FROM {FILES} WHERE NOT starts_with(stem || ext, '~$') AND length <= 100 * 1048576",
    "file_union": f"SELECT DISTINCT parent, stem, ext FROM {FILES} WHERE ext IN ('.doc', '.docx') OR length > 0",
    "dedupe_spans": f"""WITH corpus AS {CORPUS}, {_hits(False)}, n AS (SELECT unit_id, count(*) AS kept, count(*) FILTER (WHERE NOT (regexp_matches(substr(text, start_pos, 1), '[0-9]') AND start_pos > 0 AND NOT regexp_matches(substr(text, start_pos - 1, 1), '[0-9]'))) AS guarded FROM hits GROUP BY unit_id)
        SELECT unit_id, coalesce(kept + guarded, 0)::INT AS listed, coalesce(kept, 0)::INT AS kept FROM corpus LEFT JOIN n USING (unit_id)""",
    "newline_offsets": f"{_with()} SELECT unit_id, start_pos, (start_pos - (start_pos - length(replace(substr(text, 1, start_pos), ' ', ''))))::INT AS adjusted FROM hits",
    "self_test": f"""{_with()}, d AS (SELECT unit_id, list_sort(list(DISTINCT matched_text)) AS d FROM hits GROUP BY unit_id),
        e AS (SELECT o_orderkey AS unit_id, list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN {inputs.tag2(inputs._K)} ELSE {inputs.tag(inputs._K)} END, CASE WHEN o_orderkey % 3 = 0 THEN {inputs.tag("(o_orderkey * 3) % 2000 + 1")} END], lambda x: x IS NOT NULL))) AS e FROM orders)
        SELECT unit_id, array_to_string(coalesce(d, []), ',') AS detected, coalesce(d, []) = e AS passed FROM e LEFT JOIN d USING (unit_id)""",
    "progress_ticks": f"SELECT batch, event_id FROM {RESULTS} QUALIFY row_number() OVER (PARTITION BY batch ORDER BY event_id) % 60 = 0",
    "worker_stats": f"""WITH s AS (SELECT batch, millis, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS processed, CASE WHEN event_id % 5 <> 0 AND success THEN 1 ELSE 0 END AS good FROM {RESULTS}),
        a AS (SELECT batch, count(*) AS total_files, sum(good)::BIGINT AS completed_files, sum(processed - good)::BIGINT AS failed_files, sum(processed)::BIGINT AS processed_files, coalesce(sum(millis) FILTER (WHERE processed = 1), 0) / 1000 AS secs FROM s GROUP BY batch)
        SELECT batch, total_files, completed_files, failed_files, processed_files, round(processed_files * 100.0 / total_files, 4) AS progress_percentage, round(secs, 4) AS elapsed_seconds, round(coalesce(secs / nullif(processed_files, 0), 0) * (total_files - processed_files), 4) AS remaining_seconds FROM a""",
    "processor_stats": f"""WITH p AS (SELECT processor, count(*) AS n, count(*) FILTER (WHERE NOT success) AS e, min(millis) FILTER (WHERE event_id % 3 = 0) AS i FROM {RESULTS} GROUP BY processor)
        SELECT count(*) AS total_processors, count(i) AS initialized_processors, round(count(i) * 100.0 / count(*), 4) AS initialization_rate, sum(n)::BIGINT AS total_usage_count, sum(e)::BIGINT AS total_error_count, round(sum(e) * 100.0::DOUBLE / sum(n), 4) AS error_rate, round(sum(i) / 1000 / count(i), 4) AS average_initialization_time FROM p""",
    "processor_matches": f"""{_with(_TIERS)}, n AS (
            SELECT 'Graphics' AS processor, box_id AS doc_id, CASE WHEN box_id % 4 = 0 THEN '77-000-Z' || lpad(box_id::VARCHAR, 6, '0') || '-00' ELSE {inputs.tag("box_id")} END AS mt FROM {TEXTBOXES}
            UNION ALL SELECT 'Image', image_id, CASE WHEN ord % 4 = 0 THEN '77-000-Z' || lpad(ord::VARCHAR, 6, '0') || '-00' ELSE {inputs.tag("ord")} END FROM {BOXES}),
        m AS (SELECT processor, doc_id, coalesce(t1.v, t2.v, t3.v) AS v FROM n LEFT JOIN t1 ON mt = t1.k LEFT JOIN t2 ON lower(mt) = t2.k LEFT JOIN t3 ON {_NORM.format(x='mt')} = t3.k UNION ALL SELECT 'Text', unit_id, replacement FROM found)
        SELECT processor, count(DISTINCT doc_id) AS documents, count(*) AS detections, count(v) AS matches, CASE WHEN processor = 'Text' THEN 0 ELSE count(*) - count(v) END AS no_match FROM m GROUP BY processor""",
    "detection_status": """WITH f AS (SELECT o_orderkey % 97 AS doc, o_orderkey AS ord, o_orderkey % 11 AS place, o_custkey % 53 AS txt, o_orderkey % 1000 AS pos FROM orders), first AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, place, txt ORDER BY ord) = 1),
        done AS (SELECT doc, place, txt, pos, max(ord) % 3 = 0 AS ok FROM f GROUP BY ALL)
        SELECT c_custkey AS detail_id, coalesce(ok, false) AS reconstructed FROM customer LEFT JOIN first ON doc = c_custkey % 97 AND place = c_custkey % 11 AND txt = c_custkey * 7 % 53 LEFT JOIN done ON done.doc = first.doc AND done.place = first.place AND done.txt = first.txt AND done.pos = first.pos""",
    "processing_log": f"SELECT count(*) AS total_processed, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed, sum(matches)::BIGINT AS total_matches FROM {RESULTS}",
}
ORACLES["report_round_trip"], ORACLES["size_check_csv"] = ORACLES["batch_report"], ORACLES["size_grid"]
ORACLES["debug_dump"] = f"SELECT * FROM ({ORACLES['match_debug']}) JOIN ({ORACLES['self_test']}) USING (unit_id)"
ORACLES["detect_compiled"] = ORACLES["detect_all"]
ORACLES["listed_files"] = "SELECT o_orderstatus AS status, '.json' AS ext, 'unsupported extension' AS reason, count(*) AS n_lines, true AS filled FROM orders GROUP BY 1"
