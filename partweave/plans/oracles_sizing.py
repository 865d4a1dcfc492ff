"""DuckDB SQL of the density table and the searches over it, with constants of its own."""

from __future__ import annotations

from partweave.plans.inputs import duck
from partweave.plans.sizing import KNOWN_BOXES

_BY_FAMILY = lambda arial, times, ming, other: f"CASE lower(family) WHEN 'arial' THEN {arial}::DOUBLE WHEN 'times new roman' THEN {times}::DOUBLE WHEN 'pmingliu' THEN {ming}::DOUBLE ELSE {other}::DOUBLE END"
_WIDE, _TALL, _SAFE, _HEAD = _BY_FAMILY(0.58, 0.53, 0.58, 0.6), _BY_FAMILY(1.18, 1.25, 1.10, 1.25), _BY_FAMILY(0.12, 0.12, 0.18, 0.15), _BY_FAMILY(0.96, 0.96, 0.92, 0.96)

_TABLE = f"""
    t AS {duck(KNOWN_BOXES)},
    rules AS (SELECT 'arial' AS fam, box, k, bw::DOUBLE AS bw, bh::DOUBLE AS bh, low::DOUBLE AS low, high::DOUBLE AS high, lines, cpl FROM (VALUES
        (0, 0, 116.4, 31.2, 7.5, 11.0, 2, 20), (0, 1, 116.4, 31.2, 7.0, 7.0, 3, 22), (0, 2, 116.4, 31.2, 11.5, 14.0, 1, 16), (1, 0, 180.6, 35.6, 9.0, 9.0, 2, 34), (1, 1, 180.6, 35.6, 8.5, 8.5, 3, 36),
        (1, 2, 180.6, 35.6, 8.0, 8.0, 3, 40), (2, 0, 119.5, 31.2, 8.0, 8.0, 2, 22), (3, 0, 155.3, 21.8, 6.0, 6.0, 2, 45), (3, 1, 155.3, 21.8, 5.0, 5.0, 3, 50)) v(box, k, bw, bh, low, high, lines, cpl)),
    sizes AS (SELECT unnest([12, 11, 10, 9, 8, 7, 6])::DOUBLE AS s),
    near AS (
        SELECT *, round(width, 1) = bw AND round(height, 1) = bh AS same, greatest(width * height / (bw * bh), bw * bh / (width * height)) AS ratio
        FROM t JOIN (SELECT DISTINCT fam, box, bw, bh FROM rules) ON lower(family) = fam QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY same DESC, ratio, box) = 1),
    ruled AS (
        SELECT box_id, same, width, height, bw, bh, s, arg_max(lines, k) AS lines, arg_max(cpl, k) AS cpl
        FROM (SELECT n.*, r.k, r.lines, r.cpl, unnest(CASE WHEN low = high THEN [low] ELSE list_filter([12, 11, 10, 9, 8, 7, 6]::DOUBLE[], lambda x: x BETWEEN low AND high) END) AS s FROM near n JOIN rules r ON r.box = n.box WHERE same OR ratio < 2)
        GROUP BY ALL),
    by_rule AS (
        SELECT box_id, s, (CASE WHEN same THEN lines ELSE greatest(1, trunc(lines * (height / bh))::INT) END * CASE WHEN same THEN cpl ELSE greatest(1, trunc(cpl * (width / bw))::INT) END) / (width * 0.0352778::DOUBLE * (height * 0.0352778::DOUBLE)) AS per,
               CASE WHEN same THEN 'exact' ELSE 'scaled' END AS source FROM ruled),
    computed AS (
        SELECT box_id, s, trunc(width * 0.0352778::DOUBLE / (s * ({_WIDE}) * 0.0352778::DOUBLE)) * trunc(height * 0.0352778::DOUBLE / (s * ({_TALL}) * 0.0352778::DOUBLE)) / (width * 0.0352778::DOUBLE * (height * 0.0352778::DOUBLE)) AS per, 'computed' AS source
        FROM t, sizes WHERE box_id NOT IN (SELECT box_id FROM by_rule)),
    dense AS (SELECT * FROM by_rule UNION ALL SELECT * FROM computed)"""

_FITS = """(cpl > 0 AND lines > 0 AND coalesce(NOT (longest > most_cpl OR need > most_lines), true) AND CASE WHEN need > need_before AND NOT spare AND lines > 1 THEN need < lines ELSE need <= lines END
        AND chars <= trunc(greatest(all_cpl * all_lines, 0) * head))"""
_WRAP = lambda text, cpl: f"list_sum(list_transform(string_split({text}, chr(10)), lambda x: greatest(1, ceil(length(x) / greatest({cpl}, 1)::DOUBLE)::INT)))"

ORACLES = {
    "density_table": f"WITH {_TABLE} SELECT box_id, s AS font_size, round(per, 6) AS per_cm2, source FROM dense",
    "own_size_fit": f"""WITH {_TABLE},
        own AS (SELECT *, CASE box_id % 3 WHEN 1 THEN [size, 12, 9]::DOUBLE[] WHEN 2 THEN [7, floor(size)]::DOUBLE[] ELSE []::DOUBLE[] END AS o FROM t),
        tries AS (
            SELECT box_id, text, has_dimensions, width, height, 0 AS turn, unnest(o) AS s FROM own
            UNION ALL SELECT box_id, text, has_dimensions, width, height, 1, unnest(range(6, trunc(coalesce(list_min(o), size))::INT + 1))::DOUBLE FROM own),
        won AS (SELECT box_id, s FROM tries JOIN dense USING (box_id, s) WHERE per > 0 AND length(text) / per * 1.2::DOUBLE <= CASE WHEN has_dimensions THEN width * 0.0352778::DOUBLE * (height * 0.0352778::DOUBLE) ELSE 4 END
            QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY turn, s DESC) = 1)
        SELECT box_id, coalesce(s, 6)::DOUBLE AS fit_size FROM t LEFT JOIN won USING (box_id)""",
    "reconstruction_fit": f"""WITH {_TABLE},
        b AS (SELECT *, CASE WHEN box_id % 2 = 0 THEN replace(text, ' ', chr(10)) ELSE text END AS before, {_WIDE} AS wide, {_TALL} AS tall, {_SAFE} AS safe, {_HEAD} AS head FROM t),
        base AS (SELECT *, before || ';4022-NA' AS after, floor(width / 72.0::DOUBLE * (1 - 0.2::DOUBLE) / (size * wide / 72.0::DOUBLE))::INT AS base_cpl, floor(height / 72.0::DOUBLE * (1 - 0.2::DOUBLE) / (size * tall / 72.0::DOUBLE))::INT AS base_lines FROM b),
        spared AS (SELECT *, base_cpl > 0 AND base_lines - {_WRAP('before', 'base_cpl')} >= 1 AS spare FROM base),
        half AS (SELECT *, unnest(range(10, (size * 2)::INT + 1)) / 2.0::DOUBLE AS s FROM spared),
        room AS (
            SELECT h.*, r.lines AS most_lines, r.cpl AS most_cpl, floor(width / 72.0::DOUBLE * (1 - safe) / (s * wide / 72.0::DOUBLE))::INT AS all_cpl, floor(height / 72.0::DOUBLE * (1 - safe) / (s * tall / 72.0::DOUBLE))::INT AS all_lines
            FROM half h LEFT JOIN rules r ON lower(family) = fam AND round(width, 1) = bw AND round(height, 1) = bh AND s BETWEEN low AND high
            QUALIFY row_number() OVER (PARTITION BY box_id, s ORDER BY k) = 1),
        text AS (SELECT *, after AS t FROM room UNION ALL SELECT *, replace(after, chr(10), ' ') FROM room WHERE contains(after, chr(10))),
        used AS (SELECT *, coalesce(most_lines, all_lines) AS lines, coalesce(most_cpl, all_cpl) AS cpl, length(replace(t, chr(10), '')) AS chars, list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS longest FROM text),
        need AS (SELECT *, {_WRAP('t', 'cpl')} AS need, {_WRAP('before', 'cpl')} AS need_before FROM used),
        fit AS (SELECT box_id, t, max(s) AS s FROM need WHERE {_FITS} GROUP BY box_id, t)
        SELECT box_id, CASE WHEN has_dimensions THEN coalesce(min(fit.s), 5) ELSE any_value(size) END::DOUBLE AS fit_size FROM b LEFT JOIN fit USING (box_id) GROUP BY box_id, has_dimensions""",
}
