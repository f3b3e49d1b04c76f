"""DuckDB's SQL for the llm queries that SQL can express."""

from __future__ import annotations

_BL = "E' \\t\\n\\r\\x0b\\x0c'"
#: Words and signs for not known, on their own (fixed values).
_WORDS = """'unknown', 'not known', 'none', 'null', 'nil', 'nan', 'n/a', 'na', 'n.a.', 'n/k', '#n/a', 'not available', 'not applicable', 'unavailable', 'missing', 'undefined',
'unspecified', 'not specified', 'not set', 'tbd', 'tba', 'tbc', 'to be determined', '-', '--', '---', '?', '??', '???', '.', '..', '...', '_', '*',
'<unknown>', '<null>', '(null)', '(none)', '(unknown)', '[null]', '\\n'"""
#: The empty content's digests are computed here, but for those DuckDB has no function for (fixed values).
_EMPTY = """md5(''), sha1(''), sha256(''), '00000000', '7f9c2ba4e88f827d616045507605853e', '7f9c2ba4e88f827d616045507605853ed73b8093f6efbc88eb1a6eacfa66ef26',
'd14a028c2a3a2bc9476102bb288234c415a2b01f828ea62ac5b3e42f', '38b060a751ac96384cd9327eb1b1e36a21fdb71114be07434c0cc7bf63f6e1da274edebfe76f65fb51ad2f14898b95b',
'cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e'"""


def _text(x: str) -> str:
    return f"CASE WHEN lower(trim({x}, {_BL})) NOT IN ({_WORDS}) THEN nullif(trim({x}, {_BL}), '') END"


def _size(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}, {_BL}), '\\+?[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?') AND TRY_CAST(trim({x}, {_BL}) AS DOUBLE) > 0 THEN CAST(CAST(floor(TRY_CAST(trim({x}, {_BL}) AS DOUBLE)) AS BIGINT) AS VARCHAR) END"


def _hash(x: str) -> str:
    v = f"lower({_text(x)})"
    return f"CASE WHEN {v} NOT IN ({_EMPTY}) AND replace({v}, left({v}, 1), '') <> '' THEN {v} END"


def _time(x: str) -> str:
    v = _text(x)
    return f"CASE WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ]|$)') AND TRY_CAST({v} AS TIMESTAMPTZ) BETWEEN TIMESTAMPTZ '2000-01-01 00:00:00+00' AND coalesce(CAST(seen AS TIMESTAMPTZ), TIMESTAMPTZ '9999-01-01 00:00:00+00') THEN {v} END"


_OBS = f"""
d AS (SELECT nullif(lower(trim(asset_id, {_BL})), '') AS asset_id, id, discovered_at AS seen,
        CASE WHEN json_valid(file_metadata) THEN CASE WHEN json_type(file_metadata) = 'VARCHAR' THEN CASE WHEN json_valid(file_metadata ->> '$') THEN (file_metadata ->> '$') END ELSE file_metadata END END AS j
      FROM data_discovery),
o AS (SELECT asset_id, id, seen,
        coalesce({_text("(j ->> '$.basic.name')")}, {_text("(j ->> '$.file_name')")}) AS name,
        coalesce({_size("(j ->> '$.basic.size_bytes')")}, {_size("(j ->> '$.size')")}) AS size_bytes,
        coalesce({_text("(j ->> '$.basic.format')")}, {_text("(j ->> '$.format')")}) AS format,
        coalesce({_hash("(j ->> '$.hash.value')")}, {_hash("(j ->> '$.file_hash')")}) AS hash,
        coalesce({_time("(j ->> '$.timestamps.last_modified')")}, {_time("(j ->> '$.last_modified')")}) AS last_modified
      FROM d WHERE asset_id IS NOT NULL),
v AS (UNPIVOT o ON name, size_bytes, format, hash, last_modified INTO NAME field_name VALUE value),
g AS (SELECT asset_id FROM o GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT asset_id, field_name, id AS discovery_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY asset_id, field_name ORDER BY seen DESC NULLS LAST, id DESC) AS k FROM v) WHERE k = 1 AND asset_id IN (SELECT asset_id FROM g)
      UNION ALL
      SELECT asset_id, 'record', id, CAST(n AS VARCHAR) FROM (
        SELECT asset_id, id, n, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, seen DESC NULLS LAST, id DESC) AS k FROM (
          SELECT asset_id, id, seen, (name IS NOT NULL)::INT + (size_bytes IS NOT NULL)::INT + (format IS NOT NULL)::INT + (hash IS NOT NULL)::INT + (last_modified IS NOT NULL)::INT AS n FROM o))
      WHERE k = 1 AND asset_id IN (SELECT asset_id FROM g))
"""

#: The learned order: (field_name, earlier, later, n_for, n_against).
_ORDER = """
m AS (SELECT field_name, value, lag(value) OVER (PARTITION BY asset_id, field_name ORDER BY seen, id) AS was FROM v WHERE seen IS NOT NULL),
p AS (SELECT field_name, least(was, value) AS a, greatest(was, value) AS z, count(*) FILTER (was < value) AS up, count(*) FILTER (was > value) AS down FROM m WHERE was <> value GROUP BY 1, 2, 3),
e AS (SELECT field_name, CASE WHEN up > down THEN a ELSE z END AS earlier, CASE WHEN up > down THEN z ELSE a END AS later, greatest(up, down) AS n_for, least(up, down) AS n_against FROM p WHERE up <> down)
"""
#: Groups with values that only rows without a time hold: the latest of the partial order, as l.
_PARTIAL = """
un AS (SELECT asset_id, field_name, value, max(id) AS id FROM v WHERE seen IS NULL GROUP BY ALL),
ti AS (SELECT asset_id, field_name, value, max((seen, id)) AS x FROM v WHERE seen IS NOT NULL GROUP BY ALL),
fr AS (SELECT * FROM un ANTI JOIN ti USING (asset_id, field_name, value)),
la AS (SELECT asset_id, field_name, arg_max(value, x) AS value, max(x)[2] AS id FROM ti SEMI JOIN fr USING (asset_id, field_name) GROUP BY ALL),
cand AS (SELECT *, false AS timed FROM fr UNION ALL SELECT *, true FROM la),
mem AS (SELECT asset_id, field_name, value, false AS to_timed FROM fr UNION ALL SELECT asset_id, field_name, value, true FROM ti SEMI JOIN fr USING (asset_id, field_name)),
src AS (SELECT DISTINCT field_name, value FROM mem),
rc AS (SELECT field_name, value, value AS at FROM src UNION SELECT rc.field_name, rc.value, e.later FROM rc JOIN e ON e.field_name = rc.field_name AND e.earlier = rc.at),
hit AS (SELECT c.asset_id, c.field_name, c.value, c.timed, t.value AS later, t.to_timed FROM cand c JOIN mem t USING (asset_id, field_name)
        WHERE c.value <> t.value AND NOT (c.timed AND t.to_timed)
          AND EXISTS (FROM rc WHERE rc.field_name = c.field_name AND rc.value = c.value AND rc.at = t.value)
          AND NOT EXISTS (FROM rc WHERE rc.field_name = c.field_name AND rc.value = t.value AND rc.at = c.value)),
bh AS (SELECT asset_id, field_name, value, bool_or(to_timed) AS behind FROM hit WHERE NOT timed GROUP BY ALL),
bt AS (SELECT asset_id, field_name, value FROM bh UNION
       SELECT h.asset_id, h.field_name, h.value FROM hit h LEFT JOIN bh ON bh.asset_id = h.asset_id AND bh.field_name = h.field_name AND bh.value = h.later WHERE h.timed AND NOT coalesce(bh.behind, false)),
l AS (SELECT asset_id, field_name, id, value FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.asset_id, c.field_name ORDER BY bt.value IS NULL DESC, c.timed DESC, c.id DESC, c.value DESC) AS k
        FROM cand c LEFT JOIN bt USING (asset_id, field_name, value)) WHERE k = 1)
"""
_UNDATED = _OBS.replace("discovered_at AS seen", "CASE WHEN created_at > discovered_at + INTERVAL 1 DAY THEN NULL ELSE discovered_at END AS seen")

_FIELDS = ("name", "size_bytes", "format", "hash", "last_modified")

SQL = {
    "p1_found": f"WITH {_OBS} SELECT asset_id, field_name, discovery_id FROM b",
    "p1_fused": f"WITH {_OBS} SELECT asset_id, max(discovery_id) FILTER (field_name = 'record') AS record_id, "
    + ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}, max(discovery_id) FILTER (field_name = '{f}') AS {f}_id" for f in _FIELDS)
    + " FROM b GROUP BY 1",
    "p1_precedence": f"WITH {_OBS}, {_ORDER} SELECT * FROM e",
    "p1_undated": f"""WITH RECURSIVE {_UNDATED}, {_ORDER}, {_PARTIAL}
SELECT b.asset_id, b.field_name, coalesce(l.id, b.discovery_id) AS discovery_id, coalesce(l.value, b.value) AS value FROM b LEFT JOIN l USING (asset_id, field_name)""",
}
