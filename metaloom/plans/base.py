"""SQL that several oracles share."""

from __future__ import annotations

BL = "E' \\t\\n\\r\\x0b\\x0c'"


def sid(c: str) -> str:
    """An id without blanks around it and in lower case; null if blank."""
    return f"nullif(lower(trim({c}, {BL})), '')"


def doc(c: str) -> str:
    """A complete JSON document, unwrapped from a JSON string; else null."""
    return f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN CASE WHEN json_valid({c} ->> '$') THEN {c} ->> '$' END ELSE {c} END END"


#: (asset_id, pos, c JSON): the columns of assets.
COLS = f"""
j0 AS (SELECT id, {doc('columns')} AS j FROM assets),
j1 AS (SELECT id, CASE WHEN json_type(j) = 'OBJECT' THEN '[' || j || ']' WHEN json_type(j) = 'ARRAY' THEN j END AS j FROM j0),
cols AS (SELECT id AS asset_id, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS pos, unnest(json_extract(j, '$[*]')) AS c FROM j1 WHERE j IS NOT NULL AND json_array_length(j) > 0)
"""
#: Scans with a comparable asset_id.
SCANS = f"sc AS (SELECT * REPLACE ({sid('asset_id')} AS asset_id) FROM data_discovery)"
