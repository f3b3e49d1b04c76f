"""The general training-data operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import drift, hierarchy, nested, snapshots
from metaloom.registry import Registry

R = Registry()

_BL = "E' \\t\\n\\r\\x0b\\x0c'"
_ID = "nullif(lower(trim({0}, " + _BL + ")), '')"


def sql_id(c: str) -> str:
    return _ID.format(c)


_STATES = f"""
r AS (SELECT snapshot_no, coalesce(delivery_no, -1) AS d, {sql_id('asset_id')} AS asset_id, loaded_at,
        coalesce(lower(trim(trim(storage_path, {_BL}), '/')), '') AS p, coalesce(lower(regexp_replace(schema_hash, '\\s+', '', 'g')), '') AS h
      FROM catalog_snapshots WHERE snapshot_no IS NOT NULL),
m AS (SELECT snapshot_no, max(d) AS d FROM r GROUP BY 1),
s AS (SELECT snapshot_no, asset_id, p, h, loaded_at FROM (
        SELECT r.*, row_number() OVER (PARTITION BY snapshot_no, asset_id ORDER BY loaded_at DESC NULLS LAST, p DESC, h DESC) AS k
        FROM r JOIN m USING (snapshot_no, d) WHERE asset_id IS NOT NULL) WHERE k = 1),
c AS (SELECT n.snapshot_no, n.asset_id, CASE WHEN o.asset_id IS NULL THEN 'added' WHEN o.p <> n.p OR o.h <> n.h THEN 'changed' END AS change_kind
      FROM s n LEFT JOIN s o ON o.asset_id = n.asset_id AND o.snapshot_no = n.snapshot_no - 1
      WHERE n.snapshot_no - 1 IN (SELECT snapshot_no FROM m)
      UNION ALL
      SELECT o.snapshot_no + 1, o.asset_id, 'removed' FROM s o LEFT JOIN s n ON n.asset_id = o.asset_id AND n.snapshot_no = o.snapshot_no + 1
      WHERE n.asset_id IS NULL AND o.snapshot_no + 1 IN (SELECT snapshot_no FROM m))
"""


@R.add("p2_found", f"WITH {_STATES} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, asset_id, change_kind FROM c WHERE change_kind IS NOT NULL")
def p2_found(t):
    return snapshots.snapshot_changes(t("catalog_snapshots"))


@R.add(
    "p2_states",
    f"WITH {_STATES} SELECT snapshot_no, asset_id, p AS path, h AS hash, loaded_at FROM s",
)
def p2_states(t):
    return snapshots.snapshot_states(t("catalog_snapshots"))


@R.add(
    "p2_summary",
    f"""WITH {_STATES} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, count(*) FILTER (change_kind = 'added') AS n_added,
    count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed
    FROM c WHERE change_kind IS NOT NULL GROUP BY 1""",
)
def p2_summary(t):
    return snapshots.snapshot_summary(t("catalog_snapshots"))


_TREE = f"""
e AS (SELECT DISTINCT {sql_id('source_asset_id')} AS p, {sql_id('target_asset_id')} AS c FROM lineage_relationships WHERE relationship_type = 'folder_hierarchy'),
l AS (SELECT min(p) AS p, c FROM e WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY c),
n AS (SELECT c AS id FROM l UNION SELECT p FROM l),
up AS (SELECT c AS id, p AS anc FROM l UNION SELECT up.id, l.p FROM up JOIN l ON l.c = up.anc),
ring AS (SELECT id FROM up WHERE id = anc),
ringroot AS (SELECT r.id, min(u.anc) AS root FROM ring r JOIN up u USING (id) WHERE u.anc IN (SELECT id FROM ring) GROUP BY 1),
cnt AS (SELECT anc AS id, count(DISTINCT id) FILTER (id <> anc) AS n FROM up GROUP BY 1),
w AS (SELECT id, id AS root, 0 AS depth, id AS path, 'tree' AS st FROM n WHERE id NOT IN (SELECT c FROM l)
      UNION ALL SELECT id, root, 0, '', 'cycle' FROM ringroot
      UNION ALL SELECT l.c, w.root, w.depth + 1, CASE WHEN w.st = 'tree' THEN w.path || '>' || l.c ELSE '' END, CASE WHEN w.st = 'tree' THEN 'tree' ELSE 'below_cycle' END
      FROM w JOIN l ON l.p = w.id WHERE l.c NOT IN (SELECT id FROM ring))
"""


@R.add(
    "p3_found",
    f"""WITH RECURSIVE {_TREE} SELECT w.id AS asset_id, st AS node_status, root AS root_id, CAST(depth AS INTEGER) AS depth, coalesce(cnt.n, 0) AS n_descendants,
    CASE WHEN st = 'tree' THEN md5(path) ELSE '' END AS path_md5 FROM w LEFT JOIN cnt USING (id)""",
)
def p3_found(t):
    h = hierarchy.hierarchy(hierarchy.folder_links(t("lineage_relationships")), "source_asset_id", "target_asset_id", with_path=False)
    return h.drop("path")


@R.add(
    "p3_descendants",
    f"""WITH RECURSIVE {_TREE} SELECT up.anc AS asset_id, up.id AS descendant_id, CAST(b.depth - a.depth AS INTEGER) AS steps
    FROM up JOIN w a ON a.id = up.anc JOIN w b ON b.id = up.id WHERE a.st = 'tree'""",
)
def p3_descendants(t):
    return hierarchy.descendants(hierarchy.folder_links(t("lineage_relationships")), "source_asset_id", "target_asset_id", trees_only=True)


@R.add(
    "p3_descendants_all",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {sql_id('source_asset_id')} AS p, {sql_id('target_asset_id')} AS c FROM lineage_relationships WHERE relationship_type = 'folder_hierarchy'),
    l AS (SELECT min(p) AS p, c FROM e WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY c),
    s AS (SELECT c AS id, p AS anc, 1 AS steps, [c, p] AS seen FROM l WHERE c <> p
          UNION ALL SELECT s.id, l.p, s.steps + 1, list_append(s.seen, l.p) FROM s JOIN l ON l.c = s.anc WHERE NOT list_contains(s.seen, l.p))
    SELECT anc AS asset_id, id AS descendant_id, CAST(steps AS INTEGER) AS steps FROM s""",
)
def p3_descendants_all(t):
    return hierarchy.descendants(hierarchy.folder_links(t("lineage_relationships")), "source_asset_id", "target_asset_id")


@R.add(
    "p3_cycles",
    f"""WITH RECURSIVE {_TREE} SELECT root AS cycle_id, count(*) AS n_nodes, min(l.p) FILTER (l.c = root) AS back_source, root AS back_target
    FROM ringroot JOIN l ON l.c = ringroot.id GROUP BY root""",
)
def p3_cycles(t):
    return hierarchy.cycles(hierarchy.folder_links(t("lineage_relationships")), "source_asset_id", "target_asset_id")


@R.add(
    "p3_parents",
    f"""WITH e AS (SELECT DISTINCT {sql_id('target_asset_id')} AS c, {sql_id('source_asset_id')} AS p FROM lineage_relationships),
    f AS (SELECT * FROM e WHERE c IS NOT NULL AND p IS NOT NULL)
    SELECT c AS asset_id, p AS parent_id, p = min(p) OVER (PARTITION BY c) AS is_kept FROM f QUALIFY count(*) OVER (PARTITION BY c) > 1""",
)
def p3_parents(t):
    """Over links of all types; folder_hierarchy alone gives each child one parent."""
    return hierarchy.several_parents(t("lineage_relationships"), "source_asset_id", "target_asset_id")


_REPEATED = "('columns', 'fields', 'row_groups', 'rowGroups', 'chunks', 'partitions', 'files', 'replicas', 'endpoints', 'parts')"


def _unwrapped(x: str) -> str:
    """A JSON value; what a string of JSON text says, up to two strings deep, where that is an object or array."""
    a = f"({x} ->> '$')"
    inner = f"json_type({a}) = 'VARCHAR' AND json_valid({a} ->> '$') AND json_type({a} ->> '$') IN ('OBJECT', 'ARRAY')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({a}) THEN CASE WHEN json_type({a}) IN ('OBJECT', 'ARRAY') THEN CAST({a} AS JSON) WHEN {inner} THEN CAST({a} ->> '$' AS JSON) ELSE {x} END ELSE {x} END"


#: The names of types (fixed values): b is the bare name, p the numbers in brackets, x the whole.
_KIND = """CASE WHEN b IN ('string','str','text','utf8','large_string','large_utf8','string_view','char','nchar','character','varchar','varchar2','nvarchar','nvarchar2','character_varying','clob','nclob','tinytext','mediumtext','longtext','bpchar') THEN 'string'
 WHEN b IN ('int32','int','integer','int4','mediumint','signed') THEN 'int32' WHEN b IN ('int64','bigint','long') THEN 'int64' WHEN b IN ('int16','smallint','short','int2') THEN 'int16' WHEN b IN ('int8','tinyint','byte') THEN 'int8'
 WHEN b IN ('float','float32','real','binary_float','float4') THEN 'float' WHEN b IN ('double','float64','double_precision','binary_double','float8') THEN 'double' WHEN b IN ('boolean','bool','bit') THEN 'boolean'
 WHEN b IN ('date','date32','date64') THEN 'date' WHEN b IN ('datetime','datetime2','smalldatetime','datetimeoffset') OR starts_with(b, 'timestamp') THEN 'timestamp'
 WHEN b IN ('decimal','decimal32','decimal64','decimal128','decimal256','numeric','number','dec') THEN CASE WHEN len(p) = 0 THEN 'decimal' ELSE 'decimal(' || p[1] || ',' || coalesce(p[2], '0') || ')' END
 WHEN b IN ('struct','row','record','object') THEN 'struct' WHEN b IN ('list','large_list','fixed_size_list','list_view','array') THEN 'list' WHEN b = 'map' THEN 'map'
 WHEN b IN ('binary','large_binary','fixed_size_binary','varbinary','blob','bytes','bytea','raw') THEN 'binary' ELSE x END"""
_KNOWN = "(lower(trim(regexp_extract(v, '^[A-Za-z0-9_ ]+', 0))) IN ('string','str','text','utf8','large_string','char','varchar','varchar2','nvarchar2','clob','int32','int','integer','int64','bigint','long','float','float32','real','double','float64','double precision','binary_double','binary_float','boolean','bool','date','date32','timestamp','datetime','decimal','decimal128','numeric','number','struct','list','array','map','binary'))"
#: Schema documents to columns, columns to canonical types, scans in order, each compared with the one before; names
#: gone and come are paired by spelling, then by type and description, in alphabetical order.
P4_FOUND = f"""WITH s AS (SELECT {sql_id('asset_id')} AS a, 0 AS own, discovered_at AS seen, id, schema_json AS t FROM data_discovery UNION ALL SELECT {sql_id('id')}, 1, NULL, 0, columns FROM assets),
j AS (SELECT a, own, seen, id, {_unwrapped('CAST(t AS JSON)')} AS j FROM s WHERE a IS NOT NULL AND json_valid(t)),
c0 AS (SELECT *, {_unwrapped("j -> '$.columns'")} AS c, {_unwrapped("j -> '$.fields'")} AS f FROM j),
c1 AS (SELECT a, own, seen, id, CASE WHEN json_type(j) = 'OBJECT' AND json_type(c) IN ('OBJECT', 'ARRAY') THEN c WHEN json_type(j) = 'OBJECT' AND json_type(f) IN ('OBJECT', 'ARRAY') THEN f
   WHEN json_type(j) = 'OBJECT' AND json_type(j -> '$.name') = 'VARCHAR' AND (json_exists(j, '$.type') OR json_exists(j, '$.dtype')) THEN json_array(j) WHEN json_type(j) = 'ARRAY' THEN j END AS c FROM c0),
o AS (SELECT * REPLACE (CASE WHEN json_type(c) = 'OBJECT' AND json_type(c -> '$.name') = 'VARCHAR' AND (json_exists(c, '$.type') OR json_exists(c, '$.dtype'))
   AND NOT list_bool_and(list_transform(json_extract_string(c, '$.*'), lambda v: v IS NOT NULL AND {_KNOWN})) THEN json_array(c) ELSE c END AS c) FROM c1),
e0 AS (SELECT a, own, seen, id, json_type(c) = 'ARRAY' AS arr, unnest(CASE WHEN json_type(c) = 'OBJECT' THEN json_keys(c) ELSE CAST(range(CAST(json_array_length(c) AS BIGINT)) AS VARCHAR[]) END) AS key,
   unnest(CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE json_extract(c, '$.*') END) AS v0, unnest(range(CAST(CASE WHEN json_type(c) = 'ARRAY' THEN json_array_length(c) ELSE len(json_keys(c)) END AS BIGINT))) AS i FROM o WHERE json_type(c) IN ('OBJECT', 'ARRAY')),
e1 AS (SELECT a, own, seen, id, arr, key, i, {_unwrapped('v0')} AS v FROM e0),
e2 AS (SELECT a, own, seen, id, i, CASE WHEN arr THEN CASE WHEN json_type(v -> '$.name') = 'VARCHAR' THEN v ->> '$.name' WHEN json_type(v -> '$.field') = 'VARCHAR' THEN v ->> '$.field' END ELSE key END AS name,
   CASE WHEN NOT arr AND json_type(v) = 'VARCHAR' THEN v ->> '$' WHEN json_type(v -> '$.type') = 'VARCHAR' THEN v ->> '$.type' WHEN json_type(v -> '$.dtype') = 'VARCHAR' THEN v ->> '$.dtype' ELSE coalesce(v ->> '$.type.base_type', v ->> '$.type.type', v ->> '$.base_type', '') END AS x,
   CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(nullif(trim(v ->> '$.description', {_BL}), ''), nullif(trim(v ->> '$.comment', {_BL}), ''), '') ELSE '' END AS about FROM e1 WHERE NOT arr OR json_type(v) = 'OBJECT'),
e3 AS (SELECT a, own, seen, id, i, trim(name, {_BL}) AS name, about, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS x FROM e2 WHERE trim(name, {_BL}) <> ''),
e4 AS (SELECT *, replace(trim(regexp_extract(x, '^[a-z][a-z0-9_ ]*', 0)), ' ', '_') AS b, regexp_extract_all(regexp_extract(x, '[(<\\[{{](.*)', 1), '[0-9]+') AS p FROM e3),
k AS (SELECT a, own, seen, id, name, {_KIND} AS kind, about, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS flat FROM e4 QUALIFY row_number() OVER (PARTITION BY a, own, id, seen, name ORDER BY i) = 1),
d AS (SELECT a, own, seen, id, row_number() OVER (PARTITION BY a ORDER BY own, seen NULLS FIRST, id) AS no FROM (SELECT DISTINCT a, own, seen, id FROM k)),
m AS (SELECT d.no, d.id AS doc, k.* FROM k JOIN d ON d.a = k.a AND d.own = k.own AND d.id = k.id AND d.seen IS NOT DISTINCT FROM k.seen),
n AS (SELECT a, no, doc FROM m WHERE no > 1 GROUP BY ALL),
gone AS (SELECT n.a, n.no, n.doc, x.name, x.kind, x.about, x.flat FROM n JOIN m x ON x.a = n.a AND x.no = n.no - 1 ANTI JOIN m y ON y.a = n.a AND y.no = n.no AND y.name = x.name),
come AS (SELECT n.a, n.no, n.doc, x.name, x.kind, x.about, x.flat FROM n JOIN m x ON x.a = n.a AND x.no = n.no ANTI JOIN m y ON y.a = n.a AND y.no = n.no - 1 AND y.name = x.name),
g1 AS (SELECT *, row_number() OVER (PARTITION BY a, no, flat ORDER BY name) AS r FROM gone), h1 AS (SELECT *, row_number() OVER (PARTITION BY a, no, flat ORDER BY name) AS r FROM come),
r1 AS (SELECT g.a, g.no, g.doc, g.name AS old_name, h.name AS new_name, g.kind <> h.kind AS typed FROM g1 g JOIN h1 h ON h.a = g.a AND h.no = g.no AND h.flat = g.flat AND h.r = g.r WHERE g.flat <> ''),
g2 AS (SELECT *, row_number() OVER (PARTITION BY a, no, kind, about ORDER BY name) AS r FROM gone ANTI JOIN r1 ON r1.a = gone.a AND r1.no = gone.no AND r1.old_name = gone.name),
h2 AS (SELECT *, row_number() OVER (PARTITION BY a, no, kind, about ORDER BY name) AS r FROM come ANTI JOIN r1 ON r1.a = come.a AND r1.no = come.no AND r1.new_name = come.name),
r2 AS (SELECT g.a, g.no, g.doc, g.name AS old_name, h.name AS new_name FROM g2 g JOIN h2 h ON h.a = g.a AND h.no = g.no AND h.kind = g.kind AND h.about = g.about AND h.r = g.r WHERE g.about <> '')
SELECT a AS asset_id, CAST(doc AS BIGINT) AS discovery_id, 'renamed' AS change_kind, old_name, new_name FROM r1 UNION ALL SELECT a, doc, 'renamed', old_name, new_name FROM r2
UNION ALL SELECT a, doc, 'retyped', old_name, new_name FROM r1 WHERE typed
UNION ALL SELECT x.a, y.doc, 'retyped', x.name, x.name FROM m x JOIN m y ON y.a = x.a AND y.no = x.no + 1 AND y.name = x.name WHERE x.kind <> y.kind
UNION ALL SELECT a, doc, 'removed', name, '' FROM g2 ANTI JOIN r2 ON r2.a = g2.a AND r2.no = g2.no AND r2.old_name = g2.name
UNION ALL SELECT a, doc, 'added', '', name FROM h2 ANTI JOIN r2 ON r2.a = h2.a AND r2.no = h2.no AND r2.new_name = h2.name"""


@R.add("p4_found", P4_FOUND)
def p4_found(t):
    return drift.schema_changes(t("data_discovery"), t("assets")).select("asset_id", "discovery_id", "change_kind", "old_name", "new_name")


@R.add("p4_routes")
def p4_routes(t):
    return drift.routes(t("data_discovery"), t("assets"))


@R.add("p4_tables")
def p4_tables(t):
    return drift.consistent_table(t("data_discovery"), t("assets"))


#: Containers level by level: e marks the objects that are elements of an array, own is the nearest of them.
_ELEMENTS = f"""WITH RECURSIVE d AS (
  SELECT id AS k, 'columns' AS f, columns AS t FROM assets UNION ALL SELECT id, 'technical_metadata', technical_metadata FROM assets
  UNION ALL SELECT CAST(id AS VARCHAR), 'storage_location', storage_location FROM data_discovery UNION ALL SELECT CAST(id AS VARCHAR), 'file_metadata', file_metadata FROM data_discovery),
r AS (SELECT k, f, {_unwrapped('CAST(t AS JSON)')} AS j FROM d WHERE json_valid(t)),
n AS (SELECT k, f, '' AS path, '' AS own, '' AS up, false AS e, CASE WHEN f = 'columns' AND json_type(j) = 'OBJECT' THEN json_array(j) ELSE j END AS j FROM r WHERE json_type(j) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT k, f, p, CASE WHEN arr AND t = 'OBJECT' THEN p ELSE own END, CASE WHEN arr AND t = 'OBJECT' THEN own ELSE '' END, arr AND t = 'OBJECT', CASE WHEN NOT arr AND t = 'OBJECT' AND key IN {_REPEATED} THEN json_array(v) ELSE v END
  FROM (SELECT k, f, own, arr, key, v, json_type(v) AS t, CASE WHEN arr THEN path || '[' || key || ']' WHEN path = '' THEN key ELSE path || '.' || key END AS p
    FROM (SELECT k, f, path, own, arr, key, {_unwrapped('x')} AS v
      FROM (SELECT k, f, path, own, json_type(j) = 'ARRAY' AS arr, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(range(CAST(json_array_length(j) AS BIGINT)) AS VARCHAR[]) ELSE json_keys(j) END) AS key,
          unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.*') END) AS x FROM n)))
  WHERE t IN ('OBJECT', 'ARRAY'))"""


@R.add("p5_found", _ELEMENTS + " SELECT k AS record_key, f AS field_name, path AS node_path, up AS parent_path FROM n WHERE e")
def p5_found(t):
    return nested.found(_nodes(t))


def _nodes(t):
    """The rows of all four document columns."""
    a = nested.shred_table(t("assets"), "id", {"technical_metadata": "technical_metadata", "columns": "columns"})
    d = nested.shred_table(t("data_discovery"), "id", {"storage_location": "storage_location", "file_metadata": "file_metadata"})
    return a.unionByName(d)


def _same(*paths: str) -> dict[str, str]:
    """A column for each path, named as the path with _ for what cannot be in a name."""
    return {p.removesuffix("[]").replace(".", "_"): p for p in paths}


_COLUMN = {"name": "name", "type": "type", "nullable": "nullable", "description": "description", "base_type": "type_info.base_type", "pii_types": "pii_types[]"} | _same(
    "pii_detected", "masking_logic_analytical", "type_info.is_nested", "type_info.is_nullable", "type_info.nested_type",
    "type_info.element.type", "type_info.element_type", "type_info.key_type", "type_info.value_type",
)
_DOCUMENT = _same(
    "type", "identifier", "path", "schema", "key", "object_name", "object_type", "bucket.name", "container", "container.name", "container.type", "connection.account_name", "connection.method",
    "asset_id", "asset_type", "location", "format", "size", "size_bytes", "last_modified", "file_name", "file_hash", "access_tier", "hash.algorithm", "hash.value",
    "basic.name", "basic.format", "basic.size_bytes", "basic.content_type", "timestamps.created", "timestamps.last_modified", "azure_metadata.owner_team", "azure_metadata.tags[]",
    "format_specific.csv.delimiter", "format_specific.csv.encoding", "format_specific.csv.has_header", "format_specific.parquet.compression",
)

#: The named columns of each shape's table; what is delivered besides is in its column rest.
_FLAT = {
    "documents": _DOCUMENT, "columns": _COLUMN, "replicas": _same("zone", "tier"), "endpoints": _same("kind", "secure"), "partitions": _same("key", "value"), "files": _same("path", "size_bytes"),
    "row_groups": _same("index", "num_rows"), "chunks": _same("column", "compressed_bytes", "stats.min", "stats.max", "stats.null_count"), "parts": _same("part_no", "etag", "size_bytes"), "others": {},
}


@R.add(
    "p5_links",
    _ELEMENTS + """, o AS (SELECT k, f, path, up, regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS g FROM n WHERE e)
    SELECT c.f AS field_name, c.g AS group_path, coalesce(p.g, '') AS parent_group, count(*) AS n_rows, count(DISTINCT (c.k, c.up)) AS n_parents FROM o c LEFT JOIN o p ON p.k = c.k AND p.f = c.f AND p.path = c.up GROUP BY ALL""",
)
def p5_links(t):
    """How the flat tables hang together: for each group of rows the group of their parents, by joining rows to the rows around."""
    n = nested.found(_nodes(t))
    group = F.regexp_replace("node_path", r"\[[0-9]+\]", "[]")
    up = n.select("record_key", "field_name", F.col("node_path").alias("parent_path"), group.alias("parent_group"))
    j = n.withColumn("group_path", group).join(up, ["record_key", "field_name", "parent_path"], "left")
    g = j.groupBy("field_name", "group_path", F.coalesce("parent_group", F.lit("")).alias("parent_group"))
    return g.agg(F.count("*").alias("n_rows"), F.count_distinct("record_key", "parent_path").alias("n_parents"))


def _flat(shape: str):
    @R.add(f"p5_{shape}")
    def run(t):
        return nested.shape_table(_nodes(t), nested.SHAPES.get(shape), _FLAT[shape])


for _shape in _FLAT:
    _flat(_shape)


@R.add("p5_schema")
def p5_schema(t):
    return nested.group_columns(_nodes(t))
