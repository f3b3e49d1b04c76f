"""Lineage: inference and graph queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from metaloom.functions import paths
from metaloom.operators import catalog as C
from metaloom.operators import graph as G
from metaloom.operators import inference as N
from metaloom.plans.base import COLS, doc, sid
from metaloom.registry import Registry

R = Registry()
S, T = sid("source_asset_id"), sid("target_asset_id")
TM = doc("technical_metadata")

_E = f"e AS (SELECT id AS edge_id, {S} AS source, {T} AS target, relationship_type AS kind, discovered_at AS at_ FROM lineage_relationships WHERE {S} IS NOT NULL AND {T} IS NOT NULL AND relationship_type <> 'folder_hierarchy')"
_STARTS = f"st AS (SELECT DISTINCT {S} AS id FROM lineage_relationships WHERE id % 50 = 0 AND {S} IS NOT NULL)"


def _edges(t):
    return G.edges(t("lineage_relationships").where("relationship_type <> 'folder_hierarchy'"))


def _starts(t):
    """The stated query set: the sources of every edge whose id is divisible by 50."""
    return t("lineage_relationships").where("id % 50 = 0").select(F.col("source_asset_id").alias("id"))


def _bfs(a: str, b: str, where: str = "") -> str:
    return f"""{_E}, {_STARTS}, l AS (SELECT {a} AS n, {b} AS m, edge_id FROM e {where}),
    r AS (SELECT id AS start, id AS node, 0 AS depth FROM st UNION SELECT r.start, l.m, r.depth + 1 FROM r JOIN l ON l.n = r.node WHERE r.depth < 3),
    d AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2)
    SELECT d.start, l.edge_id, d.depth + 1 AS depth FROM d JOIN l ON l.n = d.node WHERE d.depth < 3"""


@R.add("graph_G1_J6_upstream", "WITH RECURSIVE " + _bfs("target", "source"))
def g_up(t):
    return G.traverse(_edges(t), _starts(t), 3, upstream=True)[1]


@R.add("graph_G2_A13_downstream", "WITH RECURSIVE " + _bfs("source", "target"))
def g_down(t):
    return G.traverse(_edges(t), _starts(t), 3)[1]


@R.add("graph_G3_J19_as_of", "WITH RECURSIVE " + _bfs("source", "target", "WHERE at_ IS NULL OR at_ <= TIMESTAMP '2025-04-01'"))
def g_as_of(t):
    return G.traverse(G.valid(_edges(t), datetime(2025, 4, 1), "at", None), _starts(t), 3)[1]


@R.add("graph_G4_descendants", f"WITH RECURSIVE {_E}, {_STARTS}, r AS (SELECT id AS start, id AS node FROM st UNION SELECT r.start, e.target FROM r JOIN e ON e.source = r.node) SELECT start, node FROM r")
def g_all(t):
    return G.traverse(_edges(t), _starts(t), None)[0].select("start", "node")


@R.add("graph_G5_impacted", f"WITH {_E}, {_STARTS} SELECT DISTINCT st.id, e.target AS impacted FROM st JOIN e ON e.source = st.id")
def g_impacted(t):
    return G.impacted(_edges(t), _starts(t))


_LAYOUT = f"""{_E}, l AS (SELECT DISTINCT source, target FROM e), ids AS (SELECT source AS id FROM l UNION SELECT target FROM l),
ro AS (SELECT id FROM ids WHERE id NOT IN (SELECT target FROM l WHERE source <> target)),
r AS (SELECT id, 0 AS level FROM ro UNION SELECT l.target, r.level + 1 FROM r JOIN l ON l.source = r.id WHERE r.level < 40),
v AS (SELECT ids.id, coalesce(min(level), 0) AS level FROM ids LEFT JOIN r USING (id) GROUP BY 1),
gr AS (SELECT {sid('id')} AS id, min(catalog || '_' || connector_id) AS grp FROM assets GROUP BY 1)"""


@R.add("graph_G6_layout", f"WITH RECURSIVE {_LAYOUT} SELECT v.id, level, level * 300 AS x, (row_number() OVER (PARTITION BY level ORDER BY coalesce(grp, ''), v.id) - 1) * 120 AS y FROM v LEFT JOIN gr USING (id)")
def g_layout(t):
    grp = t("assets").groupBy(C.loose_id("id").alias("id")).agg(F.min(F.concat("catalog", F.lit("_"), "connector_id")).alias("grp"))
    return G.layout(_edges(t), grp)


_FOLD = f"fo AS (SELECT id, string_split(trim({TM} ->> '$.location', '/'), '/') AS p FROM assets), pf AS (SELECT id, unnest(range(1, len(p))) AS level, p FROM fo WHERE len(p) > 1)"


@R.add("graph_G7_folders", f"WITH {_FOLD} SELECT id, array_to_string(p[1:level], '/') AS folder, CAST(level AS INTEGER) AS level FROM pf")
def g_folders(t):
    return G.folder_prefixes(t("assets"))


_CL = f"""c0 AS (SELECT id, {S} AS source, {T} AS target, column_lineage AS j FROM lineage_relationships WHERE json_array_length(column_lineage) > 0),
cl AS (SELECT id AS edge_id, source, target, c ->> '$.source_column' AS source_column, c ->> '$.target_column' AS target_column, c ->> '$.transformation' AS transformation, CAST(c ->> '$.similarity_score' AS DOUBLE) AS similarity_score
  FROM (SELECT *, unnest(json_extract(j, '$[*]')) AS c FROM c0))"""


@R.add(
    "graph_G7_documents",
    f"""WITH {_CL}, {_FOLD}, ae AS (SELECT {S} AS s, {T} AS t FROM lineage_relationships WHERE {S} IS NOT NULL AND {T} IS NOT NULL),
    u AS (SELECT t AS k, count(DISTINCT s) AS n FROM ae GROUP BY 1), d AS (SELECT s AS k, count(DISTINCT t) AS n FROM ae GROUP BY 1), cc AS (SELECT target AS k, count(*) AS n FROM cl GROUP BY 1),
    h AS (SELECT id, string_agg(array_to_string(p[1:level], '/'), '>' ORDER BY level) AS h FROM pf GROUP BY 1)
    SELECT a.id, a.name, coalesce(u.n, 0) AS n_upstream, coalesce(d.n, 0) AS n_downstream, coalesce(cc.n, 0) AS n_columns, coalesce(h.h, '') AS hierarchy
    FROM assets a LEFT JOIN u ON u.k = {sid('a.id')} LEFT JOIN d ON d.k = {sid('a.id')} LEFT JOIN cc ON cc.k = {sid('a.id')} LEFT JOIN h ON h.id = a.id WHERE u.n IS NOT NULL OR d.n IS NOT NULL""",
)
def g_documents(t):
    return G.asset_documents(t("assets"), t("lineage_relationships"))


@R.add(
    "graph_G7_G8_nodes",
    f"""WITH RECURSIVE {_LAYOUT}, p AS (SELECT v.id, level, level * 300 AS x, (row_number() OVER (PARTITION BY level ORDER BY coalesce(grp, ''), v.id) - 1) * 120 AS y FROM v LEFT JOIN gr USING (id)),
    a AS (SELECT {sid('id')} AS id, min((name, type, catalog, connector_id)) AS s FROM assets GROUP BY 1)
    SELECT p.id, coalesce(s[1], p.id) AS name, s[2] AS type, s[3] AS catalog, s[4] AS connector_id, s IS NOT NULL AS is_known, level, x, y FROM p LEFT JOIN a USING (id)""",
)
def g_nodes(t):
    grp = t("assets").groupBy(C.loose_id("id").alias("id")).agg(F.min(F.concat("catalog", F.lit("_"), "connector_id")).alias("grp"))
    e = _edges(t)
    return G.lineage_nodes(e, t("assets"), G.layout(e, grp))


@R.add(
    "graph_G7_edges",
    f"""SELECT {S} AS source, {T} AS target, count(*) AS n_edges, string_agg(DISTINCT relationship_type, ',' ORDER BY relationship_type) AS kinds, sum(coalesce(json_array_length(column_lineage), 0))::BIGINT AS n_columns, max(confidence_score)::DOUBLE AS confidence
    FROM lineage_relationships WHERE {S} IS NOT NULL AND {T} IS NOT NULL GROUP BY 1, 2""",
)
def g_edge_rows(t):
    return G.lineage_edges(t("lineage_relationships"))


@R.add("graph_G8_reactflow", f"""WITH {_E}, d AS (SELECT DISTINCT source AS s, target AS t FROM e) SELECT '{{"id":"' || regexp_replace(s, '[^a-zA-Z0-9_]', '_', 'g') || '-' || regexp_replace(t, '[^a-zA-Z0-9_]', '_', 'g') || '","source":' || to_json(s) || ',"target":' || to_json(t) || '}}' AS line FROM d""")
def g_reactflow(t):
    return G.diagram(_edges(t), "reactflow")


@R.add("graph_G8_mermaid", f"WITH {_E} SELECT DISTINCT '    ' || regexp_replace(source, '[^a-zA-Z0-9_]', '_', 'g') || '[' || source || '] --> ' || regexp_replace(target, '[^a-zA-Z0-9_]', '_', 'g') || '[' || target || ']' AS line FROM e")
def g_mermaid(t):
    return G.diagram(_edges(t), "mermaid")


@R.add("graph_G8_graphviz", f"""WITH {_E} SELECT DISTINCT '    "' || source || '" -> "' || target || '";' AS line FROM e""")
def g_graphviz(t):
    return G.diagram(_edges(t), "graphviz")


@R.add("graph_G9_J7_columns", f"WITH {_CL} SELECT * FROM cl")
def g_columns(t):
    return G.column_lineage(t("lineage_relationships"))


@R.add("graph_G9_first_edge", f"WITH {_CL} SELECT * FROM cl WHERE edge_id = (SELECT min(edge_id) FROM cl x WHERE x.source IS NOT DISTINCT FROM cl.source AND x.target IS NOT DISTINCT FROM cl.target) AND source IS NOT NULL AND target IS NOT NULL")
def g_first(t):
    return G.first_column_lineage(t("lineage_relationships").where(C.loose_id("source_asset_id").isNotNull() & C.loose_id("target_asset_id").isNotNull()))


# inference


@R.add("infer_N1_N3_names")
def n_names(t):
    return N.scored_pairs(G.column_lineage(t("lineage_relationships")), "source_column", "target_column")


def _pairs(t):
    return _edges(t).select("source", "target")


@R.add("infer_N2_N7_N8_columns")
def n_columns(t):
    return N.matched_assets(_pairs(t), t("assets"))


def _asked(t):
    """The stated query set: assets whose number (the digits of the name) is divisible by 50."""
    return t("assets").where(F.regexp_extract("name", r"([0-9]{7})", 1).try_cast("int") % 50 == 0)


@R.add("infer_N7_N8_J9_search")
def n_search(t):
    return N.search_columns(_asked(t), t("assets"))


@R.add("infer_N8_names")
def n_search_names(t):
    return N.search_names(_asked(t), t("assets"))


@R.add("infer_N13_J9_across")
def n_search_across(t):
    return N.search_columns(_asked(t), t("assets"), across=True, least=0.7, cap=0.9)


@R.add("infer_N12_J12_files")
def n_files(t):
    oracle = F.col("connector_id").startswith("oracle")
    return N.search_files(_asked(t).where(oracle), t("assets").where(~oracle))


@R.add(
    "infer_N16_J14_schemas",
    f"""WITH e1 AS (SELECT DISTINCT a.catalog AS s, b.catalog AS t FROM lineage_relationships l JOIN assets a ON a.id = {S.replace('source_asset_id', 'l.source_asset_id')} JOIN assets b ON b.id = {T.replace('target_asset_id', 'l.target_asset_id')} WHERE l.relationship_type <> 'folder_hierarchy' AND a.catalog <> b.catalog AND a.catalog <> '' AND b.catalog <> ''),
    n AS (SELECT catalog, count(*) AS n FROM assets GROUP BY 1)
    SELECT s AS source_schema, t AS target_schema, x.n AS n_sources, y.n AS n_targets, x.n * y.n AS n_links FROM e1 JOIN n x ON x.catalog = s JOIN n y ON y.catalog = t""",
)
def n_schema_links(t):
    """Schema-level links for every two schemas that some edge connects."""
    c = t("assets").where("catalog <> ''")
    s, d = c.select(F.col("id").alias("source"), F.col("catalog").alias("source_schema")), c.select(F.col("id").alias("target"), F.col("catalog").alias("target_schema"))
    asked = _pairs(t).join(s, "source").join(d, "target").where("source_schema <> target_schema")
    return N.schema_links(asked, t("assets"))


@R.add(
    "infer_N11_J10_shared",
    f"""WITH {_E}, {COLS}, c1 AS (SELECT DISTINCT {sid('asset_id')} AS k, lower(c ->> '$.name') AS n, lower(c ->> '$.type') AS t FROM cols WHERE c ->> '$.name' IS NOT NULL),
    p AS (SELECT DISTINCT source, target FROM e WHERE source <> target), j AS (SELECT p.source, p.target, count(*) AS n_shared FROM p JOIN c1 a ON a.k = p.source JOIN c1 b ON b.k = p.target AND b.n = a.n AND b.t = a.t GROUP BY 1, 2)
    SELECT source, target, n_shared, round(least(0.85, 0.7 + 0.05 * (n_shared - 2)), 2)::DOUBLE AS confidence FROM j WHERE n_shared >= 2""",
)
def n_shared(t):
    return N.shared_columns(_pairs(t), t("assets"))


_SETS = f"""{COLS}, c1 AS (SELECT DISTINCT {sid('asset_id')} AS k, lower(c ->> '$.name') AS n, lower(c ->> '$.type') AS t FROM cols WHERE c ->> '$.name' IS NOT NULL AND c ->> '$.type' IS NOT NULL),
s1 AS (SELECT k, list_sort(list((n, t))) AS s FROM c1 GROUP BY 1), cl AS (SELECT k, min(k) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS members FROM s1 WHERE k IS NOT NULL)"""


@R.add("infer_N11_J10_classes", f"WITH {_SETS} SELECT k AS asset_id, class_id FROM cl")
def n_classes(t):
    return N.column_classes(t("assets")).select(F.col("key").alias("asset_id"), "class_id")


@R.add(
    "infer_N11_J10_all",
    f"""WITH {_SETS}, x AS (SELECT c1.* FROM c1 JOIN cl ON cl.k = c1.k AND cl.class_id = c1.k),
    j AS (SELECT a.k AS class_a, b.k AS class_b, count(*) AS n_shared FROM x a JOIN x b ON a.n = b.n AND a.t = b.t AND a.k < b.k GROUP BY 1, 2
      UNION ALL SELECT x.k, x.k, count(*) FROM x JOIN cl ON cl.k = x.k AND cl.members > 1 GROUP BY 1)
    SELECT class_a, class_b, n_shared, round(least(0.85, 0.7 + 0.05 * (n_shared - 2)), 2)::DOUBLE AS confidence FROM j WHERE n_shared >= 2""",
)
def n_shared_all(t):
    return N.shared_classes(t("assets"))


_LOC = f"""lo0 AS (SELECT id, connector_id, coalesce({TM} ->> '$.container', {TM} ->> '$.bucket', catalog) AS container, trim({TM} ->> '$.location', '/') AS path FROM assets),
lo AS (SELECT id, connector_id, container, regexp_replace(path, '/?[^/]*$', '') AS folder, CASE WHEN contains(path, '/') THEN len(string_split(regexp_replace(path, '/?[^/]*$', ''), '/')) ELSE 0 END AS depth FROM lo0 WHERE path <> '')"""


@R.add(
    "infer_N4_J8_folders",
    f"""WITH {_LOC}, f AS (SELECT connector_id, container, folder, count(*) AS n FROM lo GROUP BY 1, 2, 3)
    SELECT c.connector_id, c.container, p.folder AS parent_folder, c.folder AS child_folder, p.n AS n_parents, c.n AS n_children, 0.7::DOUBLE AS confidence FROM f c JOIN f p ON p.connector_id = c.connector_id AND p.container IS NOT DISTINCT FROM c.container
    AND p.folder = regexp_replace(c.folder, '/?[^/]*$', '') WHERE c.folder <> ''""",
)
def n_folders(t):
    return N.folder_edges(t("assets"))


@R.add("infer_N5_J15_schemas", "SELECT connector_id, catalog AS schema, count(*) FILTER (type = 'table') AS n_tables, count(*) FILTER (type = 'view') AS n_views, count(*) FILTER (type = 'table') * count(*) FILTER (type = 'view') AS n_links, 0.6::DOUBLE AS confidence FROM assets WHERE type IN ('table', 'view') GROUP BY 1, 2 HAVING count(*) FILTER (type = 'table') > 0 AND count(*) FILTER (type = 'view') > 0")
def n_schemas(t):
    return N.schema_edges(t("assets"))


_ROLE = "CASE WHEN regexp_matches(lower(name), 'raw|staging|stg|input|source|backup|archive') THEN 'source' WHEN regexp_matches(lower(name), 'processed|final|output|target|result') THEN 'target' ELSE 'member' END AS role"
#: The surveyed patterns, and the numbered names of the catalog beside them.
_NAMED = " UNION ".join(
    f"SELECT id, connector_id, lower(regexp_extract(name, '{p}', 1)) AS base, '{k}' AS kind, {_ROLE} FROM assets WHERE regexp_matches(name, '{p}')"
    for p, k in (
        ("(?i)^(.+?)_(raw|staging|stg|temp|tmp)[.](.+)", "etl_pipeline"), ("(?i)^(.+?)_(input|source)[.](.+)", "etl_pipeline"), ("^(.+?)_([0-9]{8})[.](.+)", "date_partition"),
        ("(?i)^(.+?)_(backup|archive)[.](.+)", "backup_relationship"), ("^(.+?)[_ -]([0-9]{7})[.](.+)", "date_partition"),
    )
)


@R.add(
    "infer_N6_naming",
    f"""WITH n AS ({_NAMED}), g AS (SELECT connector_id, base, kind, count(*) AS n, count(*) FILTER (role = 'source') AS s, count(*) FILTER (role = 'target') AS t FROM n GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT n.id, n.connector_id, n.base, n.kind, n.role, g.s AS n_sources, g.t AS n_targets, CASE WHEN g.s > 0 AND g.t > 0 THEN g.s * g.t ELSE g.n * (g.n - 1) // 2 END AS n_links, CASE WHEN g.s > 0 AND g.t > 0 THEN 0.8 ELSE 0.75 END::DOUBLE AS confidence FROM n JOIN g USING (connector_id, base, kind)""",
)
def n_naming(t):
    return N.naming_groups(t("assets"), (*N.NAMING, (r"^(.+?)[_ -](\d{7})\.(.+)", "date_partition")))


_PLAIN = r"regexp_replace(regexp_replace(lower(name), '\.[a-z0-9]+$', ''), '[^\p{L}\p{N}]', '', 'g')"


@R.add(
    "infer_N13_J11_across",
    f"""WITH a AS (SELECT id, regexp_replace({_PLAIN}, '[0-9]+$', '') AS p, split_part(connector_id, '_', 1) AS f FROM assets), b AS (SELECT p, f, count(*) AS n, min(id) AS m FROM a WHERE p <> '' AND f IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT p, sum(n)::BIGINT AS t, min(m) AS class_id FROM b GROUP BY 1 HAVING count(*) > 1) SELECT a.id, c.class_id, a.f AS platform, c.t - b.n AS n_links, 0.75::DOUBLE AS confidence FROM a JOIN b USING (p, f) JOIN c USING (p)""",
)
def n_across(t):
    return N.same_name_across(t("assets"), numbered=True)


@R.add(
    "infer_N12_J12_table_file",
    f"""WITH a AS (SELECT id, regexp_replace({_PLAIN}, '[0-9]+$', '') AS p, connector_id, lower(concat_ws(' ', id, name)) AS x FROM assets),
    f AS (SELECT p, count(*) AS n_files, min(id) AS first_file, bool_or(regexp_matches(x, 'export|extract|dump')) AS o FROM a WHERE NOT starts_with(connector_id, 'oracle') AND p <> '' GROUP BY 1)
    SELECT a.id AS table_id, f.n_files, f.first_file, CASE WHEN f.o THEN 'table_to_file' ELSE 'file_to_table' END AS direction, 0.9::DOUBLE AS confidence FROM a JOIN f USING (p) WHERE starts_with(connector_id, 'oracle')""",
)
def n_table_file(t):
    return N.table_and_file(t("assets"), numbered=True)


@R.add(
    "infer_N10_jobs",
    f"""WITH e1 AS (SELECT source_job_id AS j, {S} AS s, {T} AS t FROM lineage_relationships WHERE source_job_id IS NOT NULL AND {S} IS NOT NULL AND {T} IS NOT NULL),
    o AS (SELECT j, a, max(i) AS i, max(o) AS o FROM (SELECT j, s AS a, 1 AS i, 0 AS o FROM e1 UNION ALL SELECT j, t, 0, 1 FROM e1) GROUP BY 1, 2)
    SELECT j AS source_job_id, sum(i)::BIGINT AS n_inputs, sum(o)::BIGINT AS n_outputs, (sum(i) * sum(o) - count(*) FILTER (i = 1 AND o = 1))::BIGINT AS n_links, 0.8::DOUBLE AS confidence FROM o GROUP BY 1""",
)
def n_jobs(t):
    return N.job_links(t("lineage_relationships"))


@R.add(
    "infer_N14_J5_neighbours",
    f"""WITH {_LOC}, f AS (SELECT connector_id AS k, container AS c, folder, depth, count(*) AS n, CASE WHEN depth > 0 THEN regexp_replace(folder, '/?[^/]*$', '') END AS up FROM lo GROUP BY ALL)
    SELECT lo.id, f.n - 1 AS n_same, coalesce((SELECT sum(n) FROM f p WHERE p.k = f.k AND p.c = f.c AND p.folder = f.up), 0)::BIGINT AS n_parent,
    coalesce((SELECT sum(n) FROM f p WHERE p.k = f.k AND p.c = f.c AND p.folder <> f.folder AND (f.folder = '' OR starts_with(p.folder, f.folder || '/'))), 0)::BIGINT AS n_child,
    coalesce((SELECT sum(n) FROM f p WHERE p.k = f.k AND p.c = f.c AND p.up = f.up AND p.folder <> f.folder), 0)::BIGINT AS n_sibling
    FROM lo JOIN f ON f.k = lo.connector_id AND f.c = lo.container AND f.folder = lo.folder""",
)
def n_neighbours(t):
    return N.folder_neighbours(t("assets"))


@R.add("infer_N15_inputs", f"WITH {_LOC} SELECT connector_id, container, folder, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY connector_id, container, folder ORDER BY id) AS rank FROM lo) WHERE rank <= 5")
def n_inputs(t):
    return N.folder_inputs(t("assets"))


@R.add(
    "infer_N16_S22_manual",
    """WITH u AS (SELECT p_partkey, unnest(string_split(p_brand || '.' || p_type || '.t' || p_partkey || '; ' || p_brand, ';')) AS s FROM part), v AS (SELECT *, trim(s) AS x FROM u)
    SELECT CASE WHEN len(string_split(x, '.')) >= 3 THEN 'urn:dataset:oracle:' WHEN len(string_split(x, '.')) = 2 THEN 'urn:dataset:azure-blob:' ELSE 'urn:dataset:unknown:' END || x AS source_urn, 'load ' || p_partkey AS process,
    'urn:dataset:azure-blob:out.t' || p_partkey AS target_urn, 'a' AS source_column, 'b' AS target_column, 'direct' AS kind FROM v WHERE x <> ''""",
)
def n_manual(t):
    k = F.col("p_partkey").cast("string")
    up = t("part").select(
        F.concat("p_brand", F.lit("."), "p_type", F.lit(".t"), k, F.lit("; "), "p_brand").alias("source_table"), F.concat(F.lit("out.t"), k).alias("target_table"), F.concat(F.lit("load "), k).alias("process_name"),
        F.lit("a").alias("source_column"), F.lit("b").alias("target_column"), F.lit(None).cast("string").alias("transformation_type"),
    )
    return N.manual_edges(up)


@R.add(
    "infer_N17_stages",
    """SELECT id, CASE WHEN contains(lower(catalog), 'crm') OR contains(lower(catalog), 'source') OR contains(lower(id), ':source:') OR upper(type) = 'API' THEN 'source'
    WHEN contains(lower(catalog), 'staging') OR regexp_matches(lower(name), 'raw|staging|transformed') OR contains(lower(id), ':staging:') THEN 'extract' WHEN contains(lower(catalog), 'warehouse') OR regexp_matches(lower(name), 'dim|fact|transform') THEN 'transform'
    WHEN contains(lower(catalog), 'analytics') OR contains(lower(catalog), 'report') OR regexp_matches(lower(name), 'destination|warehouse') OR contains(lower(id), ':destination:') THEN 'load' END AS stage FROM assets""",
)
def n_stages(t):
    return t("assets").select("id", N.pipeline_stage(F.col("name"), F.col("catalog"), F.lit(None).cast("string"), F.col("id"), F.col("type")).alias("stage"))


@R.add(
    "infer_N17_relations",
    f"""SELECT id, CASE WHEN contains(lower(relationship_type), 'extract') THEN 'extract' WHEN contains(lower(relationship_type), 'transform') THEN 'transform' WHEN contains(lower(relationship_type), 'load') THEN 'load'
    WHEN contains(lower(source_asset_id), ':source:') AND contains(lower(target_asset_id), ':staging:') THEN 'extract' WHEN contains(lower(source_asset_id), ':staging:') AND contains(lower(target_asset_id), ':destination:') THEN 'load' END AS stage FROM lineage_relationships""",
)
def n_relations(t):
    return t("lineage_relationships").select("id", N.relation_stage(F.col("relationship_type"), F.col("source_asset_id"), F.col("target_asset_id")).alias("stage"))


# addresses and names


@R.add(
    "paths_S19_location",
    r"""SELECT id, CASE WHEN regexp_matches(p, '(?i)^(abfss?)://([^@]+)@([^.]+)\.dfs\.core\.windows\.net(.*)$') THEN 'azure_datalake' WHEN regexp_matches(p, '(?i)^(https?)://([^.]+)\.blob\.core\.windows\.net/([^/]+)(.*)$') THEN 'azure_blob'
    WHEN regexp_matches(p, '^s3://([^/]+)/?(.*)$') THEN 'aws_s3' WHEN contains(p, '/') AND NOT regexp_matches(p, '^[a-z0-9]+://') THEN 'azure_blob' END AS type,
    CASE WHEN regexp_matches(p, '(?i)^(abfss?)://') THEN regexp_extract(p, '(?i)^(abfss?)://([^@]+)@', 2) WHEN regexp_matches(p, '(?i)^https?://[^.]+\.blob\.') THEN regexp_extract(p, '(?i)^https?://[^/]+/([^/]+)', 1)
    WHEN regexp_matches(p, '^s3://') THEN regexp_extract(p, '^s3://([^/]+)', 1) WHEN contains(p, '/') THEN split_part(p, '/', 1) END AS container FROM (SELECT id, trim(storage_path) AS p FROM data_discovery WHERE storage_path IS NOT NULL)""",
)
def s_location(t):
    d = t("data_discovery").where("storage_path is not null").select("id", paths.storage_location(F.col("storage_path")).alias("x"))
    return d.select("id", "x.type", "x.container")


@R.add(
    "paths_S18_jdbc",
    r"""SELECT s_suppkey, 'h' || s_suppkey AS host, 1521 AS port, 'svc' || s_nationkey AS service FROM supplier""",
)
def s_jdbc(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    h, s = F.concat(F.lit("h"), k.cast("string")), F.concat(F.lit("svc"), n)
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("jdbc:oracle:thin:@//"), h, F.lit(":1521/"), s, F.lit("?x=1"))).when(k % 5 == 1, F.concat(F.lit("jdbc:oracle:thin:@"), h, F.lit(":1521:"), s))
        .when(k % 5 == 2, F.concat(F.lit("jdbc:oracle:oci:@"), h, F.lit(":1521/"), s)).when(k % 5 == 3, F.concat(F.lit("jdbc:oracle:thin:@(DESCRIPTION=(ADDRESS=(PROTOCOL=TCP)(HOST="), h, F.lit(")(PORT=1521))(CONNECT_DATA=(SERVICE_NAME="), s, F.lit(")))")))
        .otherwise(F.concat(F.lit("other:@"), h, F.lit(":1521/"), s))
    )
    return t("supplier").select("s_suppkey", paths.jdbc_address(url).alias("x")).select("s_suppkey", "x.host", "x.port", "x.service")


@R.add(
    "paths_urns",
    """SELECT id, 'urn:dataset:' || replace(coalesce(nullif(connector_id, ''), 'unknown'), '_', '-') || ':' || concat_ws('.', nullif(catalog, ''), name) AS urn,
    split_part(split_part('urn:dataset:' || replace(coalesce(nullif(connector_id, ''), 'unknown'), '_', '-') || ':' || concat_ws('.', nullif(catalog, ''), name), ':', -1), '.', -1) AS short FROM assets""",
)
def s_urns(t):
    u = paths.dataset_urn(F.col("connector_id"), F.col("catalog"), F.lit(None).cast("string"), F.col("name"))
    return t("assets").select("id", u.alias("urn"), paths.urn_name(u).alias("short"))


@R.add(
    "paths_S16_format",
    r"""SELECT id, coalesce(CASE regexp_extract(f, '\.([a-z0-9]+)$', 1) WHEN 'parquet' THEN 'parquet' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'json' WHEN 'ndjson' THEN 'json' WHEN 'avro' THEN 'avro'
    WHEN 'xlsx' THEN 'excel' WHEN 'xls' THEN 'excel' WHEN 'xml' THEN 'xml' WHEN 'orc' THEN 'orc' WHEN 'delta' THEN 'delta' END, CASE WHEN regexp_extract(f, '\.([a-z0-9]+)$', 1) = '' THEN CASE WHEN contains(p, 'parquet') THEN 'parquet' WHEN contains(p, 'csv') THEN 'csv'
    WHEN contains(p, 'json') THEN 'json' WHEN contains(p, 'avro') THEN 'avro' WHEN contains(p, 'orc') THEN 'orc' WHEN contains(p, 'delta') THEN 'delta' WHEN contains(p, 'xml') THEN 'xml' END END, 'unknown') AS format
    FROM (SELECT id, lower(storage_path) AS p, regexp_extract(lower(storage_path), '([^/]*)$', 1) AS f FROM data_discovery WHERE storage_path IS NOT NULL)""",
)
def s_format(t):
    return t("data_discovery").where("storage_path is not null").select("id", paths.format_of(F.col("storage_path")).alias("format"))
