"""Catalog queries: listing, search, paging, lookups, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from metaloom.operators import catalog as C
from metaloom.plans.base import COLS, SCANS, doc, sid
from metaloom.registry import Registry

R = Registry()
NOW = datetime(2025, 6, 1)

_LISTED = f"""{SCANS},
ls AS (SELECT a.*, {sid('a.id')} AS asset_id, d.discovery_id FROM assets a LEFT JOIN
  (SELECT asset_id, max(id) FILTER (is_visible) AS discovery_id, true AS has_scan FROM sc WHERE asset_id IS NOT NULL GROUP BY 1) d ON d.asset_id = {sid('a.id')}
  WHERE d.discovery_id IS NOT NULL OR d.has_scan IS NULL)"""


@R.add("cat_P1_J1_A1_listing", f"WITH {_LISTED} SELECT id, name, type, catalog, connector_id, discovered_at, discovery_id FROM ls")
def cat_listing(t):
    return C.listing(t("assets"), t("data_discovery")).select("id", "name", "type", "catalog", "connector_id", "discovered_at", "discovery_id")


@R.add("cat_J2_unscanned", f"WITH {SCANS} SELECT id, name FROM assets a WHERE {sid('a.id')} NOT IN (SELECT asset_id FROM sc WHERE asset_id IS NOT NULL)")
def cat_unscanned(t):
    return C.unscanned(t("assets"), t("data_discovery")).select("id", "name")


@R.add("cat_P2_search", "SELECT id, name, catalog FROM assets WHERE name ILIKE '%policy%' OR catalog ILIKE '%policy%'")
def cat_search(t):
    return C.search(t("assets"), "policy").select("id", "name", "catalog")


@R.add("cat_P3_filter", "SELECT id, type, catalog FROM assets WHERE type IN ('table', 'view') AND lower(catalog) IN ('claims', 'loans', 'pricing')")
def cat_filter(t):
    return t("assets").where(F.col("type").isin("table", "view") & F.lower("catalog").isin("claims", "loans", "pricing")).select("id", "type", "catalog")


@R.add(
    "cat_P4_approval",
    f"SELECT id, CASE WHEN operational_metadata IS NULL THEN 'pending_review' ELSE {doc('operational_metadata')} ->> '$.approval_status' END AS approval_status FROM assets",
)
def cat_approval(t):
    return t("assets").select("id", C.approval_status().alias("approval_status"))


@R.add(
    "cat_P5_J3_application",
    f"""SELECT id, connector_id FROM assets a WHERE EXISTS (SELECT 1 FROM connections c WHERE c.connector_type || '_' || c.name = a.connector_id AND c.config ->> '$.application_name' = 'Logistics Hub')
    OR {doc('technical_metadata')} ->> '$.application_name' = 'Logistics Hub' OR {doc('business_metadata')} ->> '$.application_name' = 'Logistics Hub'""",
)
def cat_application(t):
    return C.of_application(t("assets"), t("connections"), "Logistics Hub").select("id", "connector_id")


_ORDER = "discovered_at DESC NULLS LAST, (discovery_id IS NULL) ASC, discovery_id DESC NULLS LAST, id ASC"


@R.add("cat_P6_P7_page", f"WITH {_LISTED} SELECT id, discovered_at, discovery_id FROM ls ORDER BY {_ORDER} LIMIT 50 OFFSET 100")
def cat_page(t):
    return C.page(C.listing(t("assets"), t("data_discovery")), 3, 50).select("id", "discovered_at", "discovery_id")


@R.add("cat_P7_page_info", f"WITH {_LISTED} SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < CAST(ceil(count(*) / 50.0) AS BIGINT) AS has_next, true AS has_prev FROM ls")
def cat_page_info(t):
    return C.page_info(C.listing(t("assets"), t("data_discovery")), 3, 50)


_APPS = """
cn AS (SELECT connector_type || '_' || name AS cid, config ->> '$.application_name' AS app, id AS o FROM connections),
ap AS (SELECT a.id, CASE WHEN e.cid IS NOT NULL THEN e.app ELSE (SELECT arg_min_null(p.app, p.o) FROM cn p WHERE starts_with(a.connector_id, p.cid)) END AS application_name
  FROM assets a LEFT JOIN cn e ON e.cid = a.connector_id)"""


@R.add("cat_P8_J18_applications", f"WITH {_APPS} SELECT id, application_name FROM ap")
def cat_applications(t):
    return C.applications(t("assets"), t("connections"))


@R.add(
    "cat_P9_data_source",
    f"""WITH {_LISTED} SELECT ls.id, coalesce(nullif(trim(d.data_source_type), ''), CASE WHEN starts_with(ls.connector_id, 'azure_blob_') THEN 'azure_blob' WHEN starts_with(ls.connector_id, 'aws_s3_') THEN 'aws_s3'
    WHEN starts_with(ls.connector_id, 'oracle_db_') THEN 'oracle_db' END, nullif(split_part(ls.connector_id, '_', 1), ''), 'unknown') AS data_source FROM ls LEFT JOIN data_discovery d ON d.id = ls.discovery_id""",
)
def cat_data_source(t):
    d = t("data_discovery").select(F.col("id").alias("discovery_id"), "data_source_type")
    return C.listing(t("assets"), t("data_discovery")).join(d, "discovery_id", "left").select("id", C.data_source(F.col("data_source_type"), F.col("connector_id")).alias("data_source"))


@R.add(
    "cat_P10_s3_fields",
    """SELECT id, regexp_extract(storage_path, '^s3://([^/]+)/(.+)$', 1) AS bucket, regexp_extract(storage_path, '^s3://([^/]+)/(.+)$', 2) AS key,
    'arn:aws:s3:::' || regexp_extract(storage_path, '^s3://([^/]+)/(.+)$', 1) || '/' || regexp_extract(storage_path, '^s3://([^/]+)/(.+)$', 2) AS arn, 'us-east-1' AS region
    FROM data_discovery WHERE regexp_matches(storage_path, '^s3://([^/]+)/(.+)$')""",
)
def cat_s3(t):
    d = t("data_discovery").select("id", C.s3_fields(F.col("storage_path"), F.lit(None).cast("string")).alias("x")).where("x is not null")
    return d.select("id", "x.bucket", "x.key", "x.arn", "x.region")


@R.add(
    "cat_P11_J4_discoveries",
    f"""WITH {SCANS} SELECT sc.id, sc.status, sc.approval_status, sc.discovered_at, a.name FROM sc LEFT JOIN assets a ON {sid('a.id')} = sc.asset_id
    WHERE sc.status = 'approved' AND coalesce(sc.approval_status, 'unknown') <> 'rejected'""",
)
def cat_discoveries(t):
    a = C.with_key(t("assets")).select("asset_id", "name")
    d = C.scans(t("data_discovery")).where((F.col("status") == "approved") & (F.coalesce("approval_status", F.lit("unknown")) != "rejected"))
    return d.join(a, "asset_id", "left").select("id", "status", "approval_status", "discovered_at", "name")


@R.add(
    "cat_P12_merged_columns",
    f"""WITH {COLS}, {SCANS},
    b AS (SELECT asset_id, arg_max_null(schema_json, id) AS s FROM sc WHERE asset_id IS NOT NULL GROUP BY 1),
    b1 AS (SELECT asset_id, {doc('s')} AS s FROM b),
    b2 AS (SELECT asset_id, CASE WHEN json_type(s) = 'ARRAY' THEN s WHEN json_type(s, '$.columns') = 'ARRAY' THEN s -> '$.columns' END AS s FROM b1),
    b3 AS (SELECT asset_id, unnest(json_extract(s, '$[*]')) AS c FROM b2 WHERE json_array_length(s) > 0),
    s AS (SELECT asset_id, trim(c ->> '$.name') AS name, any_value(c ->> '$.type') AS t, any_value(c ->> '$.description') AS d FROM b3 WHERE c ->> '$.name' IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT {sid('asset_id')} AS asset_id, trim(c ->> '$.name') AS name, any_value(c ->> '$.type') AS t, any_value(c ->> '$.description') AS d, any_value(CAST(c -> '$.pii_detected' AS BOOLEAN)) AS p FROM cols WHERE c ->> '$.name' IS NOT NULL GROUP BY 1, 2)
    SELECT asset_id, name, coalesce(a.t, s.t) AS type, coalesce(nullif(a.d, ''), s.d) AS description, coalesce(a.p, false) AS pii_detected, s.name IS NOT NULL AS in_scan, a.name IS NOT NULL AS in_asset
    FROM s FULL JOIN a USING (asset_id, name)""",
)
def cat_merged(t):
    return C.merged_columns(t("assets"), t("data_discovery"))


@R.add("cat_P13_hidden", "SELECT id, asset_id, storage_path, updated_at FROM data_discovery WHERE NOT is_visible")
def cat_hidden(t):
    return C.hidden(t("data_discovery"))


@R.add(
    "cat_P14_redacted",
    """WITH k AS (SELECT id, unnest(json_keys(config)) AS key, config FROM connections WHERE json_valid(config)),
    v AS (SELECT id, string_agg(key || '=' || CASE WHEN regexp_matches(lower(key), 'password|passwd|pwd|secret|key|token|credential|connection_string|sas|private|auth') THEN '***' ELSE coalesce(config ->> ('$."' || key || '"'), '') END, ';' ORDER BY key) AS config FROM k GROUP BY 1)
    SELECT c.id, c.name, c.connector_type, coalesce(v.config, '') AS config, c.status FROM connections c LEFT JOIN v USING (id)""",
)
def cat_redacted(t):
    c = F.array_sort(F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return C.redacted(t("connections")).withColumn("config", F.coalesce(F.array_join(c, ";"), F.lit("")))


@R.add(
    "cat_P15_tags",
    f"""WITH b AS (SELECT id, {doc('business_metadata')} AS j FROM assets), u AS (SELECT DISTINCT id, unnest(json_extract_string(j, '$.tags[*]')) AS tag FROM b WHERE json_type(j, '$.tags') = 'ARRAY')
    SELECT tag, count(*) AS n FROM u WHERE tag IS NOT NULL GROUP BY 1""",
)
def cat_tags(t):
    return C.asset_tags(t("assets"))


@R.add("cat_P16_recent", "SELECT id, created_at FROM data_discovery WHERE created_at > TIMESTAMP '2025-06-01' - INTERVAL 600 MINUTES AND created_at <= TIMESTAMP '2025-06-01'")
def cat_recent(t):
    return C.recent(t("data_discovery"), NOW, 600).select("id", "created_at")


@R.add(
    "cat_P17_best_match",
    """SELECT id, score FROM (SELECT id, CASE WHEN lower(catalog) = 'claims' AND lower(name) = 'web_session' THEN 1
    WHEN lower(catalog) = 'claims' AND (contains(lower(name), 'web_session') OR (contains('web_session', lower(name)) AND name <> '')) THEN 2
    WHEN (contains(lower(catalog), 'claims') OR (contains('claims', lower(catalog)) AND catalog <> '')) AND (contains(lower(name), 'web_session') OR (contains('web_session', lower(name)) AND name <> '')) THEN 3 END AS score FROM assets)
    WHERE score IS NOT NULL ORDER BY score, id LIMIT 1""",
)
def cat_best_match(t):
    return C.best_match(t("assets"), "Claims", "web_session")


@R.add(
    "cat_P18_A4_facets",
    f"""WITH {_APPS}, w AS (SELECT a.type, a.catalog, coalesce(ap.application_name, {doc('technical_metadata')} ->> '$.application_name', {doc('business_metadata')} ->> '$.application_name') AS application FROM assets a JOIN ap USING (id))
    SELECT facet, value, count(*) AS n FROM (SELECT 'type' AS facet, type AS value FROM w UNION ALL SELECT 'catalog', catalog FROM w UNION ALL SELECT 'application', application FROM w) WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def cat_facets(t):
    return C.facets(t("assets"), t("connections"))


@R.add("cat_P19_A9_latest", f"WITH {SCANS} SELECT asset_id, max(id) AS discovery_id FROM sc WHERE asset_id IS NOT NULL GROUP BY 1")
def cat_latest(t):
    return C.latest_scan(t("data_discovery"))


_SHOWN = ", ".join(f"'{m}'" for m in C.SHOWN_METHODS)


@R.add("cat_P20_relationships", f"SELECT id, extraction_method, CASE WHEN confidence_score IS NULL OR confidence_score = 0 THEN 0.5 ELSE CAST(confidence_score AS DOUBLE) END AS confidence_score FROM lineage_relationships WHERE lower(extraction_method) IN ({_SHOWN})")
def cat_relationships(t):
    return C.relationships(t("lineage_relationships")).select("id", "extraction_method", "confidence_score")


@R.add(
    "cat_P21_actual",
    f"""SELECT id FROM lineage_relationships WHERE NOT coalesce(starts_with({sid('source_asset_id')}, 'container_') OR starts_with({sid('source_asset_id')}, 'folder_') OR starts_with({sid('target_asset_id')}, 'container_')
    OR starts_with({sid('target_asset_id')}, 'folder_'), false) AND coalesce(relationship_type NOT IN ('contains', 'folder_hierarchy'), true)""",
)
def cat_actual(t):
    return C.actual(t("lineage_relationships")).select("id")


@R.add(
    "cat_I14_A2_A3_stats",
    """SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM data_discovery UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM data_discovery GROUP BY 2
    UNION ALL SELECT 'approval_status', coalesce(approval_status, 'unknown'), count(*) FROM data_discovery GROUP BY 2
    UNION ALL SELECT 'last_7_days', NULL, count(*) FROM data_discovery WHERE discovered_at >= TIMESTAMP '2025-06-01' - INTERVAL 7 DAYS""",
)
def cat_stats(t):
    return C.stats(t("data_discovery"), NOW)


@R.add("cat_A5_A6_groups", "SELECT lower(catalog) AS catalog, count(*) AS n, string_agg(DISTINCT connector_id, ',' ORDER BY connector_id) AS connectors FROM assets WHERE catalog IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def cat_groups(t):
    g = t("assets").where("catalog is not null").groupBy(F.lower("catalog").alias("catalog")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("connector_id")), ",").alias("connectors"))
    return g.where("n > 1")


@R.add("cat_S21_connections", "SELECT id, name, connector_type FROM connections WHERE status = 'active' AND connector_type = 'azure_blob'")
def cat_connections(t):
    return t("connections").where("status = 'active' and connector_type = 'azure_blob'").select("id", "name", "connector_type")


@R.add(
    "cat_generated_columns",
    f"""SELECT id, coalesce({doc('storage_location')} ->> '$.type', '') AS storage_type, coalesce({doc('storage_location')} ->> '$.path', '') AS storage_path,
    coalesce({doc('file_metadata')} ->> '$.basic.name', {doc('file_metadata')} ->> '$.file_name') AS file_name FROM data_discovery""",
)
def cat_generated(t):
    s, f = C.document("storage_location"), C.document("file_metadata")
    return t("data_discovery").select(
        "id", F.coalesce(F.get_json_object(s, "$.type"), F.lit("")).alias("storage_type"), F.coalesce(F.get_json_object(s, "$.path"), F.lit("")).alias("storage_path"),
        F.coalesce(F.get_json_object(f, "$.basic.name"), F.get_json_object(f, "$.file_name")).alias("file_name"),
    )


