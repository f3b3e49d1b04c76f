"""Sources, writes and streams as queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from metaloom.operators import catalog as C
from metaloom.operators import dedup as D
from metaloom.operators import ingest as K
from metaloom.plans.base import COLS, SCANS, sid
from metaloom.plans.profiling import _SK
from metaloom.registry import Registry
from metaloom.sources import containers, dictionary, files
from metaloom.streaming import feeds
from metaloom.util import loose_id, shared_dir

R = Registry()


def _raw(name: str, sql: str | None = None):
    """Register a function of (spark, folder) as it is."""

    def keep(f):
        R.queries[name] = f
        if sql is not None:
            R.sql[name] = sql
        return f

    return keep


@_raw("src_S1_S5_listing")
def s_listing(spark, d):
    return files.listing(spark, d, (".parquet",)).select("name", "folder", "format", "size")


@_raw("src_S3_containers")
def s_containers(spark, d):
    spark.dataSource.register(containers.ContainerSource)
    from metaloom.util import ship

    ship(spark)
    return spark.read.format("containers").option("owner", "driver").load(d if "://" in d else f"file://{d}")


@_raw("src_S4_magic", "SELECT 'PAR1' AS magic, 17::BIGINT AS n")
def s_magic(spark, d):
    b = files.byte_range(spark, d, -4, 4)
    return b.groupBy(F.col("bytes").cast("string").alias("magic")).agg(F.count("*").alias("n"))


@_raw("src_S6_S8_parquet")
def s_parquet(spark, d):
    return files.parquet_profile(spark, d).select(files.file_of(F.col("path")).alias("file"), "num_rows", "num_row_groups", "column", "type", "nullable")


@R.add("src_S9_csv", "SELECT 'c' || c_custkey AS path, unnest(['c_custkey', 'c_name', 'column_3']) AS column, 'string' AS type, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS sample FROM customer")
def s_csv(t):
    """A file of two lines for each customer; the third column has no name."""
    k = F.col("c_custkey").cast("string")
    return _profiled(t("customer"), "csv", F.concat(F.lit("c_custkey,c_name,\n"), k, F.lit(","), "c_name", F.lit(","), "c_mktsegment"))


@R.add("src_S10_json", "SELECT 'c' || c_custkey AS path, unnest(['k', 'name']) AS column, 'string' AS type, unnest([CAST(c_custkey AS VARCHAR), '\"' || c_name || '\"']) AS sample FROM customer")
def s_json(t):
    """An array of two objects for each customer, the second with a key that the first lacks."""
    one = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return _profiled(t("customer"), "json", F.concat(F.lit("["), F.to_json(one), F.lit(', {"k": 1, "other": 2}]')))


@R.add("src_S13_xml", "SELECT 'c' || c_custkey AS path, unnest(['c', 'c.name', 'c.part', 'c.part.size']) AS column, 'string' AS type, unnest([NULL, c_name, NULL, c_mktsegment]) AS sample FROM customer")
def s_xml(t):
    """A document for each customer with a repeated element."""
    return _profiled(t("customer"), "xml", F.concat(F.lit("<c><name>"), "c_name", F.lit("</name><part><size>"), "c_mktsegment", F.lit("</size></part><part><size>x</size></part></c>")))


def _profiled(customers, form, text):
    f = customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.lit(form).alias("format"), text.alias("text"))
    return files.text_profile(f).select("path", "column", "type", F.get("samples", F.lit(0)).alias("sample"))


_KINDS = "CASE WHEN {0} IN ('l_orderkey', 'l_quantity') THEN 'NUMBER' ELSE 'VARCHAR2' END"


@R.add("src_S17_schemas", "SELECT DISTINCT upper(catalog) AS owner FROM assets WHERE type = 'table' AND upper(catalog) NOT IN ('SYS', 'SYSTEM')")
def s_schemas(t):
    return dictionary.schemas(t("assets").where("type = 'table'").select(F.col("catalog").alias("owner"), F.col("name").alias("table_name")))


@R.add("src_S17_A8_sources", "SELECT CAST(l_orderkey AS VARCHAR) AS name, string_agg('line ' || l_linenumber || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS code FROM lineitem GROUP BY 1")
def s_sources(t):
    li = t("lineitem").select(F.lit("O").alias("owner"), F.col("l_orderkey").cast("string").alias("name"), F.lit("PROCEDURE").alias("type"), F.col("l_linenumber").alias("line"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" "), "l_returnflag", F.lit("\n")).alias("text"))
    return dictionary.sources(li).select("name", "code")


@R.add("src_S17_A7_J16_foreign_keys", "SELECT 'FK' || n_nationkey AS constraint_name, 'NATION' AS table_name, 'REGION' AS r_table_name, 'A' || n_nationkey || ',B' AS columns, 'R' || n_regionkey || ',S' AS r_columns FROM nation")
def s_fk(t):
    n = t("nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_regionkey").cast("string").alias("r"))
    cons = n.select(F.lit("O").alias("owner"), F.concat(F.lit("FK"), "k").alias("constraint_name"), F.lit("R").alias("constraint_type"), F.lit("NATION").alias("table_name"), F.lit("O").alias("r_owner"), F.concat(F.lit("PK"), "r").alias("r_constraint_name"))
    mine = n.select(F.concat(F.lit("FK"), "k").alias("c"), F.lit("NATION").alias("t"), F.array(F.struct(F.lit(2).alias("position"), F.lit("B").alias("column_name")), F.struct(F.lit(1).alias("position"), F.concat(F.lit("A"), "k").alias("column_name"))).alias("x"))
    ref = n.select("r").distinct().select(F.concat(F.lit("PK"), "r").alias("c"), F.lit("REGION").alias("t"), F.array(F.struct(F.lit(2).alias("position"), F.lit("S").alias("column_name")), F.struct(F.lit(1).alias("position"), F.concat(F.lit("R"), "r").alias("column_name"))).alias("x"))
    cols = mine.unionByName(ref).select(F.lit("O").alias("owner"), F.col("c").alias("constraint_name"), F.col("t").alias("table_name"), F.inline("x"))
    return dictionary.foreign_keys(cons, cols).select("constraint_name", "table_name", "r_table_name", "columns", "r_columns")


# writes


def _written(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/metaloom/{tag}-{uuid.uuid4().hex}"


@R.add("sink_K1_append", "SELECT storage_type, count(*) AS n, sum(id)::BIGINT AS ids FROM data_discovery GROUP BY 1")
def k_append(t):
    d = t("data_discovery").select("id", "asset_id", F.coalesce("storage_type", F.lit("none")).alias("storage_type"))
    path = _written(d.sparkSession, "append")
    K.append(d, path, ["storage_type"])
    r = d.sparkSession.read.schema(d.schema).parquet(path)
    return r.groupBy(F.nullif("storage_type", F.lit("none")).alias("storage_type")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@R.add(
    "sink_K2_insert_ignore",
    """WITH n AS (SELECT source_asset_id, target_asset_id, source_job_id, min(id) AS id FROM lineage_relationships WHERE created_at >= TIMESTAMP '2025-04-01' GROUP BY 1, 2, 3)
    SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM lineage_relationships e WHERE e.created_at < TIMESTAMP '2025-04-01' AND e.source_asset_id IS NOT DISTINCT FROM n.source_asset_id AND e.target_asset_id IS NOT DISTINCT FROM n.target_asset_id AND e.source_job_id IS NOT DISTINCT FROM n.source_job_id)""",
)
def k_ignore(t):
    """Edges since April into those from before."""
    e, now = t("lineage_relationships"), F.lit(datetime(2025, 4, 1))
    cols = ["source_asset_id", "target_asset_id", "source_job_id"]
    return K.insert_ignore(e.where(F.col("created_at") >= now).select(*cols, "id"), e.where(F.col("created_at") < now).select(*cols), cols, "id")


@R.add(
    "sink_K3_upsert",
    f"""WITH {SCANS}, n AS (SELECT asset_id AS id, arg_max_null(storage_path, id) AS catalog FROM sc WHERE asset_id IS NOT NULL GROUP BY 1), o AS (SELECT {sid('id')} AS id, name, type, catalog FROM assets)
    SELECT coalesce(o.id, n.id) AS id, o.name, o.type, coalesce(n.catalog, o.catalog) AS catalog FROM o FULL JOIN n ON n.id = o.id""",
)
def k_upsert(t):
    n = C.scans(t("data_discovery")).where("asset_id is not null").groupBy(F.col("asset_id").alias("id")).agg(F.max_by("storage_path", "id").alias("catalog"))
    return K.upsert(t("assets").select(loose_id("id").alias("id"), "name", "type", "catalog"), n, "id")


_PAY = """p AS (SELECT 'job-' || o_custkey AS ingestion_id, 'urn:process:' || o_custkey AS process_urn, list(DISTINCT 'urn:dataset:in:' || o_orderpriority) AS i, list(DISTINCT 'urn:dataset:out:' || o_orderstatus) AS o FROM orders GROUP BY o_custkey)"""


def _payloads(t):
    o = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("urn:dataset:in:"), "o_orderpriority"))).alias("inputs"), F.array_sort(F.collect_set(F.concat(F.lit("urn:dataset:out:"), "o_orderstatus"))).alias("outputs"))
    k = F.col("o_custkey").cast("string")
    return o.select(F.concat(F.lit("job-"), k).alias("ingestion_id"), F.concat(F.lit("urn:process:"), k).alias("process_urn"), "inputs", "outputs", F.lit("2025-01-01").alias("valid_from"))


@R.add("sink_K4_ingest", f"WITH {_PAY} SELECT sha256(s || '|' || process_urn || '|' || d || '|2025-01-01') AS edge_hash, process_urn, s AS source_urn, d AS target_urn FROM (SELECT process_urn, unnest(i) AS s, o FROM p WHERE ingestion_id NOT LIKE '%7'), unnest(o) AS x(d)")
def k_ingest(t):
    p = _payloads(t)
    return K.ingest(p, p.where("ingestion_id like '%7'"))[1].select("edge_hash", "process_urn", "source_urn", "target_urn")


@R.add(
    "sink_K6_edit_columns",
    f"""WITH {COLS} SELECT asset_id, pos, c ->> '$.name' AS name, CASE WHEN c ->> '$.name' = 'email' THEN true WHEN c ->> '$.name' = 'notes' THEN false ELSE CAST(c -> '$.pii_detected' AS BOOLEAN) END AS pii_detected,
    CASE WHEN c ->> '$.name' = 'email' THEN 'mask_domain' WHEN c ->> '$.name' = 'notes' THEN NULL ELSE c ->> '$.masking_logic_analytical' END AS masking_logic_analytical FROM cols WHERE c ->> '$.name' IS NOT NULL""",
)
def k_edit(t):
    a = t("assets")
    c = C.asset_columns(a)
    e = c.where("name in ('email', 'notes')").select("asset_id", "name").distinct().select(
        F.col("asset_id").alias("id"), "name", (F.col("name") == "email").alias("pii_detected"), F.lit(None).cast("array<string>").alias("pii_types"), F.lit(" mask_domain ").alias("analytical"), F.lit(" ").alias("operational")
    )
    return C.asset_columns(K.edit_columns(a, e)).select("asset_id", F.col("pos").cast("bigint").alias("pos"), "name", "pii_detected", "masking_logic_analytical")


@R.add("sink_K7_create", "SELECT DISTINCT 'new_' || c_custkey AS id FROM customer WHERE c_name <> '' UNION SELECT c_name FROM customer WHERE false")
def k_create(t):
    n = t("customer").select(F.concat(F.lit("new_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("table").alias("type"), F.lit("crm").alias("catalog"))
    old = t("assets").select("id", "name", "type", "catalog")
    return K.create_assets(n.unionByName(old), old).select("id")


_GONE = f"g AS (SELECT {sid('id')} AS k FROM assets WHERE connector_id = 'azure_blob_lakecore')"


@R.add("sink_K8_delete", f"WITH {_GONE} SELECT id FROM lineage_relationships WHERE coalesce({sid('source_asset_id')} NOT IN (SELECT k FROM g), true) AND coalesce({sid('target_asset_id')} NOT IN (SELECT k FROM g), true)")
def k_delete(t):
    return K.delete_connection(t("assets"), t("data_discovery"), t("lineage_relationships"), "azure_blob_lakecore")[2].select("id")


@R.add("sink_K9_hide", f"WITH {_SK} SELECT d.id, d.is_visible AND coalesce(k4.r = 1 OR k4.n = 1, true) AS is_visible FROM data_discovery d LEFT JOIN k4 USING (id)")
def k_hide(t):
    d = t("data_discovery")
    return K.hide(d, D.schema_duplicates(d)).select("id", "is_visible")


@R.add("sink_K9_restore", "SELECT id, is_visible OR coalesce(storage_type = 'aws_s3', false) AS is_visible FROM data_discovery")
def k_restore(t):
    """Hidden scans of one kind of store come back."""
    d = t("data_discovery")
    return K.restore(d, d.where("storage_type = 'aws_s3'")).select("id", "is_visible")


@R.add(
    "sink_K9_merge_edges",
    """SELECT source_asset_id, target_asset_id, source_job_id, id, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY source_asset_id, target_asset_id, source_job_id ORDER BY coalesce(confidence_score, -1) DESC, id) AS r FROM lineage_relationships) WHERE r = 1""",
)
def k_merge(t):
    """Edges since April with those from before, the most trusted of each key."""
    e = t("lineage_relationships").select("source_asset_id", "target_asset_id", "source_job_id", "id", "confidence_score", "created_at")
    new = F.coalesce(F.col("created_at") >= F.lit(datetime(2025, 4, 1)), F.lit(False))
    return K.merge_edges(e.where(new).drop("created_at"), e.where(~new).drop("created_at"))


@R.add("sink_K10_notified", "SELECT id, CASE WHEN created_at > TIMESTAMP '2025-06-01' - INTERVAL 600 MINUTES AND created_at <= TIMESTAMP '2025-06-01' THEN TIMESTAMP '2025-06-01' END AS notification_sent_at FROM data_discovery")
def k_notified(t):
    d, now = t("data_discovery"), datetime(2025, 6, 1)
    return K.mark_notified(d, C.recent(d, now, 600), F.lit(now).cast("timestamp")).select("id", F.col("notification_sent_at").cast("timestamp_ntz").alias("notification_sent_at"))


@R.add("sink_K12_csv", f"WITH {COLS} SELECT asset_id, c ->> '$.name' AS name, c ->> '$.type' AS type, nullif(c ->> '$.description', '') AS description FROM cols WHERE c ->> '$.name' IS NOT NULL")
def k_csv(t):
    c = C.asset_columns(t("assets")).select("asset_id", "name", "type", "description")
    path = _written(c.sparkSession, "csv")
    K.export_csv(c, path)
    return files.read(c.sparkSession, path, "csv")


# streams


@_raw("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def st_first(spark, d):
    s = feeds.files(spark, d, "events.parquet").select("user_id", "event_type", "ts")
    return feeds.once(feeds.first_seen(s, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), tag="first")


@_raw("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def st_windows(spark, d):
    s = feeds.files(spark, d, "events.parquet").select("event_type", "ts")
    return feeds.once(feeds.windowed_counts(s, "ts", "event_type"), tag="windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_raw("stream_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def st_latest(spark, d):
    s = feeds.files(spark, d, "events.parquet").select("user_id", "ts", "event_id", "event_type")
    at = _written(spark, "latest")
    return feeds.keep_latest(s, "user_id", ["ts", "event_id"], f"{at}/table", f"{at}/state").select("user_id", "event_id", "event_type")
