"""The catalog: listing, search, paging, lookups and statistics over assets and their scans.

Ids compare loosely throughout. Ranks are taken with max_by or one window, never by collecting; the
only broadcasts are those Spark chooses from measured sizes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.util import loose_id

#: Keys of a connection's configuration that hold a secret contain one of these (fixed values).
SECRET_WORDS = "password passwd pwd secret key token credential connection_string sas private auth"
#: Extraction methods that the lineage view shows (fixed values).
SHOWN_METHODS = (
    "sql_parsing", "sql_column_parsing", "join_analysis", "ml_inference", "procedure_parsing", "trigger_analysis", "column_matching", "sql_column_analysis",
    "folder_hierarchy", "naming_pattern", "schema_matching", "sql_reference", "etl_pattern", "name_similarity", "cross_platform_matching", "name_matching",
    "manual", "api", "etl", "dbt", "databricks", "regex_fallback", "oracle_metadata",
)
COLUMN = (
    "array<struct<name: string, type: string, type_info: string, nullable: boolean, pii_detected: boolean, pii_types: array<string>, "
    "description: string, masking_logic_analytical: string, masking_logic_operational: string>>"
)


def document(c: Column | str) -> Column:
    """A JSON document, also if delivered as JSON text inside a JSON string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r'^\s*"'), F.get_json_object(c, "$")).otherwise(c)


def asset_columns(assets: DataFrame) -> DataFrame:
    """(asset_id, pos, name, type, type_info, nullable, pii_detected, pii_types, description,
    masking_logic_analytical, masking_logic_operational), a row per column of an asset. A lone object
    counts as an array of one; documents that are not complete JSON have no columns."""
    c = F.from_json(document("columns"), COLUMN)
    return assets.select(F.col("id").alias("asset_id"), F.posexplode(c).alias("pos", "c")).select("asset_id", "pos", "c.*").where("name is not null")


def scans(discovery: DataFrame) -> DataFrame:
    """Scans with a comparable asset_id; rows of no asset have none."""
    return discovery.withColumn("asset_id", loose_id("asset_id"))


def with_key(assets: DataFrame) -> DataFrame:
    return assets.withColumn("asset_id", loose_id("id"))


def latest_scan(discovery: DataFrame) -> DataFrame:
    """(asset_id, discovery_id): the scan with the largest id of each asset."""
    return scans(discovery).where("asset_id is not null").groupBy("asset_id").agg(F.max("id").alias("discovery_id"))


def listing(assets: DataFrame, discovery: DataFrame) -> DataFrame:
    """Assets with their latest visible scan: kept if they have a visible scan, or no scan at all. One
    aggregation finds both, so the scans are read and shuffled once."""
    d = scans(discovery).where("asset_id is not null").groupBy("asset_id").agg(
        F.max(F.when(F.col("is_visible"), F.col("id"))).alias("discovery_id"), F.lit(True).alias("has_scan")
    )
    return with_key(assets).join(d, "asset_id", "left").where("discovery_id is not null or has_scan is null").drop("has_scan")


def unscanned(assets: DataFrame, discovery: DataFrame) -> DataFrame:
    """Assets without any scan."""
    return with_key(assets).join(scans(discovery), "asset_id", "left_anti")


def search(assets: DataFrame, term: str) -> DataFrame:
    """Name or catalog contains the term, without case; % and _ of the term are taken literally."""
    t = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return assets.where(F.col("name").ilike(t) | F.col("catalog").ilike(t))


def approval_status(c: Column | str = "operational_metadata") -> Column:
    """The status in the document; where there is no document at all, pending_review."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "pending_review").otherwise(F.get_json_object(document(c), "$.approval_status"))


def of_application(assets: DataFrame, connections: DataFrame, name: str) -> DataFrame:
    """Assets of an application, named by their connection, their technical or business document."""
    c = connections.where(F.get_json_object("config", "$.application_name") == name).select(F.concat_ws("_", "connector_type", "name").alias("connector_id"))
    hit = assets.join(c.distinct().withColumn("hit", F.lit(True)), "connector_id", "left")
    own = [F.get_json_object(document(d), "$.application_name") == name for d in ("technical_metadata", "business_metadata")]
    return hit.where(F.coalesce(F.col("hit"), F.lit(False)) | F.coalesce(own[0], F.lit(False)) | F.coalesce(own[1], F.lit(False))).drop("hit")


def in_order(listed: DataFrame) -> list[Column]:
    """Newest first, assets without a scan last, then the larger scan, then the id: a total order."""
    return [F.col("discovered_at").desc_nulls_last(), F.col("discovery_id").isNull().asc(), F.col("discovery_id").desc_nulls_last(), F.col("id").asc()]


def page(listed: DataFrame, number: int, per_page: int = 50) -> DataFrame:
    """One page in listing order, at most 1000 rows."""
    per_page = max(1, min(1000, per_page))
    return listed.orderBy(*in_order(listed)).offset((max(1, number) - 1) * per_page).limit(per_page)


def page_info(listed: DataFrame, number: int, per_page: int = 50) -> DataFrame:
    """(total, total_pages, has_next, has_prev)."""
    n = F.count("*")
    pages = F.ceil(n / F.lit(per_page)).cast("bigint")
    return listed.agg(n.alias("total"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def applications(assets: DataFrame, connections: DataFrame) -> DataFrame:
    """(id, application_name), a row an asset: of the connection with the asset's connector_id, of several the
    first by id, else of the first whose id starts the connector_id. Connections are few; their number bounds the rows of the theta join,
    which only sees assets without an exact match."""
    c = connections.select(F.concat_ws("_", "connector_type", "name").alias("cid"), F.get_json_object("config", "$.application_name").alias("application_name"), F.col("id").alias("order"))
    c = c.groupBy("cid").agg(F.min(F.struct("order", "application_name")).alias("x")).select("cid", "x.application_name", "x.order")
    a = assets.select("id", "connector_id")
    exact = a.join(c, a.connector_id == c.cid, "left")
    rest = exact.where("cid is null").select("id", "connector_id").join(c, F.col("connector_id").startswith(F.col("cid")), "left")
    first = rest.groupBy("id").agg(F.min_by("application_name", "order").alias("application_name"))
    return exact.where("cid is not null").select("id", "application_name").unionByName(first)


def data_source(source_type: Column, connector_id: Column) -> Column:
    """The scan's own type, else by prefix of the connector, else its first word, else unknown."""
    own, cid = F.nullif(F.trim(source_type), F.lit("")), F.coalesce(connector_id, F.lit(""))
    first = F.nullif(F.substring_index(cid, "_", 1), F.lit(""))
    out = own
    for p in ("azure_blob", "aws_s3", "oracle_db"):
        out = F.coalesce(out, F.when(cid.startswith(p + "_"), p))
    return F.coalesce(out, first, F.lit("unknown"))


def s3_fields(path: Column, region: Column) -> Column:
    """struct(bucket, key, uri, arn, region) of an s3 address; null for any other."""
    p = r"^s3://([^/]+)/(.+)$"
    b, k = F.regexp_extract(path, p, 1), F.regexp_extract(path, p, 2)
    return F.when(path.rlike(p), F.struct(
        b.alias("bucket"), k.alias("key"), F.concat(F.lit("s3://"), b, F.lit("/"), k).alias("uri"), F.concat(F.lit("arn:aws:s3:::"), b, F.lit("/"), k).alias("arn"),
        F.coalesce(region, F.lit("us-east-1")).alias("region"),
    ))


def merged_columns(assets: DataFrame, discovery: DataFrame) -> DataFrame:
    """(asset_id, name, type, description, pii_detected, in_scan, in_asset): the columns of an asset's
    latest scan, with what the asset itself says about them, and the asset's further columns."""
    best = scans(discovery).where("asset_id is not null").groupBy("asset_id").agg(F.max_by("schema_json", "id").alias("doc"))
    doc = document("doc")
    arr = "array<struct<name: string, type: string, description: string>>"
    s = F.coalesce(F.from_json(F.get_json_object(doc, "$.columns"), arr), F.when(doc.rlike(r"^\s*\["), F.from_json(doc, arr)))
    s = best.select("asset_id", F.explode(s).alias("c")).select("asset_id", F.trim("c.name").alias("name"), F.col("c.type").alias("s_type"), F.col("c.description").alias("s_about")).where("name is not null").dropDuplicates(["asset_id", "name"])
    a = asset_columns(assets).select(loose_id("asset_id").alias("asset_id"), F.trim("name").alias("name"), F.col("type").alias("a_type"), F.col("description").alias("a_about"), "pii_detected", F.lit(True).alias("mine")).dropDuplicates(["asset_id", "name"])
    return s.withColumn("theirs", F.lit(True)).join(a, ["asset_id", "name"], "full").select(
        "asset_id", "name", F.coalesce("a_type", "s_type").alias("type"), F.coalesce(F.nullif("a_about", F.lit("")), "s_about").alias("description"),
        F.coalesce("pii_detected", F.lit(False)).alias("pii_detected"), F.col("theirs").isNotNull().alias("in_scan"), F.col("mine").isNotNull().alias("in_asset"),
    )


def redacted(connections: DataFrame) -> DataFrame:
    """Connections, newest first, with every secret of their configuration starred out."""
    conf = F.from_json("config", "map<string,string>")
    secret = "|".join(SECRET_WORDS.split())
    safe = F.transform_values(conf, lambda k, v: F.when(F.lower(k).rlike(secret), "***").otherwise(v))
    return connections.select("id", "name", "connector_type", safe.alias("config"), "status")


def recent(discovery: DataFrame, now: datetime, minutes: int = 20) -> DataFrame:
    """Scans that arrived within the last minutes."""
    return discovery.where((F.col("created_at") > F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("created_at") <= F.lit(now)))


def stats(discovery: DataFrame, now: datetime) -> DataFrame:
    """(dimension, value, n): scans in all, by status, by approval (null is unknown), of the last week.
    One pass with grouping sets instead of a query for each."""
    d = discovery.select(F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("approval_status", F.lit("unknown")).alias("approval"), "discovered_at")
    week = F.col("discovered_at") >= F.lit(now) - F.expr("INTERVAL 7 DAYS")
    g = d.groupingSets([["status"], ["approval"], []], "status", "approval").agg(F.count("*").alias("n"), F.count_if(week).alias("week"), F.grouping_id().alias("g"))
    rows = F.array(
        F.struct(F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "approval_status").otherwise("total").alias("dimension"), F.coalesce("status", "approval").alias("value"), F.col("n")),
        F.when(F.col("g") == 3, F.struct(F.lit("last_7_days").alias("dimension"), F.lit(None).cast("string").alias("value"), F.col("week").alias("n"))),
    )
    return g.select(F.inline(F.array_compact(rows)))


def best_match(assets: DataFrame, catalog: str, name: str) -> DataFrame:
    """(id, score): how well assets fit a catalog and name; 1 exact, 2 exact catalog and a name that
    contains or is contained, 3 the same with a catalog that contains or is contained. First hit only."""
    n, c = F.lower("name"), F.lower("catalog")
    name, catalog = name.lower(), catalog.lower()
    near = n.contains(name) | (F.lit(name).contains(n) & (n != ""))
    near_c = c.contains(catalog) | (F.lit(catalog).contains(c) & (c != ""))
    score = F.when((c == catalog) & (n == name), 1).when((c == catalog) & near, 2).when(near_c & near, 3)
    return assets.select("id", score.alias("score")).where("score is not null").orderBy("score", "id").limit(1)


def facets(assets: DataFrame, connections: DataFrame) -> DataFrame:
    """(facet, value, n): types, catalogs and applications with their numbers of assets."""
    a = applications(assets, connections)
    w = assets.join(a, "id").select("type", "catalog", F.coalesce("application_name", F.get_json_object(document("technical_metadata"), "$.application_name"), F.get_json_object(document("business_metadata"), "$.application_name")).alias("application"))
    pairs = F.array(*(F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in ("type", "catalog", "application")))
    return w.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def relationships(lineage: DataFrame, methods=SHOWN_METHODS) -> DataFrame:
    """Edges of the shown methods; no confidence, or none at all, counts as a half."""
    conf = F.col("confidence_score").cast("double")
    return lineage.where(F.lower("extraction_method").isin(*methods)).withColumn("confidence_score", F.when(conf.isNull() | (conf == 0), 0.5).otherwise(conf))


def actual(lineage: DataFrame) -> DataFrame:
    """Edges between real assets: no containers, no folders, no mere containment."""
    s, t = loose_id("source_asset_id"), loose_id("target_asset_id")
    bad = s.startswith("container_") | s.startswith("folder_") | t.startswith("container_") | t.startswith("folder_")
    return lineage.where(~F.coalesce(bad, F.lit(False)) & ~F.coalesce(F.col("relationship_type").isin("contains", "folder_hierarchy"), F.lit(False)))


def active_tags(tags: DataFrame, workspace: str | None = None) -> DataFrame:
    """Tags that are not deleted, of one workspace if given, by name."""
    t = tags.where(~F.coalesce("is_deleted", F.lit(False)))
    return (t if workspace is None else t.where(F.col("workspace") == workspace)).orderBy("name")


def asset_tags(assets: DataFrame) -> DataFrame:
    """(tag, n): the tags of the business documents and how many assets bear each."""
    t = F.from_json(F.get_json_object(document("business_metadata"), "$.tags"), "array<string>")
    return assets.select(F.explode(F.array_distinct(t)).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


def hidden(discovery: DataFrame) -> DataFrame:
    """Hidden scans with their place in the order of the listing (last update, then id)."""
    h = discovery.where(~F.col("is_visible"))
    return h.select("id", "asset_id", "storage_path", "updated_at")

