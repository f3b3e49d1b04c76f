"""Profiles and quality of columns and assets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.operators.catalog import asset_columns, document
from metaloom.util import loose_id

#: How much of a source's quality a step is expected to keep (fixed values).
KEPT = {"pass_through": 0.95, "aggregate": 0.90, "join": 0.85, "complex": 0.80}


def inferred_type(values: DataFrame, keys: list[str], value: str, order: str, first: int = 100, share: float = 0.8) -> DataFrame:
    """(keys, n, type) of string values: the first of int64, double, bool, date that holds for at least
    `share` of all non-blank values among the first ones in order; else string.

    The first values are found by a rank limit, which Spark applies before the shuffle, so a group's
    values are never gathered; counts are aggregated apart from them."""
    v = values.where(F.trim(value) != "").select(*keys, F.col(order).alias("__o"), F.trim(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__o", "__v")
    head = v.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= first)
    head = head.groupBy(*keys).agg(F.collect_list("__v").alias("s"))
    v = v.groupBy(*keys).agg(F.count("*").alias("n")).join(head, keys)
    text = F.col("s")

    def hits(p: str) -> Column:
        return F.size(F.filter(text, lambda x: x.rlike(p)))

    need = F.col("n") * share
    whole = hits(r"^[+-]?[0-9]+(_[0-9]+)*$")
    number = hits(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    flag = hits(r"(?i)^(true|false|yes|no|0|1)$")
    day = hits(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}).*$")
    t = F.when(whole >= need, "int64").when(number >= need, "double").when(flag >= need, "bool").when(day >= need, "date").otherwise("string")
    return v.select(*keys, F.col("n").cast("bigint").alias("n"), t.alias("type"))


def json_type(c: Column) -> Column:
    """null, bool, int64, double, string, array<T of the first element> or object of a JSON value."""
    def one(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^(true|false)$"), "bool").when(x.rlike(r"^-?[0-9]+$"), "int64").when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "double")
            .when(x == "null", "null").when(x.startswith("["), "array").when(x.startswith("{"), "object").otherwise("string")
        )

    t = F.trim(c)
    first = F.trim(F.regexp_extract(t, r"^\[\s*((?:\"[^\"]*\"|[^,\]\[{}]+|[\[{])?)", 1))
    return F.when(t.isNull(), "null").when(t.startswith("["), F.when(first == "", "array<string>").otherwise(F.concat(F.lit("array<"), one(first), F.lit(">")))).otherwise(one(t))


def value_type(document: Column, key: Column) -> Column:
    """null, bool, int64, double, string, array<T> or object of what a parsed document holds under a key."""
    inner = F.variant_get(document, F.concat(F.lit("$['"), key, F.lit("']")), "variant")
    t = F.schema_of_variant(inner)

    def one(x: Column) -> Column:
        return (
            F.when(x.isNull() | (x == "VOID"), "null").when(x == "BOOLEAN", "bool").when(x.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int64").when(x.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double")
            .when(x.startswith("OBJECT"), "object").when(x.startswith("ARRAY"), "array").otherwise("string")
        )

    item = F.regexp_extract(t, r"^ARRAY<(.*)>$", 1)
    return F.when(t.startswith("ARRAY"), F.concat(F.lit("array<"), F.when(item == "VOID", "string").otherwise(one(item)), F.lit(">"))).otherwise(one(t))


def asset_quality(assets: DataFrame, now: datetime) -> DataFrame:
    """(asset_id, completeness, uniqueness, consistency, timeliness, score, status), an asset a row.

    completeness is the share of columns that are not nullable, uniqueness the share of key columns,
    consistency 0.7 if snake and camel case are mixed, timeliness 1 within 30 days and then falling to 0
    over a year (0.5 without a date); weights .3, .2, .2 (validity, always 1), .15, .15. An asset without
    columns has score 0 and status unknown."""
    c = asset_columns(assets).groupBy("asset_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("nullable", F.lit(True))).alias("nullable"), F.count_if(F.lower("name").rlike("^(id|.*_pk|pk_.*|.*_key)$")).alias("keys"),
        F.max(F.col("name").contains("_")).alias("snake"), F.max(F.col("name").rlike("[a-z][A-Z]")).alias("camel"),
    )
    days = F.date_diff(F.lit(now).cast("date"), F.col("discovered_at").cast("date"))
    j = assets.select(F.col("id").alias("asset_id"), days.alias("days")).join(c, "asset_id", "left")
    j = j.select(
        "asset_id", "n", (1 - F.col("nullable") / F.col("n")).alias("completeness"), (F.col("keys") / F.col("n")).alias("uniqueness"),
        F.when(F.col("snake") & F.col("camel"), 0.7).otherwise(1.0).alias("consistency"),
        F.when(F.col("days").isNull(), 0.5).when(F.col("days") <= 30, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("days") / 365)).alias("timeliness"),
    )
    score = F.col("completeness") * 0.3 + F.col("uniqueness") * 0.2 + 0.2 + F.col("consistency") * 0.15 + F.col("timeliness") * 0.15
    j = j.withColumn("score", F.coalesce(score, F.lit(0.0)))
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("score") >= 0.8, "good").when(F.col("score") >= 0.6, "warning").otherwise("poor")
    return j.select("asset_id", *(F.round(x, 4).alias(x) for x in ("completeness", "uniqueness", "consistency", "timeliness", "score")), status.alias("status"))


def quality_impact(edges: DataFrame, quality: DataFrame) -> DataFrame:
    """(id, expected, delta, risk): the quality a step's target should have against the one it has. Edges
    whose ends have no score are left out."""
    kept = F.lit(0.90)
    for k, v in KEPT.items():
        kept = F.when(F.col("transformation_type") == k, v).otherwise(kept)
    q = quality.select(loose_id("asset_id").alias("q_id"), "score")
    e = edges.select("id", loose_id("source_asset_id").alias("s"), loose_id("target_asset_id").alias("t"), kept.alias("kept"))
    j = e.join(q.withColumnsRenamed({"q_id": "s", "score": "s_score"}), "s").join(q.withColumnsRenamed({"q_id": "t", "score": "t_score"}), "t")
    expected = F.col("s_score") * F.col("kept")
    risk = F.when(F.col("t_score") < expected * 0.9, "high").when(F.col("t_score") < expected, "medium").otherwise("low")
    return j.select("id", expected.alias("expected"), (F.col("t_score") - expected).alias("delta"), risk.alias("risk"))


def description_share(assets: DataFrame) -> DataFrame:
    """(asset_id, n_columns, n_described, percent, n_types)."""
    c = asset_columns(assets)
    full = F.trim(F.coalesce("description", F.lit(""))) != ""
    return c.groupBy("asset_id").agg(
        F.count("*").alias("n_columns"), F.count_if(full).alias("n_described"), F.round(100 * F.count_if(full) / F.count("*"), 2).alias("percent"), F.count_distinct(F.lower("type")).alias("n_types")
    )


def lineage_degree(lineage: DataFrame) -> DataFrame:
    """(asset_id, n_in, n_out): edges at each asset. A hub is aggregated before the shuffle."""
    ends = F.array(F.struct(loose_id("source_asset_id").alias("asset_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(loose_id("target_asset_id").alias("asset_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return lineage.select(F.inline(ends)).where("asset_id is not null").groupBy("asset_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def file_facts(discovery: DataFrame) -> DataFrame:
    """(id, size_bytes, format, application_name, access_level): the metadata built for a scanned file:
    size as a number (default 0), format (else by content type), the last two folders as application,
    access restricted where locked, archived in an archive tier, else internal."""
    d = document("file_metadata")

    def first(*paths: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.get_json_object(d, p)), F.lit("")) for p in paths))

    folders = F.filter(F.split(F.coalesce("folder_path", F.lit("")), "/"), lambda x: x != "")
    size = first("$.basic.size_bytes", "$.size").try_cast("double").cast("bigint")
    return discovery.select(
        "id", F.coalesce(size, F.lit(0).cast("bigint")).alias("size_bytes"), F.lower(F.coalesce(first("$.basic.format", "$.format"), first("$.basic.content_type"), F.lit("unknown"))).alias("format"),
        F.nullif(F.array_join(F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), 2), "/"), F.lit("")).alias("application_name"),
        F.when(first("$.lease_status") == "locked", "restricted").when(first("$.access_tier", "$.basic.access_tier") == "Archive", "archived").otherwise("internal").alias("access_level"),
    )
