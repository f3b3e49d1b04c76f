"""Change detection and duplicates by hash, schema, folder and edge key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.paths import folder_of, norm_path
from metaloom.operators.catalog import document, scans
from metaloom.operators.sequence import previous
from metaloom.util import cut, ship


def change_decision(old_hash: Column, new_hash: Column, old_schema: Column, new_schema: Column, known: Column, on_file: bool = False) -> Column:
    """struct(write, schema_changed): insert what is unknown, update where the schema hash changed, skip
    where only the file did (unless on_file). A missing or blank old hash counts as changed."""

    def differs(a: Column, b: Column) -> Column:
        a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
        return a.isNull() | ~a.eqNullSafe(b)

    schema, file = differs(old_schema, new_schema), differs(old_hash, new_hash)
    write = ~known | schema | (file if on_file else F.lit(False))
    return F.struct(write.alias("write"), (known & schema).alias("schema_changed"))


def shake128(spark, size: int = 16):
    """A column function: hex SHAKE-128 of a string, vectorised over Arrow batches."""
    ship(spark)

    import pandas as pd

    def run(s):
        return s.map(lambda x: hashlib.shake_128(x.encode("utf-8")).hexdigest(size), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}

    return F.pandas_udf(run, "string")


def schema_hash(doc: Column) -> Column:
    """A JVM-side digest of a schema document: names and types, order ignored."""
    c = F.from_json(F.get_json_object(document(doc), "$.columns"), "array<struct<name: string, type: string>>")
    return F.when(c.isNotNull(), F.sha2(F.to_json(F.array_sort(c)), 256))


def modified_time(doc: Column, *more: Column) -> Column:
    """The first time that can be read: of the file's document in either form, then of the further
    columns; date alone, with a blank or T, with or without zone."""
    d = document(doc)
    texts = [F.get_json_object(d, p) for p in ("$.timestamps.last_modified", "$.last_modified", "$.azure_metadata.last_modified")]
    return F.coalesce(*(F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|$)"), x.try_cast("timestamp")) for x in texts), *(m.cast("timestamp") for m in more))


def schema_key(doc: Column) -> Column:
    """The sorted set of column names, lower-cased and trimmed, as one text; empty where there are none."""
    d = document(doc)
    arr = "array<struct<name: string>>"
    c = F.coalesce(F.from_json(F.get_json_object(d, "$.columns"), arr), F.when(d.rlike(r"^\s*\["), F.from_json(d, arr)))
    names = F.filter(F.transform(c, lambda x: F.lower(F.trim(x["name"]))), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), "\u0001"), F.lit(""))


def schema_duplicates(discovery: DataFrame) -> DataFrame:
    """(id, schema_group, keep): scans of one set of column names; the most recently modified is kept,
    the smallest id on a tie, the rest hidden. Scans without columns and single scans are left alone.

    The key is a digest, so no wide text is shuffled. The best of a group is found by aggregation, with
    partial maxima before the shuffle, and joined back: a hot key never lands in one window task."""
    d = discovery.select("id", F.md5(F.nullif(schema_key(F.col("schema_json")), F.lit(""))).alias("schema_group"), modified_time(F.col("file_metadata"), F.col("updated_at"), F.col("discovered_at")).alias("at"))
    d = cut(d.where("schema_group is not null"), "schemas")  # documents are read once, their digests twice
    best = d.groupBy("schema_group").agg(F.min(F.struct((-F.coalesce(F.unix_micros("at"), F.lit(-(2**62)))).alias("at"), F.col("id"))).alias("b"), F.count("*").alias("n")).where("n > 1")
    return d.join(best, "schema_group").select("id", "schema_group", (F.col("id") == F.col("b.id")).alias("keep"))


def duplicate_summary(discovery: DataFrame) -> DataFrame:
    """(groups_deduped, hidden, total)."""
    d = schema_duplicates(discovery)
    return discovery.select("id").join(d, "id", "left").agg(
        F.count_if("keep").alias("groups_deduped"), F.count_if(~F.col("keep")).alias("hidden"), F.count("*").alias("total")
    )


def latest_per_folder(files: DataFrame, container: str, path: str, modified: str, order: str, suffix: str = ".parquet") -> DataFrame:
    """The most recently modified file of each folder among those of a suffix; the first in listing order
    on a tie, and where no file has a time. By aggregation, with partial maxima before the shuffle."""
    f = files.where(F.lower(path).endswith(suffix)).withColumn("folder", folder_of(F.col(path)))
    rank = F.struct((-F.coalesce(F.unix_micros(F.col(modified).cast("timestamp")), F.lit(-(2**62)))).alias("t"), F.col(order).alias("o"))
    cols = [c for c in f.columns if c not in (container, "folder")]
    return f.groupBy(container, "folder").agg(F.min_by(F.struct(*cols), rank).alias("x")).select(container, "folder", "x.*")


def refresh_folders(latest: DataFrame, stored: DataFrame, strict: bool = False) -> DataFrame:
    """Which folders to read again: latest has (container, folder, path, modified), stored the same as
    known before. The same file only if newer, another if not older (if strict, newer); always where
    nothing is stored, never where the new file has no time."""
    s = stored.select("container", "folder", F.col("path").alias("old_path"), F.col("modified").alias("old_modified"))
    j = latest.join(s, ["container", "folder"], "left")
    same = norm_path(F.col("path")) == norm_path(F.col("old_path"))
    newer, not_older = F.col("modified") > F.col("old_modified"), F.col("modified") >= F.col("old_modified")
    take = F.when(F.col("old_modified").isNull(), True).when(F.col("modified").isNull(), False).when(same | F.lit(strict), newer).otherwise(not_older)
    return j.withColumn("refresh", F.coalesce(take, F.lit(False)))


def best_edges(edges: DataFrame, keys: list[str], score: str = "confidence_score", order: str = "id") -> DataFrame:
    """One edge per key: the highest score, the first on a tie. Partial aggregation before the shuffle."""
    cols = [c for c in edges.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(-1.0))).alias("s"), F.col(order).alias("o")))
    return edges.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def by_path(assets: DataFrame, discovery: DataFrame) -> DataFrame:
    """(id, path, asset_id): scans and the asset of their connector with the same normalised path in its
    technical or operational document; the smallest asset id where there are several."""
    paths = F.array_distinct(F.array_compact(F.array(*(
        F.nullif(norm_path(F.get_json_object(document(d), p)), F.lit(""))
        for d, p in (("technical_metadata", "$.location"), ("technical_metadata", "$.path"), ("technical_metadata", "$.storage_path"), ("operational_metadata", "$.path"))
    ))))
    a = assets.select(F.col("id").alias("asset_id"), F.explode(paths).alias("path")).groupBy("path").agg(F.min("asset_id").alias("asset_id"))
    d = discovery.select("id", norm_path(F.col("storage_path")).alias("path")).where("path <> ''")
    return d.join(a, "path")


def redetect(assets: DataFrame, version: str) -> DataFrame:
    """Assets whose columns were checked for personal data by another version of the detector."""
    v = F.get_json_object(document("technical_metadata"), "$.pii_version")
    return assets.where(~v.eqNullSafe(F.lit(version)))


def decide(discovery: DataFrame) -> DataFrame:
    """(id, write, schema_changed): each scan against the one before it of its asset, by arrival."""
    d = scans(discovery).where("asset_id is not null")
    h = F.coalesce(F.get_json_object(document("file_metadata"), "$.hash.value"), F.get_json_object(document("file_metadata"), "$.file_hash"))
    d = previous(d.select("asset_id", "id", h.alias("h"), F.col("schema_hash").alias("s")), ["asset_id"], ["id"], ["h", "s"])
    x = change_decision(F.col("prev.h"), F.col("h"), F.col("prev.s"), F.col("s"), F.col("prev").isNotNull())
    return d.select("id", x.alias("x")).select("id", "x.write", "x.schema_changed")
