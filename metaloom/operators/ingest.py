"""Writes: appends, upserts, idempotent ingestion, column edits, cascading deletes, exports.

Each write is a function from the tables as they are to the tables as they will be, so it can be
written to any sink; `append` and `export_csv` write files. Keys are matched by joins, never looked up
one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.catalog import COLUMN, document
from metaloom.operators.dedup import best_edges
from metaloom.util import loose_id


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows to a Parquet table, in folders by a column of few values if given."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows whose key is not there yet; of repeated keys the first in order. Nulls are equal."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"__k{i}") for i, c in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    n = new.select("*", *k)
    cols = [c for c in new.columns]
    first = n.groupBy(*names).agg(F.min_by(F.struct(*cols), F.col(order)).alias("x"))
    return first.join(existing.select(*k), names, "left_anti").select("x.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Existing rows with what comes in: a value that comes in replaces the old one unless it is null, new
    keys are added. Columns in keep never change once set. incoming has each key once."""
    cols = [c for c in existing.columns if c != key]
    o = existing.select(key, *(F.col(c).alias(f"__o_{c}") for c in cols))
    n = incoming.select(key, *(F.col(c).alias(f"__n_{c}") if c in incoming.columns else F.lit(None).alias(f"__n_{c}") for c in cols))
    pick = lambda c: F.coalesce(f"__o_{c}", f"__n_{c}") if c in keep else F.coalesce(f"__n_{c}", f"__o_{c}")
    return o.join(n, key, "full").select(key, *(pick(c).alias(c) for c in cols))


def edge_hash(source: Column, process: Column, target: Column, valid_from: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, process, target, F.coalesce(valid_from.cast("string"), F.lit(""))), 256)


def ingest(payloads: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(datasets, edges, audit) of process payloads (ingestion_id, process_urn, inputs array, outputs array,
    valid_from). Payloads already in known (ingestion_id) are skipped, repeated ones count once. Every
    input of a payload leads to every output of the same payload, a list that one message bounds."""
    new = payloads.dropDuplicates(["ingestion_id"]).join(known.select("ingestion_id"), "ingestion_id", "left_anti")
    e = new.select("ingestion_id", "process_urn", "valid_from", F.explode(F.array_distinct("inputs")).alias("source_urn"), "outputs")
    e = e.select("ingestion_id", "process_urn", "valid_from", "source_urn", F.explode(F.array_distinct("outputs")).alias("target_urn"))
    e = e.withColumn("edge_hash", edge_hash(F.col("source_urn"), F.col("process_urn"), F.col("target_urn"), F.col("valid_from")))
    edges = e.groupBy("edge_hash").agg(*(F.min(c).alias(c) for c in ("ingestion_id", "process_urn", "source_urn", "target_urn", "valid_from")))
    urns = new.select(F.explode(F.array_union("inputs", "outputs")).alias("urn")).distinct().withColumn("name", F.substring_index(F.substring_index("urn", ":", -1), ".", -1))
    audit = new.select("ingestion_id", "process_urn", F.lit("ingest").alias("action"), (F.size(F.array_distinct("inputs")) * F.size(F.array_distinct("outputs"))).alias("n_edges"))
    return urns, edges, audit


def close_edges(edges: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Set valid_to of open edges whose hash is in gone."""
    return edges.join(gone.select("edge_hash").distinct().withColumn("gone", F.lit(True)), "edge_hash", "left").withColumn("valid_to", F.when(F.col("gone") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))).drop("gone")


def edit_columns(assets: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, columns): assets' column documents after edits (id, name, pii_detected, pii_types, analytical,
    operational). Not personal clears types and policies, personal without types gets PII, blank
    policies become null. Of several edits of one column one is taken, the greatest. Edits are gathered per
    asset, a list that the asset's columns bound."""
    what = ("pii_detected", "pii_types", "analytical", "operational")
    edits = edits.where("id is not null and name is not null").groupBy("id", "name").agg(F.max(F.struct(*what)).alias("x")).select("id", "name", "x.*")
    e = edits.groupBy(F.col("id").alias("e_id")).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("pii_detected", "pii_types", "analytical", "operational")))).alias("e"))
    c = F.from_json(document("columns"), COLUMN)
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))

    def change(x):
        n = F.try_element_at(F.col("e"), x["name"])
        on = n["pii_detected"]
        types = F.when(F.coalesce(F.size(n["pii_types"]), F.lit(0)) > 0, n["pii_types"]).otherwise(F.array(F.lit("PII")))
        new = x.withField("pii_detected", on).withField("pii_types", F.when(on, types)).withField("masking_logic_analytical", F.when(on, blank(n["analytical"]))).withField("masking_logic_operational", F.when(on, blank(n["operational"])))
        return F.when(n.isNull(), x).otherwise(new)

    a = assets.select("id", c.alias("c")).join(e, F.col("id") == F.col("e_id"), "left")
    return a.select("id", F.to_json(F.when(F.col("e").isNull(), F.col("c")).otherwise(F.transform("c", change))).alias("columns"))


def create_assets(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New assets with all of id, name, type and catalog, whose id is not there yet; the first of each id."""
    need = None
    for c in ("id", "name", "type", "catalog"):
        t = F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
        need = t if need is None else need & t
    return new.where(need).dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def delete_connection(assets: DataFrame, discovery: DataFrame, lineage: DataFrame, connector_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without a connection's assets, their scans and their edges."""
    gone = assets.where(F.col("connector_id") == connector_id).select(loose_id("id").alias("k"))
    key = lambda d, c: d.withColumn("k", loose_id(c)).join(gone, "k", "left_anti").drop("k")
    return assets.where(~F.col("connector_id").eqNullSafe(F.lit(connector_id))), key(discovery, "asset_id"), key(key(lineage, "source_asset_id"), "target_asset_id")


def hide(discovery: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Scans with is_visible off where they are a duplicate that is not kept."""
    d = duplicates.where(~F.col("keep")).select("id", F.lit(True).alias("dup"))
    return discovery.join(d, "id", "left").withColumn("is_visible", F.col("is_visible") & F.col("dup").isNull()).drop("dup")


def restore(discovery: DataFrame, ids: DataFrame) -> DataFrame:
    """Scans with is_visible on where their id is listed."""
    d = ids.select("id").distinct().withColumn("back", F.lit(True))
    return discovery.join(d, "id", "left").withColumn("is_visible", F.col("is_visible") | F.coalesce("back", F.lit(False))).drop("back")


def mark_notified(discovery: DataFrame, due: DataFrame, at: Column) -> DataFrame:
    """Scans with notification_sent_at set where they are due and it was not."""
    base = discovery if "notification_sent_at" in discovery.columns else discovery.withColumn("notification_sent_at", F.lit(None).cast("timestamp"))
    d = due.select("id").distinct().withColumn("due", F.lit(True))
    return base.join(d, "id", "left").withColumn("notification_sent_at", F.coalesce("notification_sent_at", F.when(F.col("due"), at))).drop("due")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and every value quoted, quotes inside doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def merge_edges(new: DataFrame, existing: DataFrame) -> DataFrame:
    """All edges, one per (source, target, job), the most trusted."""
    return best_edges(existing.unionByName(new), ["source_asset_id", "target_asset_id", "source_job_id"])
