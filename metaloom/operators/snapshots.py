"""What changed between full snapshots.

Each key is windowed by snapshot number: the lagged path and hash reveal changes, a gap in the
numbers reveals a removal and a later addition.

Skew: rows are first aggregated to one per (snapshot, key), with partial aggregation before the
shuffle, so a key that holds a third of all rows collapses in the map tasks; the window then sees
at most one row per snapshot for a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.util import cut, loose_id, strip


def norm_path(c):
    """Paths compare without slashes at their ends and without case; blanks around count as none."""
    return F.coalesce(F.lower(F.btrim(strip(c), F.lit("/"))), F.lit(""))


def norm_hash(c):
    """Hashes compare without blanks and case; null equals blank."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit(""))


def _deliveries(rows: DataFrame) -> DataFrame:
    """(snapshot_no, delivery_no): the delivery that counts, a row a snapshot, found in one pass over two columns."""
    r = rows.select("snapshot_no", F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no")).where("snapshot_no is not null")
    return r.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no"))


def snapshot_states(rows: DataFrame) -> DataFrame:
    """(snapshot_no, asset_id, path, hash, loaded_at): what each snapshot holds.

    Of a snapshot only its highest delivery counts, a null delivery number being the lowest. Within
    it the row with the latest loaded_at counts for an id; equal times are settled by the larger
    path, then hash. Rows without an id or a snapshot number are no member of any snapshot."""
    return _states(rows, _deliveries(rows))


def _states(rows: DataFrame, last: DataFrame) -> DataFrame:
    r = rows.select(
        F.col("snapshot_no"),
        F.coalesce("delivery_no", F.lit(-1)).alias("delivery_no"),
        loose_id("asset_id").alias("asset_id"),
        F.struct(
            F.col("loaded_at"),
            norm_path(F.col("storage_path")).alias("path"),
            norm_hash(F.col("schema_hash")).alias("hash"),
        ).alias("v"),
    ).where("snapshot_no is not null")
    kept = r.where("asset_id is not null").join(last, ["snapshot_no", "delivery_no"])
    return (
        kept.groupBy("snapshot_no", "asset_id")
        .agg(F.max("v").alias("v"))
        .select("snapshot_no", "asset_id", "v.path", "v.hash", "v.loaded_at")
    )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(snapshot_no, asset_id, change_kind): added, removed or changed against snapshot_no - 1.

    A snapshot whose predecessor was never delivered yields no rows, for there is nothing to compare
    it with. An empty table gives no rows. Other columns of the input are ignored."""
    known = cut(_deliveries(rows), "deliveries")  # a row a snapshot, read three times below
    prior = known.select((F.col("snapshot_no") + 1).alias("snapshot_no"), F.lit(True).alias("has_prior"))
    after = known.select((F.col("snapshot_no") - 1).alias("snapshot_no"), F.lit(True).alias("has_next"))
    s = _states(rows, known).join(prior, "snapshot_no", "left").join(after, "snapshot_no", "left")
    w = Window.partitionBy("asset_id").orderBy("snapshot_no")
    # only whether path or hash differ matters from here on, so 128 bits travel instead of both; the path's
    # length tells where it ends, so no two pairs are written alike
    s = s.withColumn("content", F.unhex(F.md5(F.concat_ws(":", F.length("path").cast("string"), "path", "hash"))))
    s = s.select(
        "snapshot_no", "asset_id", "has_prior", "has_next", "content",
        F.lag(F.struct("snapshot_no", "content")).over(w).alias("was"),
        F.lead("snapshot_no").over(w).alias("next_no"),
    )
    follows = F.coalesce(F.col("was.snapshot_no") == F.col("snapshot_no") - 1, F.lit(False))
    here = (
        F.when(F.col("has_prior") & ~follows, "added")
        .when(follows & (F.col("was.content") != F.col("content")), "changed")
    )
    gone = F.col("has_next") & ~F.coalesce(F.col("next_no") == F.col("snapshot_no") + 1, F.lit(False))
    return s.select(
        "asset_id",
        F.explode(
            F.array(
                F.struct(F.col("snapshot_no"), here.alias("change_kind")),
                F.struct((F.col("snapshot_no") + 1).alias("snapshot_no"), F.when(gone, "removed").alias("change_kind")),
            )
        ).alias("x"),
    ).select(
        F.col("x.snapshot_no").cast("int").alias("snapshot_no"), "asset_id", F.col("x.change_kind").alias("change_kind")
    ).where("change_kind is not null")


def snapshot_summary(rows: DataFrame) -> DataFrame:
    """Counts of added, removed and changed keys for each snapshot."""
    return snapshot_changes(rows).groupBy("snapshot_no").agg(
        *(F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed"))
    )
