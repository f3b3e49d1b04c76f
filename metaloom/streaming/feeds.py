"""Streams of scans and events: late data, duplicates, windows, latest state.

State is bounded by watermarks. Batches are written once: a checkpoint in the shared folder makes a
restarted stream go on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.util import shared_dir


def files(spark: SparkSession, folder: str, name: str, at_once: int = 100) -> DataFrame:
    """Parquet files of one name below a folder, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once)
    probe = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(probe).isDirectory():
        return r.parquet(f"{folder}/{name}")
    return r.option("pathGlobFilter", name).parquet(folder)


def once(df: DataFrame, mode: str = "append", tag: str = "stream") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/metaloom/{tag}-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once, within the time that rows may be late."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, by, n): rows per window, emitted once the watermark has passed its end."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def keep_latest(stream: DataFrame, key: str, order: list[str], target: str, state: str, parts: int = 64) -> DataFrame:
    """Maintain the latest row per key over all batches of a stream, and return the table.

    Rows are kept in parts by hash of the key. A batch is reduced to one row per key and merged with the parts it
    touches only; each merged part is written under the batch's number. Only then is the pointer (the newest
    version of every part) written, under the batch's number too, so a lost batch leaves the table as it was and a
    repeated one writes the same. A null key is one of its own."""
    spark, columns, kinds = stream.sparkSession, stream.columns, stream.schema
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def newest(before: int) -> dict[int, int]:
        """Part -> batch that wrote it last, by the newest pointer below a batch; at most `parts` rows."""
        fs, at = _folder(spark, f"{target}/pointer")
        if not fs.exists(at):
            return {}
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        done = [int(n.removeprefix("n")) for n in names if fs.exists(_folder(spark, f"{target}/pointer/{n}/_SUCCESS")[1])]
        done = [n for n in done if n < before]
        return {r.part: r.version for r in spark.read.parquet(f"{target}/pointer/n{max(done)}").collect()} if done else {}

    def rows(at: dict[int, int]) -> DataFrame | None:
        paths = [f"{target}/rows/n{v}/part={p}" for p, v in at.items()]
        return spark.read.schema(kinds).parquet(*paths) if paths else None

    def merge(batch: DataFrame, n: int) -> None:
        at = newest(n)
        best = F.max_by(F.struct(*columns), F.struct(*order)).alias("x")
        mine = batch.groupBy(key).agg(best).select("x.*").withColumn("part", part).persist()
        touched = {r.part for r in mine.select("part").distinct().collect()}  # at most `parts` numbers
        old = rows({p: v for p, v in at.items() if p in touched})
        both = mine.drop("part") if old is None else mine.drop("part").unionByName(old)
        made = both.groupBy(key).agg(best).select("x.*").withColumn("part", part)
        made.write.mode("overwrite").partitionBy("part").parquet(f"{target}/rows/n{n}")
        mine.unpersist()
        now = at | {p: n for p in touched}
        spark.createDataFrame(list(now.items()), "part int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{target}/pointer/n{n}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    out = rows(newest(2**62))
    return spark.createDataFrame([], kinds) if out is None else out


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
