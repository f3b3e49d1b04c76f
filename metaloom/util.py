"""Pieces the operators share: loose ids, lineage cuts in the shared folder, safe column names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that may surround an id (fixed value).
BLANKS = " \t\n\r\x0b\x0c   　"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def loose_id(c: Column | str) -> Column:
    """Ids compare without blanks around them and without case; null and blank become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(strip(c)), F.lit(""))


def instant(df: DataFrame, name: str) -> Column:
    """A time column as a point in time; times without a zone are UTC whatever the session's zone is."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.concat(c.cast("string"), F.lit("Z")).try_cast("timestamp")
    return c.cast("timestamp")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is the session's spark.checkpoint.dir; a folder of its
    own is made only where that is unset and everything runs on one machine, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    d = "file://" + tempfile.mkdtemp(prefix="metaloom-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back. Cuts the lineage, survives lost
    executors and, unlike checkpoint(), keeps the rows columnar and compressed, with a size the
    optimiser can see. The files are dropped by forget() or at the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/metaloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, tag: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(), and numbers of rows for which conditions hold, counted while the rows are written."""
    from pyspark.sql import Observation

    seen = Observation()
    out = cut(df.observe(seen, *(F.count_if(c).alias(n) for n, c in counts.items())), tag)
    got = seen.get or {}
    return out, {n: int(got[n]) if n in got else out.where(c).count() for n, c in counts.items()}


@atexit.register
def forget() -> None:
    """Drop everything that cut() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder belongs to the cluster's clean-up
            pass


def tasks(spark: SparkSession) -> int:
    """The shuffle parallelism of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python stages find it
    wherever it is installed on the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import os
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="metaloom-ship-"), "metaloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("metaloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
