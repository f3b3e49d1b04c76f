"""Files: listings, byte ranges, profiles by format, readers."""

from __future__ import annotations

import importlib.util
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.paths import file_of, folder_of, format_of
from metaloom.util import arrow_map, ship


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, folder, format, size, modified) of all files below a path. The content is never read.
    Suffixes compare without case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    p = F.col("path")
    if suffixes:
        keep = None
        for s in suffixes:
            e = F.lower(p).endswith(s.lower())
            keep = e if keep is None else keep | e
        f = f.where(keep)
    return f.select("path", file_of(p).alias("name"), folder_of(p).alias("folder"), format_of(p).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def byte_range(spark: SparkSession, path: str, offset: int, length: int) -> DataFrame:
    """(path, bytes) of a range of each file; a negative offset counts from the end. The executors open the
    files themselves and read the range alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for p, n in zip(*(c.to_pylist() for c in b.columns)):
                f, q = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                at = max(0, n + offset) if offset < 0 else min(offset, n)
                with f.open_input_file(q) as h:
                    h.seek(at)
                    out.append(h.read(length))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "bytes"])

    return arrow_map(files, run, "path string, bytes binary")


def parquet_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, num_rows, num_row_groups, created_by, column, type, nullable, compressed) of Parquet files, a
    row per column, from the footers alone."""
    files = listing(spark, path, (".parquet",)).select("path")
    ship(spark)

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        names = ["path", "num_rows", "num_row_groups", "created_by", "column", "type", "nullable", "compressed"]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for p in b.column(0).to_pylist():
                f, q = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                with f.open_input_file(q) as h:
                    m = pq.ParquetFile(h)
                    meta, schema = m.metadata, m.schema_arrow
                    size: dict[str, int] = {}
                    for g in range(meta.num_row_groups):
                        for c in range(meta.num_columns):
                            x = meta.row_group(g).column(c)
                            top = x.path_in_schema.split(".")[0]
                            size[top] = size.get(top, 0) + x.total_compressed_size
                    for field in schema:
                        for c, v in zip(rows, (p, meta.num_rows, meta.num_row_groups, meta.created_by, field.name, str(field.type), field.nullable, size.get(field.name, 0))):
                            c.append(v)
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return arrow_map(files, run, "path string, num_rows bigint, num_row_groups int, created_by string, column string, type string, nullable boolean, compressed bigint")


def csv_columns(text) -> list[tuple[str, str, list[str]]]:
    """(name, type, first samples): names from the first line, a blank one as column_{i}; samples from the
    first ten non-blank rows of the same width; every type is string."""
    import csv

    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return []
    head = [h.strip() or f"column_{i + 1}" for i, h in enumerate(rows[0])]
    body = [r for r in rows[1:] if len(r) == len(head) and any(x.strip() for x in r)][:10]
    return [(h, "string", [r[i] for r in body]) for i, h in enumerate(head)]


def json_columns(text) -> list[tuple[str, str, list[str]]]:
    """Keys of an object, or of the first object of an array (samples of the first ten); an array of scalars
    is one column value. Every type is string."""
    try:
        v = json.loads(text)
    except ValueError:
        return []
    items = v[:10] if isinstance(v, list) else [v]
    if not items:
        return []
    if not isinstance(items[0], dict):
        return [("value", "string", [str(x) for x in items])]
    return [(k, "string", [json.dumps(x[k]) for x in items if isinstance(x, dict) and k in x]) for k in items[0]]


def xml_columns(text) -> list[tuple[str, str, list[str]]]:
    """One column for each distinct path of elements, in document order."""
    import xml.etree.ElementTree as ET

    try:
        top = ET.fromstring(text)
    except ET.ParseError:
        return []
    seen: dict[str, list[str]] = {}
    stack = [(top, top.tag)]
    while stack:
        e, path = stack.pop()
        s = seen.setdefault(path, [])
        if e.text and e.text.strip() and len(s) < 10:
            s.append(e.text.strip())
        stack += [(c, f"{path}.{c.tag}") for c in reversed(e)]
    return [(p, "string", s) for p, s in seen.items()]


PROFILES = {"csv": csv_columns, "json": json_columns, "xml": xml_columns}


def text_profile(files: DataFrame) -> DataFrame:
    """(path, column, type, samples) of text files given as (path, format, text). Formats other than csv,
    json and xml, and texts that cannot be read, have no columns."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for p, f, t in zip(*(c.to_pylist() for c in b.columns)):
                for row in PROFILES.get(f or "", lambda _: [])(t or ""):
                    for c, v in zip(out, (p, *row)):
                        c.append(v)
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["path", "column", "type", "samples"])

    return arrow_map(files.select("path", "format", "text"), run, "path string, column string, type string, samples array<string>")


def read(spark: SparkSession, path: str, form: str) -> DataFrame:
    """A file or folder as a table, by format. Text formats come with every column a string."""
    if form == "parquet":
        return spark.read.parquet(path)
    if form == "delta":
        return delta_table(spark, path)
    if form == "orc":
        return spark.read.orc(path)
    if form == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if form == "json":
        return spark.read.option("primitivesAsString", True).option("multiLine", True).json(path)
    if form == "xml":
        return spark.read.format("xml").option("rowTag", "row").option("inferSchema", False).load(path)
    if form == "avro":
        try:
            return spark.read.format("avro").load(path)
        except Exception as e:
            raise RuntimeError("reading Avro needs Spark's avro module on the class path") from e
    if form == "excel":
        return excel_rows(spark, path)
    raise ValueError(f"no reader for {form}")


def delta_files(spark: SparkSession, path: str) -> DataFrame:
    """(file): the data files that a table folder's log holds at its end: of every file the last action counts.
    The log is read by the executors: JSON commits, and Parquet checkpoints where there are any."""
    act = "struct<path: string>"
    version = F.regexp_extract(F.input_file_name(), r"([0-9]{20})", 1)
    log = spark.read.schema(f"add {act}, remove {act}")
    one = log.json(f"{path}/_delta_log/*.json").select("add", "remove", version.alias("v"), F.lit(1).alias("o"))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log/*.checkpoint*.parquet")):
        one = one.unionByName(log.parquet(f"{path}/_delta_log/*.checkpoint*.parquet").select("add", "remove", version.alias("v"), F.lit(0).alias("o")))
    a = one.where("add is not null or remove is not null").select(F.coalesce("add.path", "remove.path").alias("file"), "v", "o", F.col("add").isNotNull().alias("here"))
    # within a version a file that is added again stays
    return a.groupBy("file").agg(F.max(F.struct("v", "o", "here")).alias("m")).where("m.here").select("file")


def delta_table(spark: SparkSession, path: str) -> DataFrame:
    """A table folder with a log as a table: only the files it holds now; a folder without a log is its files. Their names go to the driver, as those of any
    table's files do. Deletion vectors are not read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path)
    names = [r.file for r in delta_files(spark, path).collect()]
    if not names:
        raise ValueError(f"no data files in the log of {path}")
    from urllib.parse import unquote

    return spark.read.option("basePath", path).parquet(*(n if "://" in n or n.startswith("/") else f"{path}/{unquote(n)}" for n in names))


def excel_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells array<string>) of workbooks, each read by the executor that holds it."""
    if not importlib.util.find_spec("openpyxl"):
        raise RuntimeError("reading Excel needs openpyxl on the executors")
    books = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import openpyxl
        import pyarrow as pa

        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                book = openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True)
                for sheet in book.worksheets:
                    rows = [[None if v is None else str(v) for v in r] for r in sheet.iter_rows(values_only=True)]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array([sheet.title] * n), pa.array(range(n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["path", "sheet", "row_no", "cells"])

    return arrow_map(books, run, "path string, sheet string, row_no bigint, cells array<string>")


def schema_rows(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable) of a table, from its schema alone."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
