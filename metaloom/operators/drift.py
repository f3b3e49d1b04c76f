"""Schemas that drift between files.

Every document is brought to a canonical schema with a fingerprint. Along the scans of an asset the
fingerprint changes open a new version, and each pair of versions gives explicit migration steps
(rename, retype, add, remove). A file is routed through the chain of steps after it to the one
consistent table, by chained rename, cast and default rules.

A column that is removed stays in the table under its last name and type. If that name stands for another
column by then, as when it was added again later, it is set apart by its version: n#1 for the one removed last, n#2
for the one before.

Skew: rows are range-partitioned by (asset, time, id), so an asset that holds a third of all rows is
spread over tasks like any other. Each task compares neighbours while it streams; the first and last
schema of a task go to a small second stage (two rows a task) that compares across the task borders.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.operators.nested import parse, unwrap
from metaloom.util import arrow_map, cut, instant, loose_id

#: Names of one type in Arrow, Spark and databases (fixed values).
TYPE_NAMES = {
    "string": "string str text utf8 large_string large_utf8 string_view char nchar character varchar varchar2 nvarchar nvarchar2 character_varying bpchar clob nclob tinytext mediumtext longtext",
    "int32": "int32 int integer int4 mediumint signed",
    "int64": "int64 bigint long",
    "int16": "int16 smallint short int2",
    "int8": "int8 tinyint byte",
    "float": "float float32 real binary_float float4",
    "double": "double float64 double_precision binary_double float8",
    "boolean": "boolean bool bit",
    "date": "date date32 date64",
    "timestamp": "timestamp timestamp_ntz timestamp_ltz timestamptz datetime datetime2 smalldatetime datetimeoffset timestamp_with_time_zone timestamp_without_time_zone timestamp_with_local_time_zone",
    "decimal": "decimal decimal32 decimal64 decimal128 decimal256 numeric number dec",
    "struct": "struct row record object",
    "list": "list large_list fixed_size_list list_view array",
    "map": "map",
    "binary": "binary large_binary fixed_size_binary varbinary blob bytes bytea raw",
}
_KIND = {name: kind for kind, names in TYPE_NAMES.items() for name in names.split()}
_SHAPE = re.compile(r"([a-z][a-z0-9_ ]*)\s*(?:[(<\[{](.*))?", re.S)
_DIGITS = re.compile(r"\d+")


@lru_cache(50_000)
def canonical_type(name: str) -> str:
    """The type a name stands for; decimals keep precision and scale, what is inside struct, list and
    map is not kept. An unknown name stands for itself, in lower case."""
    t = " ".join(name.split()).lower()
    m = _SHAPE.fullmatch(t)
    if not m:
        return t
    inner = m[2] or ""
    base = m[1].strip().replace(" ", "_")
    kind = _KIND.get(base)
    if kind is None and ")" in inner:  # as in: timestamp(6) with time zone, double(8) precision
        kind = _KIND.get(base + "_" + inner.rpartition(")")[2].strip().replace(" ", "_"))
    if kind is None:
        kind = _KIND.get(base.split("_")[0]) if base.startswith(("timestamp_", "char_", "varchar_", "varchar2_")) else None
    if kind is None:
        return t
    if kind == "decimal":
        n = _DIGITS.findall(inner)
        return f"decimal({n[0]},{n[1] if len(n) > 1 else 0})" if n else "decimal"
    return kind


def _type_text(v) -> str:
    if type(v) is dict:
        v = v.get("base_type", v.get("type"))
    return v if type(v) is str else ""


def _column(o) -> tuple[str, str, str] | None:
    name = o.get("name")
    if name is None:
        name = o.get("field")
    if type(name) is not str or not (name := name.strip()):
        return None
    t = o.get("type")
    if t is None:
        t = o.get("dtype")
    about = o.get("description")
    if type(about) is not str or not about.strip():
        about = o.get("comment")
    return name, canonical_type(_type_text(unwrap(t))), about.strip() if type(about) is str else ""


def _is_column(o: dict) -> bool:
    """A lone column object, not an object from name to type."""
    if not (type(o.get("name", o.get("field"))) is str and ("type" in o or "dtype" in o)):
        return False
    return not all(type(v) is str and canonical_type(v).split("(")[0] in TYPE_NAMES for v in o.values())


def schema_of(text: str | None) -> dict[str, tuple[str, str]] | None:
    """name -> (type, description) of a schema document in any of its shapes: columns as an array of
    objects or from name to type, the older fields, a bare array, a lone object for an array of one,
    any of it as JSON text. None if it is null, not complete JSON or without columns. Of a repeated
    name the first counts."""
    doc = unwrap(parse(text))
    if type(doc) is dict:
        for k in ("columns", "fields"):
            if type(x := unwrap(doc.get(k))) in (list, dict):
                doc = x
                break
        else:
            if not _is_column(doc):
                return None
    out: dict[str, tuple[str, str]] = {}
    if type(doc) is list:
        for o in doc:
            if type(o := unwrap(o)) is dict and (c := _column(o)):
                out.setdefault(c[0], c[1:])
    elif type(doc) is dict:
        if _is_column(doc):
            c = _column(doc)
            if c:
                out[c[0]] = c[1:]
        else:
            for k, v in doc.items():
                v = unwrap(v)
                if name := k.strip():
                    about = v.get("description", v.get("comment")) if type(v) is dict else ""
                    out.setdefault(name, (canonical_type(_type_text(v)), about.strip() if type(about) is str else ""))
    return out or None


def fingerprint(schema: dict[str, tuple[str, str]]) -> bytes:
    """Order does not matter, nor how a type is spelled."""
    h = hashlib.blake2b(digest_size=16)
    for n in sorted(schema):
        h.update(repr((n, schema[n])).encode("utf-8", "surrogatepass"))
    return h.digest()


def _spelling(name: str) -> str:
    return "".join(ch for ch in name if ch.isalnum()).lower()


def steps(a: dict[str, tuple[str, str]], b: dict[str, tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The migration from schema a to schema b as (change_kind, old_name, new_name). Names that several
    others could stand for are paired in alphabetical order."""
    out = [("retyped", n, n) for n in a if n in b and a[n][0] != b[n][0]]
    gone, come = sorted(n for n in a if n not in b), sorted(n for n in b if n not in a)
    if gone and come:
        for key, need_type in ((lambda n, s: _spelling(n), False), (lambda n, s: s[n] if s[n][1] else None, True)):
            waiting: dict = {}
            for n in come:
                if k := key(n, b):
                    waiting.setdefault(k, []).append(n)
            left = []
            for n in gone:
                k = key(n, a)
                if k and waiting.get(k):
                    new = waiting[k].pop(0)
                    come.remove(new)
                    out.append(("renamed", n, new))
                    if not need_type and a[n][0] != b[new][0]:
                        out.append(("retyped", n, new))
                else:
                    left.append(n)
            gone = left
    out += [("removed", n, "") for n in gone]
    out += [("added", "", n) for n in come]
    return out


def _dump(s: dict) -> str:
    return json.dumps([[n, *v] for n, v in s.items()])


def _load(t: str) -> dict:
    return {n: (k, d) for n, k, d in json.loads(t)}


class Table:
    """The columns of a consistent table, found from the last schema backwards: column -> (type, name it was
    removed under, null for the columns of the last schema)."""

    def __init__(self, last: dict[str, tuple[str, str]] | None = None):
        self.columns: dict[str, tuple[str, str | None]] = {n: (t, None) for n, (t, _) in (last or {}).items()}

    def removed(self, name: str, kind: str) -> tuple[str, str]:
        """(column, type) of a column that was removed under a name, as one of its own."""
        column, k = name, 0
        while column in self.columns:
            k += 1
            column = f"{name}#{k}"
        self.columns[column] = (kind, name)
        return column, kind


def before(a: dict[str, tuple[str, str]], found: list[tuple[str, str, str]], end: dict[str, tuple[str, str]], table: Table) -> dict[str, tuple[str, str]]:
    """name in schema a -> (column, type) of the table, given the steps to the next schema and the next
    schema's own way to the table."""
    new_name = {old: new for kind, old, new in found if kind == "renamed"}
    removed = {old for kind, old, _ in found if kind == "removed"}
    return {n: table.removed(n, a[n][0]) if n in removed else end[new_name.get(n, n)] for n in sorted(a)}


class _Run:
    """The versions of one asset within one task, and which file has which."""

    def __init__(self, files: bool):
        self.keep = files
        self.first = self.last = None  # (order key, schema, fingerprint)
        self.files: list[tuple[int, int]] = []
        self.versions: list[dict] = []
        self.chain: list[list] = []

    def add(self, key, schema, print_):
        """The steps from the schema before."""
        found = []
        if self.last is None:
            self.first = (key, schema, print_)
            if self.keep:
                self.versions.append(schema)
        elif print_ != self.last[2]:
            found = steps(self.last[1], schema)
            if self.keep:
                self.versions.append(schema)
                self.chain.append(found)
        self.last = (key, schema, print_)
        if self.keep and key[0]:
            self.files.append((key[2], len(self.versions) - 1))
        return found

    def routes(self):
        """(file, source name, source type, column, type) of the table of these versions; afterwards names has
        the way from the first schema, and table the columns."""
        self.table = Table(self.versions[-1])
        end: dict[str, tuple[str, str]] = {n: (n, t) for n, (t, _) in self.versions[-1].items()}
        maps = [end]
        for a, found in zip(reversed(self.versions[:-1]), reversed(self.chain)):
            end = before(a, found, end, self.table)
            maps.append(end)
        maps.reverse()
        for f, i in self.files:
            for n, (t, _) in self.versions[i].items():
                yield f, n, t, *maps[i][n]
        self.names = json.dumps({"names": maps[0], "table": self.table.columns})


_OUT = [
    ("what", pa.string()), ("asset_id", pa.string()), ("at", pa.int64()), ("is_scan", pa.bool_()), ("discovery_id", pa.int64()),
    ("change_kind", pa.string()), ("old_name", pa.string()), ("new_name", pa.string()), ("old_type", pa.string()), ("new_type", pa.string()), ("tail", pa.int64()),
]
_OUT_SQL = "what string, asset_id string, at bigint, is_scan boolean, discovery_id bigint, change_kind string, old_name string, new_name string, old_type string, new_type string, tail bigint"


def _ordered(scans: DataFrame, assets: DataFrame | None) -> DataFrame:
    """One stream of schema documents, each asset's own columns after all of its scans."""
    rows = scans.select(
        loose_id("asset_id").alias("asset_id"), F.lit(True).alias("is_scan"),
        F.coalesce(F.unix_micros(instant(scans, "discovered_at")), F.lit(-(2**63))).alias("at"),
        F.col("id").cast("bigint").alias("id"), F.col("schema_json").alias("doc"),
    )
    if assets is not None:
        rows = rows.unionByName(assets.select(
            loose_id("id").alias("asset_id"), F.lit(False).alias("is_scan"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("id"), F.col("columns").alias("doc"),
        ))
    rows = rows.where("asset_id is not null and doc is not null")
    key = [F.col("asset_id"), F.col("is_scan").desc(), F.col("at"), F.col("id")]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def _pass(files: bool):
    schema = pa.schema(_OUT)

    def run(batches):
        cols: list[list] = [[] for _ in _OUT]

        def put(*row):
            for c, v in zip(cols, row):
                c.append(v)

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _OUT)], schema=schema)
            for c in cols:
                c.clear()
            return b

        asset, one, first_run = None, _Run(files), True

        def close(last_run):
            if one.last is None:
                return False
            names = None
            tail = one.last[0][2] if last_run else None
            if files:
                for f, n, t, end, end_type in one.routes():
                    put("route", asset, None, True, f, None, n, end, t, end_type, tail)
                names = one.names
            if first_run:
                (scan, at, id_), s, _ = one.first
                put("head", asset, at, scan, id_, None, _dump(s), names, None, None, tail)
            if last_run:
                (scan, at, id_), s, _ = one.last
                put("tail", asset, at, scan, id_, None, _dump(s), names, None, None, tail)
            return True

        for b in batches:
            for a, scan, at, id_, doc in zip(*(c.to_pylist() for c in b.columns)):
                if a != asset:
                    if close(False):
                        first_run = False
                    asset, one = a, _Run(files)
                s = schema_of(doc)
                if s is not None:
                    before = one.last
                    for kind, old, new in one.add((scan, at, id_), s, fingerprint(s)):
                        put("change", a, at, scan, id_, kind, old, new, before[1].get(old, ("",))[0], s.get(new, ("",))[0], None)
                if len(cols[0]) >= 20_000:
                    yield flush()
        close(True)
        if cols[0]:
            yield flush()

    return run


def _border_steps(pairs: DataFrame) -> DataFrame:
    """The changes across task borders, from rows of (asset_id, discovery_id, schema before, schema after)."""
    names = ["asset_id", "discovery_id", "change_kind", "old_name", "new_name", "old_type", "new_type"]
    kinds = [pa.string(), pa.int64()] + [pa.string()] * 5

    def run(batches):
        for b in batches:
            rows = []
            for asset, i, x, y in zip(*(c.to_pylist() for c in b.columns)):
                x, y = _load(x), _load(y)
                rows += [(asset, i, k, o, n, x.get(o, ("",))[0], y.get(n, ("",))[0]) for k, o, n in steps(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    return arrow_map(pairs, run, "asset_id string, discovery_id bigint, change_kind string, old_name string, new_name string, old_type string, new_type string")


def _borders(marks: DataFrame) -> DataFrame:
    """Heads joined to the tail before them. Per asset there are at most two marks a task."""
    w = Window.partitionBy("asset_id").orderBy(F.col("is_scan").desc(), "at", "discovery_id", F.when(F.col("what") == "head", 0).otherwise(1))
    m = marks.withColumn("p", F.lag(F.struct("what", F.col("old_name").alias("doc"), "tail")).over(w))
    return m.where("what = 'head' and p.what = 'tail'")


def _collected(scans: DataFrame, assets: DataFrame | None, files: bool) -> DataFrame:
    return cut(arrow_map(_ordered(scans, assets), _pass(files), _OUT_SQL), "drift")


def _all_changes(got: DataFrame) -> DataFrame:
    inner = got.where("what = 'change'").select("asset_id", "discovery_id", "change_kind", "old_name", "new_name", "old_type", "new_type")
    over = _borders(got.where("what in ('head', 'tail')")).select("asset_id", "discovery_id", F.col("p.doc"), "old_name")
    return inner.unionByName(_border_steps(over))


def schema_changes(scans: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(asset_id, discovery_id, change_kind, old_name, new_name, old_type, new_type), a row per change.

    scans has id, asset_id, discovered_at, schema_json; assets has id and columns. Scans are ordered
    by discovered_at, then id, a null time first; documents without columns are left out, so are rows
    of no asset. The step from the last scan to the asset's own columns has discovery_id 0."""
    return _all_changes(_collected(scans, assets, False))


def _routed(scans: DataFrame, assets: DataFrame | None) -> DataFrame:
    """(asset_id, discovery_id, source_name, source_type, column_name, column_type) of the columns files have."""
    got = _collected(scans, assets, True)
    way = _later(got.where("what in ('head', 'tail')"))
    r = got.where("what = 'route'").select("asset_id", "discovery_id", F.col("old_name").alias("source_name"), F.col("old_type").alias("source_type"), F.col("new_name").alias("mid"), F.col("new_type").alias("mid_type"), "tail")
    return r.join(way, ["asset_id", "tail", "mid"], "left").select(
        "asset_id", "discovery_id", "source_name", "source_type",
        F.coalesce("end", "mid").alias("column_name"), F.coalesce("end_type", "mid_type").alias("column_type"),
    )


def routes(scans: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(asset_id, discovery_id, source_name, source_type, column_name, column_type, rule), a row per file
    and column of the consistent table of its asset: how the file's column enters it. rule is keep, rename, cast
    or rename_cast, and default, without a source, for a column that the file lacks. Columns that only the
    asset's own columns have are no file's and are left out.

    A task knows the way to the end of its own rows. For an asset cut by task borders the rest of the
    way is found from the marks (a few rows a task) and joined on. Defaults take one row of column names
    per file and one of the table per asset, so no rows of a group meet one another."""
    r = cut(_routed(scans, assets), "routed")
    renamed, cast = F.col("source_name") != F.col("column_name"), F.col("source_type") != F.col("column_type")
    r = r.withColumn("rule", F.when(renamed & cast, "rename_cast").when(renamed, "rename").when(cast, "cast").otherwise("keep"))
    column = F.struct("column_name", "column_type")
    table = r.groupBy("asset_id").agg(F.collect_set(column).alias("all"))
    lack = r.groupBy("asset_id", "discovery_id").agg(F.collect_set(column).alias("has")).join(table, "asset_id")
    lack = lack.select("asset_id", "discovery_id", F.inline(F.array_except("all", "has")))
    none = F.lit(None).cast("string")
    lack = lack.select("asset_id", "discovery_id", none.alias("source_name"), none.alias("source_type"), "column_name", "column_type", F.lit("default").alias("rule"))
    return r.unionByName(lack)


def _later(marks: DataFrame) -> DataFrame:
    """(asset_id, tail, mid, end, end_type): columns at the end of a task's rows of an asset to those of the
    table. Works on the marks of assets cut by a border only."""
    cuts = marks.groupBy("asset_id").agg(F.count_if(F.col("what") == "tail").alias("t"), F.count_if(F.col("what") == "head").alias("h")).where("t > 0 and h > 0 and t + h > 2").select("asset_id")
    rows = marks.join(cuts, "asset_id", "left_semi").select("what", "asset_id", "at", "is_scan", "discovery_id", "old_name", "new_name", "tail")

    def run(pdf):
        import pandas as pd

        pdf = pdf.assign(o=(pdf.what != "head").astype(int), s=(~pdf.is_scan).astype(int)).sort_values(["s", "at", "discovery_id", "o"], kind="stable")
        out, table, nxt, later, here, ahead = [], None, None, {}, {}, None  # later: names of the next head -> (column, type)
        for m in reversed(list(pdf.itertuples())):
            made = json.loads(m.new_name)
            own = made["table"]
            if m.what == "tail":
                live = _load(m.old_name)
                if table is None:
                    table, here = Table(), {}
                    table.columns = {c: tuple(v) for c, v in own.items()}
                    here = {c: (c, v[0]) for c, v in own.items()}
                else:
                    here = before(live, steps(live, nxt), later, table)
                    here |= {c: table.removed(v[1], v[0]) for c, v in own.items() if c not in live}
                ahead = m.tail
                out += [(m.asset_id, m.tail, c, *v) for c, v in here.items()]
            else:
                if table is None:
                    table = Table()
                    table.columns = {c: tuple(v) for c, v in own.items()}
                nxt, goes_on = _load(m.old_name), m.tail == m.tail and m.tail == ahead
                later = {n: here[v[0]] if goes_on else tuple(v) for n, v in made["names"].items()}
        return pd.DataFrame(out, columns=["asset_id", "tail", "mid", "end", "end_type"])

    return rows.groupBy("asset_id").applyInPandas(run, "asset_id string, tail bigint, mid string, end string, end_type string")


def consistent_table(scans: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(asset_id, column_name, column_type, n_files, n_keep, n_rename, n_cast, n_default): the columns of each
    asset's one table, each of one type, how many files reach it by which rule, and how many lack it."""
    return routes(scans, assets).groupBy("asset_id", "column_name", "column_type").agg(
        F.count_if(F.col("rule") != "default").alias("n_files"),
        F.count_if(F.col("rule") == "keep").alias("n_keep"),
        F.count_if(F.col("rule").startswith("rename")).alias("n_rename"),
        F.count_if(F.col("rule").endswith("cast")).alias("n_cast"),
        F.count_if(F.col("rule") == "default").alias("n_default"),
    )
