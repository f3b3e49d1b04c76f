"""Deeply nested semi-structured records into related flat tables.

Each record is read as a stream, one member or element at a time, straight into path-value-ordinal triples;
no tree of it is built, and no depth is too deep. The triples are grouped by their nearest repeated
ancestor, which is the row they belong to; `flat_table` and `shape_table` then pivot groups into tables. A
record's triples never leave the task that read it, so nothing is shuffled, whatever the skew.
"""

from __future__ import annotations

import json
import re
from itertools import chain
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.util import arrow_map

#: Keys whose value is an array of objects; a lone object stands for an array of one (fixed values).
REPEATED = ("columns", "fields", "row_groups", "rowGroups", "chunks", "partitions", "files", "replicas", "endpoints", "parts")

#: Shapes with a table of their own: the keys their arrays stand under (fixed values).
SHAPES = {
    "documents": ("",), "columns": ("columns", "fields"), "replicas": ("replicas",), "endpoints": ("endpoints",), "partitions": ("partitions",),
    "files": ("files",), "row_groups": ("row_groups", "rowGroups"), "chunks": ("chunks",), "parts": ("parts",),
}

#: Key columns of every shape's table.
TAKEN = {"record_key", "field_name", "group_path", "node_path", "parent_path", "ordinal", "rest"}

NODES = (
    "record_key string, field_name string, group_path string, node_path string, parent_path string, ordinal int, "
    "triples array<struct<path: string, ordinal: int, value: string>>"
)


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).decode

#: JSON's grammar: blanks, a string, a number or word (fixed values).
_WS = r"[ \t\n\r]*+"
_STRING = r'"([^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+)"'
_SCALAR = r"(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)"
#: Groups of a match: 1 key, 2 string, 3 scalar, 4 what follows it, 5 the bracket that opens.
_MEMBER = re.compile(rf"{_STRING}{_WS}:{_WS}(?:(?:{_STRING}|{_SCALAR}){_WS}([,}}]){_WS}|([{{\[]){_WS})").match
_ELEMENT = re.compile(rf"()(?:(?:{_STRING}|{_SCALAR}){_WS}([,\]]){_WS}|([{{\[]){_WS})").match
_WHOLE = re.compile(f"{_WS}(?:{_STRING}{_WS}$|([{{\\[]){_WS})").match
_CLOSED = re.compile(f"([,}}\\]]){_WS}").match


def _text(text: str, at: int) -> str:
    """The string whose content starts at a place; halves of surrogate pairs become replacement characters."""
    v = scanstring(text, at)[0]
    try:
        v.encode()
    except UnicodeEncodeError:
        v = v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return v


def parse(text: str | None):
    """A complete JSON document, else None. Python's extensions (NaN, Infinity) are refused. What Python's own
    reader cannot hold (nesting beyond its stack, numbers of thousands of digits) is read without recursion."""
    if not text or text.isspace():
        return None
    try:
        return _decode(text)
    except json.JSONDecodeError:
        return None
    except RecursionError:
        return _tree(text)
    except ValueError as e:
        return _tree(text) if "digits" in str(e) else None


def _tree(text: str):
    """The document as dicts and lists, by a loop; numbers stay text."""
    word = {"true": True, "false": False, "null": None}
    m = _WHOLE(text)
    if m is None or not m[2]:
        return None
    box: dict | list = {} if m[2] == "{" else []
    stack, pos, fresh = [], m.end(), True
    while True:
        obj = type(box) is dict
        m = (_MEMBER if obj else _ELEMENT)(text, pos)
        if m is None:
            if not fresh or text[pos : pos + 1] != ("}" if obj else "]"):
                return None
            pos, closed = _blank(text, pos + 1), True
        else:
            pos, fresh = m.end(), False
            v = _text(text, m.start(2)) if m[2] is not None else word.get(m[3], m[3]) if m[3] is not None else {} if m[5] == "{" else []
            if obj:
                box[_text(text, m.start(1))] = v
            else:
                box.append(v)
            if m[5]:
                stack.append(box)
                box, fresh = v, True
                continue
            closed = m[4] != ","
        while closed:
            if not stack:
                return box if pos == len(text) else None
            box = stack.pop()
            m = _CLOSED(text, pos)
            if m is None or m[1] == ("]" if type(box) is dict else "}"):
                return None
            pos, closed = m.end(), m[1] != ","


def _blank(text: str, pos: int) -> int:
    while text[pos : pos + 1] in (" ", "\t", "\n", "\r") and pos < len(text):
        pos += 1
    return pos


def unwrap(v):
    """A string that holds the JSON text of an object or array counts as what the text says."""
    if type(v) is str:
        t = v.strip()
        if t[:1] in ("{", "[", '"') and len(t) > 1:
            x = unwrap(parse(t))
            if type(x) in (dict, list):
                return x
    return v


def _stream(text: str, rows: list, at: tuple, key, repeated, dropped=frozenset()) -> bool:
    """Read one JSON text that stands at a place into rows; False if it is no complete object or array, or
    a string that holds one. at is (path, group, row, triples, path within the row) and key is the key it
    stands under, None for an element of an array with its number as the last of at. Texts within strings are read by a
    call of their own; each level of them doubles the escapes, so their depth is that of a logarithm."""
    whole = _WHOLE(text)
    if whole is None:
        return False
    if whole[2] is None:
        inner = _text(text, whole.start(1)).strip()
        return inner[:1] in ("{", "[", '"') and len(inner) > 1 and _stream(inner, rows, at, key, repeated)
    n_rows, n_out, again = len(rows), len(at[3]), set()
    pos, bracket, fresh = whole.end(), whole[2], True
    stack: list = []
    # of the container read: kind, place, sink of its rows, next element's number, keys seen with their places
    obj, path, group, row, out, inner, sink, i, seen = _open(bracket, at, key, repeated, rows)
    while True:
        start = pos
        m = (_MEMBER if obj else _ELEMENT)(text, pos)
        if m is None:
            if not fresh or text[pos : pos + 1] != ("}" if obj else "]"):
                break
            pos, closed = _blank(text, pos + 1), True
        else:
            pos, fresh, last = m.end(), False, m.lastindex
            into, to = sink, out
            if obj:
                k = m[1]
                if "\\" in k:
                    k = _text(text, m.start(1))
                if k in seen:
                    again.add(seen[k])
                seen[k] = start
                if start in dropped:  # a later member of the same key counts
                    into, to = [], []
            else:
                k = None
            if last == 5:
                stack.append((obj, path, group, row, out, inner, sink, i + 1, seen))
                fresh = True
                obj, path, group, row, out, inner, sink, i, seen = _open(m[5], (path, group, row, to, inner, i), k, repeated, into)
                continue
            v = m[2]
            if v is not None:
                if "\\" in v:
                    v = _text(text, m.start(2))
                t = v.strip() if v[:1] in _MAY_OPEN else ""
                if len(t) > 1 and t[0] in '{["' and _stream(t, into, (path, group, row, to, inner, i), k, repeated):
                    v = to = None
            elif (v := m[3]) == "null":
                v = None
                if not obj:
                    to = None
            if to is not None:
                if obj:
                    to.append((f"{inner}.{k}" if inner else k, 0, v))
                else:
                    to.append((inner + "[]", i, v))
            i += 1
            closed = m[4] != ","
        while closed:
            if not stack:
                if pos != len(text):
                    break
                if not again - dropped:
                    return True
                del rows[n_rows:], at[3][n_out:]
                return _stream(text, rows, at, key, repeated, frozenset(again))
            obj, path, group, row, out, inner, sink, i, seen = stack.pop()
            m = _CLOSED(text, pos)
            if m is None or m[1] == ("]" if obj else "}"):
                stack = None
                break
            pos, closed = m.end(), m[1] != ","
        if closed:
            break
    del rows[n_rows:], at[3][n_out:]
    return False


def _open(bracket: str, at: tuple, key, repeated, sink: list):
    """The state of a container that opens at a place. An object that is an element of an array, or stands
    alone for an array, begins a row of its own."""
    path, group, row, out, inner = at[:5]
    if key is None:
        i = at[5]
        path, group = f"{path}[{i}]", group + "[]"
        if bracket == "{":
            out = []
            sink.append((group, path, row, i, out))
            row, inner = path, ""
        else:
            inner += "[]"
    elif key is not _ROOT:
        path, group, inner = f"{path}.{key}" if path else key, f"{group}.{key}" if group else key, f"{inner}.{key}" if inner else key
    if bracket == "{" and key in repeated and key is not None:
        path, group, out = f"{path}[0]", group + "[]", []
        sink.append((group, path, row, 0, out))
        row, inner = path, ""
    return bracket == "{", path, group, row, out, inner, sink, 0, {}


#: Stands for the key of a document, which has none.
_ROOT = object()
_MAY_OPEN = frozenset('{[" \t\n\r')


def shred(text: str | None, field: str, repeated=frozenset(REPEATED)) -> list[tuple]:
    """[(group_path, node_path, parent_path, ordinal, triples)] of the root and of every object that is an
    element of an array; empty unless the text is a complete document. Nulls in arrays have no row but keep
    their place. Scalars in arrays are triples of the row around them, with their ordinal. Values are text as
    delivered. Of a key repeated within an object the last counts."""
    if not text or text.isspace():
        return []
    root: list = []
    rows: list = [("", "", None, 0, root)]
    # a lone object of a repeated field is an array of one
    done = _stream(text, rows, ("", "", "", root, ""), _ROOT, repeated | {_ROOT} if field in repeated else repeated)
    return rows if done else []


def shred_table(df: DataFrame, key: Column | str, docs: dict[str, Column | str]) -> DataFrame:
    """Rows of every document as (record_key, field_name, group_path, node_path, parent_path, ordinal,
    triples). docs maps a field name to its column; the key is given as text.

    node_path is the keys as delivered, joined by dots, with [i] after an array; group_path the same
    with [] for every index. A row with an empty node_path is the document itself. Documents that are
    null, blank or not complete JSON yield nothing; a null key keeps its rows under a null key."""
    key = F.col(key) if isinstance(key, str) else key
    names = list(docs)
    src = df.select(key.cast("string").alias("k"), *((F.col(c) if isinstance(c, str) else c).alias(f"d{i}") for i, c in enumerate(docs.values())))
    part = pa.struct([("path", pa.string()), ("ordinal", pa.int32()), ("value", pa.string())])
    schema = pa.schema([
        ("record_key", pa.string()), ("field_name", pa.string()), ("group_path", pa.string()), ("node_path", pa.string()),
        ("parent_path", pa.string()), ("ordinal", pa.int32()), ("triples", pa.list_(part)),
    ])

    def run(batches):
        keys_out: list = []
        rows: list = []
        size = 0

        def flush():
            group, node, parent, ordinal, triples = zip(*rows)
            ends = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(t) for t in triples], out=ends[1:])
            flat = list(zip(*chain.from_iterable(triples))) or [(), (), ()]
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, part)], fields=list(part))
            cols = [*zip(*keys_out), group, node, parent, ordinal]
            arrays = [pa.array(c, f.type) for c, f in zip(cols, schema)] + [pa.ListArray.from_arrays(pa.array(ends), inner)]
            rows.clear()
            keys_out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, name in enumerate(names):
                for key_, text in zip(keys, b.column(i + 1)):
                    text = text.as_py()
                    if found := shred(text, name):
                        rows += found
                        keys_out += [(key_, name)] * len(found)
                        size += len(text)
                        if len(rows) >= 20_000 or size > 16_000_000:  # texts of any length leave in small batches
                            yield flush()
                            size = 0
            if rows:
                yield flush()

    return arrow_map(src, run, NODES)


def _value(path: str) -> Column:
    found = F.filter("triples", lambda t: t.path == F.lit(path))
    if path.endswith("[]"):
        return F.transform(F.array_sort(F.transform(found, lambda t: F.struct(t.ordinal, t.value))), lambda t: t.value)
    return F.get(F.transform(found, lambda t: t.value), F.lit(0))


def flat_table(nodes: DataFrame, field: str, group: str, columns: dict[str, str]) -> DataFrame:
    """Pivot one group of `shred_table` into a table of record_key, node_path, parent_path, ordinal and
    one column for each entry of columns: name -> path within the row. A path ending in [] becomes an
    array in its order, any other a string. A clash with the key columns is settled by a trailing _."""

    taken = {"record_key", "node_path", "parent_path", "ordinal"}
    return nodes.where((F.col("field_name") == field) & (F.col("group_path") == group)).select(
        "record_key", "node_path", "parent_path", "ordinal",
        *(_value(p).alias(n + "_" if n in taken else n) for n, p in columns.items()),
    )


def shape_table(nodes: DataFrame, keys: tuple[str, ...] | None, columns: dict[str, str]) -> DataFrame:
    """Pivot all groups of one shape, at any depth and in any document, into a table of record_key,
    field_name, group_path, node_path, parent_path, ordinal, one column for each entry of columns as in
    `flat_table`, and rest: every other value that is not null, as path -> values. A shape is the last
    keys of the array (`group_key`); keys=None takes the groups of no shape in SHAPES. The row around an
    object is that of (record_key, field_name, parent_path), in another of these tables."""
    key = group_key(F.col("field_name"), F.col("group_path"))
    known = [k for s in SHAPES.values() for k in s]
    mine = key.isin(*keys) if keys is not None else ~key.isin(*known)
    once = [p for p in columns.values() if not p.endswith("[]")]
    many = [p for p in columns.values() if p.endswith("[]")]
    filled = F.filter("triples", lambda t: t.value.isNotNull() & ~t.path.isin(*many))

    def values(p: Column) -> Column:
        v = F.transform(F.array_sort(F.transform(F.filter(filled, lambda t: t.path == p), lambda t: F.struct(t.ordinal, t.value))), lambda t: t.value)
        return F.struct(p.alias("key"), v.alias("value"))

    # a path that two spellings of keys lead to has several values: they are all in rest
    entries = F.transform(F.array_distinct(F.transform(filled, lambda t: t.path)), values)
    rest = F.map_from_entries(F.filter(entries, lambda e: ~e.key.isin(*once) | (F.size(e.value) > 1)))
    return nodes.where(mine).select(
        "record_key", "field_name", "group_path", "node_path", "parent_path", "ordinal",
        *(_value(p).alias(n + "_" if n in TAKEN else n) for n, p in columns.items()), rest.alias("rest"),
    )


def group_key(field: Column, group: Column) -> Column:
    """The shape of a group: the key its arrays stand under, the field where the document itself is the
    array, empty for the document."""
    bare = F.regexp_replace(group, r"(\[\])+$", "")
    return F.when(group == "", "").when(bare == "", field).otherwise(F.regexp_extract(bare, r"([^.\]]*)$", 1))


def group_columns(nodes: DataFrame) -> DataFrame:
    """The relational schema that the documents imply: (field_name, group_path, path, n_values,
    n_rows), to choose the columns of `flat_table` from."""
    return (
        nodes.select("field_name", "group_path", F.explode("triples").alias("t"))
        .groupBy("field_name", "group_path", F.col("t.path").alias("path"))
        .agg(F.count("t.value").alias("n_values"), F.count("*").alias("n_rows"))
    )


def found(nodes: DataFrame) -> DataFrame:
    """(record_key, field_name, node_path, parent_path) of the rows of all flat tables but those of the
    documents themselves: every object that is an element of an array. The pivoted columns are not asked for."""
    rows = nodes.withColumn("shape", group_key(F.col("field_name"), F.col("group_path")))
    return rows.where("shape <> '' and node_path <> ''").select("record_key", "field_name", "node_path", "parent_path")
