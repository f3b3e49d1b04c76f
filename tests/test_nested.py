import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metaloom.operators import nested

REP = set(nested.REPEATED)


def brute(text, field):
    """Recursive, on the whole document."""

    def loads(t):
        try:
            return json.loads(t, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None

    def open_(v):
        while isinstance(v, str):
            w = loads(v) if v.strip()[:1] in ("{", "[", '"') and v.strip() else None
            if not isinstance(w, (dict, list, str)):
                return v
            inner = w
            while isinstance(inner, str):
                inner = loads(inner) if inner.strip()[:1] in ("{", "[", '"') and inner.strip() else None
            if not isinstance(inner, (dict, list)):
                return v
            v = inner
        return v

    out = []

    def walk(v, path, row):
        if isinstance(v, list):
            for i, e in enumerate(v):
                e = open_(e)
                here = f"{path}[{i}]"
                if isinstance(e, dict):
                    out.append((here, row))
                    walk(e, here, here)
                elif isinstance(e, list):
                    walk(e, here, row)
        elif isinstance(v, dict):
            for k, e in v.items():
                e = open_(e)
                if isinstance(e, dict) and k in REP:
                    e = [e]
                walk(e, f"{path}.{k}" if path else k, row)

    d = open_(loads(text)) if text else None
    if isinstance(d, dict) and field in REP:
        d = [d]
    if isinstance(d, (dict, list)):
        walk(d, "", "")
    return sorted(out)


DOCS = [
    None, "", "  ", "{", "[1, 2", "nonsense", "NaN", "[]", "{}", "7", '"x"',
    '[{"name": "a", "type_info": {"fields": [{"name": "b", "type_info": "{\\"element\\": {\\"fields\\": {\\"name\\": \\"c\\"}}}"}]}}, null, {"name": "d"}]',
    '{"name": "lone", "pii_types": ["X", "Y"]}',
    json.dumps(json.dumps([{"a": 1}])),
    json.dumps(json.dumps(json.dumps({"partitions": {"files": [None, {"replicas": {"zone": 1}}]}}))),
    '{"format_specific": {"parquet": {"rowGroups": {"chunks": [{"i": 1}, "{\\"i\\": 2}", 5, [[{"deep": 1}]]]}}}}',
    '{"tags": [{"k": 1}], "x.y": {"parts": []}, "note": "[not json", "text": "{\\"parts\\": {}}"}',
    '{"a": "\\u00e9\\ud83d\\ude00", "files": [{"p": "' + "z" * 50_000 + '"}]}',
    '{"v": NaN, "files": [{}]}',
    "[" * 40 + '{"x": 1}' + "]" * 40,
]


@pytest.mark.parametrize("field", ["columns", "technical_metadata"])
def test_against_brute_force(spark, field):
    rows = [(i, d, "clash", "clash") for i, d in enumerate(DOCS)] + [(None, '[{"a": 1}]', "clash", "clash")]
    df = spark.createDataFrame(rows, "id bigint, d string, node_path string, record_key string")
    got = nested.found(nested.shred_table(df, "id", {field: "d"})).collect()
    for i, d in enumerate(DOCS):
        assert sorted((r.node_path, r.parent_path) for r in got if r.record_key == str(i)) == brute(d, field), d
    assert [r.node_path for r in got if r.record_key is None] == ["[0]"]


def plain(text, field):
    """The rows of one document, by a recursive walk over Python's own reading of it."""
    doc = nested.unwrap(nested.parse(text))
    if type(doc) is dict and field in REP:
        doc = [doc]
    if type(doc) not in (dict, list):
        return []
    rows = [("", "", None, 0, [])]

    def value(v):
        return v if type(v) is str else json.dumps(v)

    def walk(v, path, group, row, out, inner):
        if type(v) is list:
            for i, e in enumerate(v):
                e = nested.unwrap(e)
                if type(e) is dict:
                    rows.append((group + "[]", f"{path}[{i}]", row, i, []))
                    walk(e, f"{path}[{i}]", group + "[]", f"{path}[{i}]", rows[-1][4], "")
                elif type(e) is list:
                    walk(e, f"{path}[{i}]", group + "[]", row, out, inner + "[]")
                elif e is not None:
                    out.append((inner + "[]", i, value(e)))
            return
        for k, e in v.items():
            e = nested.unwrap(e)
            e = [e] if type(e) is dict and k in REP else e
            p, g, n = (f"{x}.{k}" if x else k for x in (path, group, inner))
            if type(e) in (dict, list):
                walk(e, p, g, row, out, n)
            else:
                out.append((n, 0, None if e is None else value(e)))

    walk(doc, "", "", "", rows[0][4], "")
    return rows


def sorted_rows(rows):
    return sorted((g, n, p or "", o, sorted((a, b, c or "") for a, b, c in t)) for g, n, p, o, t in rows)


_json = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 99) | st.text("ab\"\\{[ é", max_size=4),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["a", "files", "parts", "b c", "fields"]), x, max_size=4) | x.map(json.dumps),
    max_leaves=20,
)


@settings(max_examples=150, deadline=None)
@given(_json, st.sampled_from(["columns", "other"]), st.sampled_from([None, 1]), st.integers(0, 40))
def test_stream_against_a_recursive_walk(v, field, indent, cut):
    text = json.dumps(v, indent=indent)
    assert sorted_rows(nested.shred(text, field)) == sorted_rows(plain(text, field))
    short = text[:cut]
    assert sorted_rows(nested.shred(short, field)) == sorted_rows(plain(short, field))


@pytest.mark.parametrize("text", ['[1,]', '{"a":1,}', '{"a" 1}', '[1 2]', '{"a":1]', '[}', '[01]', '["\\x"]', '[1]x', '{,}', '["a\nb"]', '[tru]', '[-]', '[1.]', '{"a":"{\\"b\\":1"} ]'])
def test_incomplete_documents_give_nothing(text):
    assert nested.shred(text, "other") == [] and nested._tree(text) is None


def test_no_depth_is_too_deep_and_no_number_too_long():
    deep = '{"a":' * 100_000 + '[{"b": 1}]' + "}" * 100_000
    rows = nested.shred(deep, "other")
    assert len(rows) == 2 and rows[1][4] == [("b", 0, "1")]
    assert nested.parse("[" * 50_000 + "]" * 50_000) is not None
    n = "7" * 5_000
    assert nested.shred('{"files": [{"n": %s}]}' % n, "other")[1][4] == [("n", 0, n)]
    assert nested.parse('{"n": %s}' % n) == {"n": n}


def test_repeated_keys_count_once():
    rows = nested.shred('{"a": 1, "files": [{"x": 1}], "a": {"b": 2, "b": 3}, "files": [{"y": 1}, {}]}', "other")
    assert sorted_rows(rows) == sorted_rows([("", "", None, 0, [("a.b", 0, "3")]), ("files[]", "files[0]", "", 0, [("y", 0, "1")]), ("files[]", "files[1]", "", 1, [])])
    assert nested.shred('["\\ud83d"]', "other")[0][4] == [("[]", 0, "\ufffd")]


def test_flat_tables_keep_links_and_values(spark):
    d = '{"bucket": {"name": "b", "replicas": [{"zone": "n", "endpoints": [{"kind": "web", "secure": true}]}, {"zone": "s", "tags": [3, "x"]}]}}'
    n = nested.shred_table(spark.createDataFrame([(1, d)], "id int, d string"), "id", {"loc": "d"})
    t = nested.flat_table(n, "loc", "bucket.replicas[]", {"zone": "zone", "tags": "tags[]", "ordinal": "zone"}).orderBy("ordinal").collect()
    assert [(r.zone, r.tags, r.ordinal, r.ordinal_) for r in t] == [("n", [], 0, "n"), ("s", ["3", "x"], 1, "s")]
    e = nested.flat_table(n, "loc", "bucket.replicas[].endpoints[]", {"kind": "kind", "secure": "secure"}).collect()
    assert [(r.kind, r.secure, r.parent_path) for r in e] == [("web", "true", "bucket.replicas[0]")]
    root = nested.flat_table(n, "loc", "", {"name": "bucket.name"}).collect()
    assert [(r.name, r.parent_path) for r in root] == [("b", None)]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, columns string, technical_metadata string")
    assert nested.shred_table(df, "id", {"columns": "columns"}).count() == 0


def test_tables_hold_every_object_and_value(spark, sf):
    """The tables of all shapes together: each row of the documents once, each value once."""
    from collections import Counter

    import __spark_entry__ as entry
    from metaloom.plans import training

    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    want_rows, want_values = Counter(), Counter()
    for r in training._nodes(t).collect():
        want_rows[r.record_key, r.field_name, r.node_path, r.parent_path] += 1
        for x in r.triples:
            if x.value is not None:
                want_values[r.record_key, r.field_name, r.node_path, x.path, x.value] += 1
    rows, values = Counter(), Counter()
    for shape, columns in training._FLAT.items():
        for r in entry.queries()[f"p5_{shape}"](spark, sf).collect():
            rows[r.record_key, r.field_name, r.node_path, r.parent_path] += 1
            for p, v in r.rest.items():
                for x in v:
                    values[r.record_key, r.field_name, r.node_path, p, x] += 1
            for n, p in columns.items():
                v = r[n + "_" if n in nested.TAKEN else n]
                for x in v if isinstance(v, list) else [v] * (v is not None and p not in r.rest):
                    values[r.record_key, r.field_name, r.node_path, p, x] += x is not None
    assert rows == want_rows and values == want_values


def test_unknown_keys_and_shapes_stay(spark):
    d = '[{"name": "a", "odd": 1, "x.y": "p", "x": {"y": "q"}, "type_info": {"fields": [{"name": "b", "tags": ["s", null, "t"]}]}, "strange": [{"k": 5}]}]'
    n = nested.shred_table(spark.createDataFrame([(1, d)], "id int, d string"), "id", {"columns": "d"})
    t = sorted(nested.shape_table(n, ("columns", "fields"), {"name": "name", "xy": "x.y"}).collect(), key=lambda r: r.node_path)
    assert [(r.node_path, r.parent_path, r.name) for r in t] == [("[0]", "", "a"), ("[0].type_info.fields[0]", "[0]", "b")]
    assert t[0].rest["odd"] == ["1"] and sorted(t[0].rest["x.y"]) == ["p", "q"] and t[1].rest == {"tags[]": ["s", "t"]}
    o = nested.shape_table(n, None, {}).collect()
    assert [(r.node_path, r.parent_path, r.rest) for r in o] == [("[0].strange[0]", "[0]", {"k": ["5"]})]
