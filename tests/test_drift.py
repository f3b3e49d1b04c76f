import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from metaloom.operators import drift

SCANS = "id bigint, asset_id string, discovered_at timestamp, schema_json string, old_name string, tail string"
ASSETS = "id string, columns string, change_kind string"


def col(n, t="string", d=None):
    return {"name": n, "type": t} | ({"description": d} if d else {})


@pytest.mark.parametrize(
    "names, kind",
    [
        ("string large_string VARCHAR2(200) TEXT CLOB varchar(10) utf8", "string"), ("int32 INTEGER int", "int32"), ("int64 BIGINT long bigint", "int64"), ("float REAL float32", "float"),
        ("double BINARY_DOUBLE float64", "double"), ("bool BOOLEAN", "boolean"), ("date32[day] DATE date", "date"), ("timestamp[ns] TIMESTAMP(6) DATETIME timestamp[us,tz=UTC]", "timestamp"),
        ("decimal128(12,2) NUMBER(12,2) numeric(12,2) decimal(12,2)", "decimal(12,2)"), ("struct<a:int64> STRUCT<x:string,y:list>", "struct"), ("list<item:string> ARRAY array<int>", "list"), ("map<string,string> MAP", "map"),
    ],
)
def test_types(names, kind):
    assert {drift.canonical_type(n) for n in names.split()} == {kind}


def test_types_with_blanks():
    assert drift.canonical_type("DOUBLE PRECISION") == "double"
    assert drift.canonical_type("decimal128(18, 4)") == "decimal(18,4)"
    assert drift.canonical_type("TIMESTAMP(6) WITH TIME ZONE") == "timestamp"
    assert drift.canonical_type("NUMBER(10)") == "decimal(10,0)"
    assert drift.canonical_type("geometry") == "geometry"


def test_shapes():
    want = {"a": ("string", ""), "b": ("int32", "x")}
    for doc in (
        {"columns": [col("a"), col(" b\t", "INTEGER", "x")]},
        {"fields": [{"field": "a", "dtype": "string"}, {"field": "b", "dtype": "int", "comment": "x"}], "version": 1},
        [col("a"), json.dumps(col("b", "int32", "x"))],
        json.dumps({"columns": json.dumps([col("a"), col("b", "int32", "x")])}),
    ):
        assert drift.schema_of(json.dumps(doc)) == want
    assert drift.schema_of('{"columns": {"a": "VARCHAR(3)", "name": "string", "type": "DATE"}}') == {"a": ("string", ""), "name": ("string", ""), "type": ("date", "")}
    assert drift.schema_of('{"columns": {"name": "a", "type": "string", "nullable": true}}') == {"a": ("string", "")}
    for bad in (None, "", "{", "{}", "[]", '{"columns": []}', '"x"', "[1]", '[{"type": "string"}]', '{"columns": [{"name": "a"}'):
        assert drift.schema_of(bad) is None


def test_steps():
    s = lambda *c: drift.schema_of(json.dumps(list(c)))
    assert drift.steps(s(col("a"), col("b")), s(col("b"), col("a"))) == []
    assert drift.steps(s(col("user_id", "int32")), s(col("User ID", "int64"))) == [("renamed", "user_id", "User ID"), ("retyped", "user_id", "User ID")]
    assert drift.steps(s(col("a", "date", "day")), s(col("z", "date", " day "))) == [("renamed", "a", "z")]
    assert drift.steps(s(col("a", "date", "day")), s(col("z", "string", "day"))) == [("removed", "a", ""), ("added", "", "z")]
    assert drift.steps(s(col("a", "date")), s(col("z", "date"))) == [("removed", "a", ""), ("added", "", "z")]
    assert drift.steps(s(col("a", "int")), s(col("a", "bigint"))) == [("retyped", "a", "a")]


def brute(scans, assets):
    groups, own = defaultdict(list), {i.strip().lower(): c for i, c in assets if i and i.strip()}
    for i, a, at, doc in scans:
        if a and a.strip() and (s := drift.schema_of(doc)):
            groups[a.strip().lower()].append((at or datetime.min, i, s))
    changes, routes = [], []
    for a, rows in groups.items():
        chain = [(i, s) for _, i, s in sorted(rows, key=lambda r: r[:2])]
        if s := drift.schema_of(own.get(a)):
            chain.append((0, s))
        for (_, x), (i, y) in zip(chain, chain[1:]):
            changes += [(a, i, *c) for c in drift.steps(x, y)]
        # walk forward instead: follow each column of each file to where it ends
        last = chain[-1][1]
        ends, gone = {}, []
        for k, (_, s) in enumerate(chain):
            for n in s:
                name, at = n, k
                while at < len(chain) - 1:
                    found = drift.steps(chain[at][1], chain[at + 1][1])
                    if (name in {o for c, o, _ in found if c == "removed"}):
                        break
                    name = dict((o, w) for c, o, w in found if c == "renamed").get(name, name)
                    at += 1
                ends[k, n] = (at, name)
                if at < len(chain) - 1 and (at, name) not in gone:
                    gone.append((at, name))
        taken, column = set(last), {}
        for at, name in sorted(gone, key=lambda g: (-g[0], g[1])):
            k, free = 0, name
            while free in taken:
                k += 1
                free = f"{name}#{k}"
            taken.add(free)
            column[at, name] = (free, chain[at][1][name][0])
        column |= {(len(chain) - 1, n): (n, t) for n, (t, _) in last.items()}
        mine = []
        for k, (i, s) in enumerate(chain):
            if i:
                mine += [(a, i, n, t, *column[ends[k, n]]) for n, (t, _) in s.items()]
        table = {r[4:6] for r in mine}
        mine += [(a, i, None, None, *c) for i, s in chain if i for c in table - {r[4:6] for r in mine if r[1] == i}]
        routes += mine
    return sorted(changes), sorted(routes, key=str)


def made(seed, n=160):
    rng = random.Random(seed)
    names, docs = ["a", "b", "c", "a_b", "A B", "d"], []
    for i in range(1, n + 1):
        cols = [col(x, rng.choice(["int", "string"]), rng.choice([None, "one", x])) for x in rng.sample(names, rng.randint(0, 4))]
        doc = rng.choice([json.dumps(cols), json.dumps({"columns": cols}), json.dumps(json.dumps(cols)), None, "{"]) if rng.random() < 0.9 else "[]"
        asset = "hot" if rng.random() < 0.6 else rng.choice([" X", "x ", "y", None, " "])
        docs.append((i, asset, None if rng.random() < 0.05 else datetime(2025, 1, 1) + timedelta(days=rng.randrange(20)), doc))
    return docs, [("hot", json.dumps([col("a", "string"), col("q")])), ("Y", None), ("lonely", json.dumps([col("a")]))]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_with_a_hot_asset(spark, seed):
    scans, assets = made(seed)
    s = spark.createDataFrame([(*r, "clash", "clash") for r in scans], SCANS)
    a = spark.createDataFrame([(*r, "clash") for r in assets], ASSETS)
    changes, routes = brute(scans, assets)
    got = drift.schema_changes(s, a).select("asset_id", "discovery_id", "change_kind", "old_name", "new_name").collect()
    assert sorted(map(tuple, got)) == changes
    got = drift.routes(s, a).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == routes
    for r in got:
        moved, cast = r.source_name != r.column_name, r.source_type != r.column_type
        assert r.rule == ("default" if r.source_name is None else "_".join(["rename"] * moved + ["cast"] * cast) or "keep")
    table = drift.consistent_table(s, a).collect()
    assert {(r.asset_id, r.column_name, r.column_type) for r in table} == {(r[0], *r[4:6]) for r in routes}
    assert len({(r.asset_id, r.column_name) for r in table}) == len(table)
    files = {a: len({r[1] for r in routes if r[0] == a}) for a in {r[0] for r in routes}}
    assert all(r.n_files + r.n_default == files[r.asset_id] and r.n_files >= r.n_keep for r in table)


def test_a_column_added_again_is_another_one(spark):
    docs = [[col("x", "int"), col("y")], [col("y")], [col("x"), col("y")]]
    s = spark.createDataFrame([(i + 1, "a", datetime(2025, 1, 1 + i), json.dumps(d), "", "") for i, d in enumerate(docs)], SCANS)
    got = {(r.discovery_id, r.column_name): (r.source_type, r.column_type, r.rule) for r in drift.routes(s).collect()}
    assert got[1, "x#1"] == ("int32", "int32", "rename") and got[3, "x"] == ("string", "string", "keep")
    assert got[2, "x"] == (None, "string", "default") and got[2, "x#1"] == (None, "int32", "default") and len(got) == 9
    t = {r.column_name: r for r in drift.consistent_table(s).collect()}
    assert (t["x"].column_type, t["x"].n_files, t["x"].n_default) == ("string", 1, 2) and t["x#1"].column_type == "int32"


def test_empty(spark):
    s = spark.createDataFrame([], SCANS)
    assert drift.schema_changes(s).count() == 0
    assert drift.routes(s, spark.createDataFrame([], ASSETS)).count() == 0
