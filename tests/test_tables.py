import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metaloom.operators import catalog as C
from metaloom.operators import dedup as D
from metaloom.operators import ingest as K
from metaloom.operators import quality as Q
from metaloom.sources import containers, dictionary, files
from metaloom.streaming import feeds
from metaloom.util import ship


def test_listing_keeps_visible_or_unscanned(spark):
    a = spark.createDataFrame([("A", 1), ("b", 2), ("c", 3)], "id string, discovery_id int").drop("discovery_id")
    d = spark.createDataFrame([(1, " a", True), (2, "a", True), (3, "a", False), (4, "b", False), (5, None, True)], "id bigint, asset_id string, is_visible boolean")
    assert sorted((r.id, r.discovery_id) for r in C.listing(a, d).collect()) == [("A", 2), ("c", None)]
    assert [r.id for r in C.unscanned(a, d).collect()] == ["c"]
    assert C.listing(a, d.where("false")).count() == 3


def test_search_is_literal(spark):
    a = spark.createDataFrame([("50%_off", "x"), ("500 off", "x"), (None, "Has 50%_"), (None, None)], "name string, catalog string")
    assert C.search(a, "50%_").count() == 2


def test_columns_in_all_shapes(spark):
    one = {"name": "n", "type": "t", "pii_types": ["A"], "type_info": {"x": 1}}
    docs = [json.dumps([one, {"type": "nameless"}]), json.dumps(one), json.dumps(json.dumps([one])), None, "", "{", "[]"]
    a = spark.createDataFrame([(str(i), d, "clash") for i, d in enumerate(docs)], "id string, columns string, pos string")
    assert sorted((r.asset_id, r.pos, r.name) for r in C.asset_columns(a).collect()) == [("0", 0, "n"), ("1", 0, "n"), ("2", 0, "n")]


def test_application_by_prefix(spark):
    a = spark.createDataFrame([("1", "azure_blob_x"), ("2", "azure_blob_x_more"), ("3", "none"), ("4", None)], "id string, connector_id string")
    c = spark.createDataFrame([(1, "x", "azure_blob", '{"application_name": "App"}'), (2, "z", "azure_blob", None)], "id int, name string, connector_type string, config string")
    assert {r.id: r.application_name for r in C.applications(a, c).collect()} == {"1": "App", "2": "App", "3": None, "4": None}
    r = C.redacted(spark.createDataFrame([(1, "n", "t", '{"Account_KEY": "s", "plain": "p"}', "s"), (2, "n", "t", None, "s")], "id int, name string, connector_type string, config string, status string")).orderBy("id").collect()
    assert r[0].config == {"Account_KEY": "***", "plain": "p"} and r[1].config is None


def test_change_decision(spark):
    rows = [("a", "a", "s", "s", True), ("a", "b", "s", "s", True), ("a", "a", "s", "t", True), (None, "a", "s", "s", True), ("a", "a", "", "s", True), ("x", "x", "x", "x", False)]
    df = spark.createDataFrame(rows, "oh string, nh string, os string, ns string, known boolean")
    args = [F.col(c) for c in ("oh", "nh", "os", "ns", "known")]
    got = [tuple(r.x) for r in df.select(D.change_decision(*args).alias("x")).collect()]
    assert got == [(False, False), (False, False), (True, True), (False, False), (True, True), (True, False)]
    assert [r.x.write for r in df.select(D.change_decision(*args, on_file=True).alias("x")).collect()] == [False, True, True, True, True, True]


def test_schema_duplicates_are_settled_and_stable(spark):
    s = lambda *n: json.dumps({"columns": [{"name": x} for x in n]})
    t = datetime(2025, 1, 1)
    rows = [(1, s("a", "B"), None, t, None), (2, s(" b", "A", "a"), None, t, None), (3, s("c"), None, t, None), (4, None, None, t, None), (5, s(), None, t, None), (6, s("a", "b"), '{"timestamps": {"last_modified": "2025-06-01"}}', t, None)]
    df = spark.createDataFrame(rows, "id bigint, schema_json string, file_metadata string, updated_at timestamp, discovered_at timestamp")
    assert {r.id: r.keep for r in D.schema_duplicates(df).collect()} == {1: False, 2: False, 6: True}
    kept = df.join(D.schema_duplicates(df).where("not keep"), "id", "left_anti")
    assert D.schema_duplicates(kept).count() == 0
    assert tuple(D.duplicate_summary(df).first()) == (1, 2, 6)


def test_latest_per_folder_and_refresh(spark):
    t = lambda d: datetime(2025, 1, d)
    f = spark.createDataFrame([(1, "c", "a/x.parquet", t(1)), (2, "c", "a/y.PARQUET", t(1)), (3, "c", "a/z.csv", t(9)), (4, "c", "b/x.parquet", None), (5, None, "a/q.parquet", t(2))], "id int, container string, path string, modified timestamp")
    got = {(r.container, r.folder): r.id for r in D.latest_per_folder(f, "container", "path", "modified", "id").collect()}
    assert got == {("c", "a"): 1, ("c", "b"): 4, (None, "a"): 5}
    new = spark.createDataFrame([("c", "1", "p", t(2)), ("c", "2", "P/", t(2)), ("c", "3", "q", t(2)), ("c", "4", "q", None), ("c", "5", "q", t(2))], "container string, folder string, path string, modified timestamp")
    old = spark.createDataFrame([("c", "1", "p", t(1)), ("c", "2", "/p", t(2)), ("c", "3", "p", t(2)), ("c", "4", "p", t(2))], "container string, folder string, path string, modified timestamp")
    assert {r.folder: r.refresh for r in D.refresh_folders(new, old).collect()} == {"1": True, "2": False, "3": True, "4": False, "5": True}


def test_best_edges(spark):
    e = spark.createDataFrame([(1, "a", "b", 0.5), (2, "a", "b", 0.9), (3, "a", "b", 0.9), (4, None, "b", None), (5, None, "b", 0.1)], "id int, s string, t string, confidence_score double")
    assert sorted(r.id for r in D.best_edges(e, ["s", "t"]).collect()) == [2, 5]


def test_types_of_values(spark):
    v = {"i": ["1", "+2", "1_000", " 3 ", "x"], "d": ["1.5", "2", "3e4", ".5", "-1"], "b": ["yes", "No", "TRUE", "false", "0"], "t": ["2025-01-01", "2025-01-02 10:00", "01/02/2025", "2025-03-03", "x"], "s": ["a", "1", "2", " ", ""]}
    df = spark.createDataFrame([(k, i, x) for k, xs in v.items() for i, x in enumerate(xs)], "k string, o int, v string")
    assert {r.k: (r.n, r.type) for r in Q.inferred_type(df, ["k"], "v", "o").collect()} == {"i": (5, "int64"), "d": (5, "double"), "b": (5, "bool"), "t": (5, "date"), "s": (3, "string")}
    j = ["true", "1", "1.5", '"x"', "[1, 2]", "[]", "{}", "null", None, '["a"]']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in j], "c string").select(Q.json_type(F.col("c"))).collect()]
    assert got == ["bool", "int64", "double", "string", "array<int64>", "array<string>", "object", "null", "null", "array<string>"]


def test_writes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 3, "z")], "k string, v int, w string")
    assert sorted(map(tuple, K.upsert(old, new, "k").collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]
    assert sorted(map(tuple, K.insert_ignore(spark.createDataFrame([("a", 5, ""), (None, 1, ""), (None, 2, "")], "k string, v int, w string"), old, ["k"], "v").collect())) == [(None, 1, "")]
    p = spark.createDataFrame([("i1", "p", ["a", "b", "a"], ["c"], None), ("i1", "p", ["a"], ["c"], None), ("i2", "p", ["q"], [], None), ("i3", "p", ["x"], ["y"], None)], "ingestion_id string, process_urn string, inputs array<string>, outputs array<string>, valid_from timestamp")
    urns, edges, audit = K.ingest(p, spark.createDataFrame([("i3",)], "ingestion_id string"))
    assert {(r.source_urn, r.target_urn) for r in edges.collect()} <= {("a", "c"), ("b", "c")} and audit.count() == 2
    urns2, edges2, _ = K.ingest(p, p)
    assert edges2.count() == 0 and urns2.count() == 0
    closed = K.close_edges(edges.withColumn("valid_to", F.lit(None).cast("date")), edges, F.lit(datetime(2025, 1, 1)).cast("date"))
    assert closed.where("valid_to is null").count() == 0


def test_deletes_cascade(spark):
    a = spark.createDataFrame([("A", "x"), ("b", "y"), ("c", None)], "id string, connector_id string")
    d = spark.createDataFrame([(1, "a "), (2, "B"), (3, None)], "id int, asset_id string")
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a")], "id int, source_asset_id string, target_asset_id string")
    x, y, z = K.delete_connection(a, d, e, "x")
    assert sorted(r.id for r in x.collect()) == ["b", "c"] and sorted(r.id for r in y.collect()) == [2, 3] and [r.id for r in z.collect()] == [2]


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x", y'), ("2", None), ("3", "línea")], "a string, b string")
    K.export_csv(df, str(tmp_path / "csv"))
    df.write.orc(str(tmp_path / "orc"))
    df.write.parquet(str(tmp_path / "pq"))
    df.write.json(str(tmp_path / "js"))
    df.write.format("xml").option("rowTag", "row").save(str(tmp_path / "xml"))
    want = sorted(map(str, map(tuple, df.collect())))
    for form, name in (("csv", "csv"), ("orc", "orc"), ("parquet", "pq"), ("delta", "pq"), ("xml", "xml")):
        assert sorted(map(str, map(tuple, files.read(spark, str(tmp_path / name), form).select("a", "b").collect()))) == want, form
    assert files.read(spark, str(tmp_path / "js"), "json").count() >= 1
    with pytest.raises(ValueError):
        files.read(spark, "x", "nope")
    p = files.parquet_profile(spark, str(tmp_path / "pq")).where("column = 'a'").agg(F.sum("num_rows")).first()[0]
    assert p == 3
    assert files.schema_rows(df) == [("a", "string", True), ("b", "string", True)]
    names = {r.format for r in files.listing(spark, str(tmp_path), (".ORC", ".parquet")).collect()}
    assert names == {"orc", "parquet"}
    tail = files.byte_range(spark, str(tmp_path / "pq"), -4, 10).collect()
    assert {bytes(r.bytes) for r in tail if r.path.endswith(".parquet")} == {b"PAR1"}


def test_text_profiles(spark):
    rows = [("c", "csv", "a,,b\n1,2,3\n\nshort\n4,5,6\n"), ("j", "json", '[{"x": 1, "y": null}, {"x": 2}]'), ("s", "json", "[1, 2]"), ("x", "xml", "<r><a>1</a><b><c/></b><a>2</a></r>"), ("bad", "json", "{"), ("none", "csv", None), ("other", "zip", "x")]
    got = {}
    for r in files.text_profile(spark.createDataFrame(rows, "path string, format string, text string")).collect():
        got.setdefault(r.path, []).append((r.column, r.samples))
    assert got["c"] == [("a", ["1", "4"]), ("column_2", ["2", "5"]), ("b", ["3", "6"])]
    assert got["j"] == [("x", ["1", "2"]), ("y", ["null"])] and got["s"] == [("value", ["1", "2"])]
    assert got["x"] == [("r", []), ("r.a", ["1", "2"]), ("r.b", []), ("r.b.c", [])] and set(got) == {"c", "j", "s", "x"}


def test_containers(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f").write_text("x")
    (tmp_path / "two.txt").write_text("x")
    ship(spark)
    spark.dataSource.register(containers.ContainerSource)
    got = spark.read.format("containers").load(f"file://{tmp_path}").collect()
    assert sorted((r.name, r.kind, r.n_entries) for r in got) == [("one", "container", 1), ("two.txt", "file", 0)]


def test_dictionary(spark):
    c = spark.createDataFrame([("O", "T", "B", "NUMBER", None, 12.0, 2.0, "Y", 2), ("O", "T", "A", "VARCHAR2", None, None, None, "N", 1)], "owner string, table_name string, column_name string, data_type string, data_length int, data_precision double, data_scale double, nullable string, column_id int")
    assert json.loads(dictionary.column_documents(c).first().columns) == [{"name": "A", "type": "VARCHAR2", "nullable": False}, {"name": "B", "type": "NUMBER(12,2)", "nullable": True}]
    assert dictionary.create_table("c.s.t", [("a b", "NUMBER(12,2)"), ("x", "timestamp[us]"), ("y", "geo")]) == 'CREATE TABLE IF NOT EXISTS c.s.t ("a b" DECIMAL(12,2), "x" TIMESTAMP, "y" VARCHAR)'
    o = spark.createDataFrame([("O", "P", "PACKAGE"), ("O", "P", "PACKAGE BODY"), ("O", "F", "FUNCTION")], "owner string, object_name string, object_type string")
    assert dictionary.packages(o).count() == 1
    s = dictionary.schemas(spark.createDataFrame([("sys", "t"), ("hr", "t"), ("HR", "u"), ("x", "t")], "owner string, table_name string"), ("hr",))
    assert [r.owner for r in s.collect()] == ["HR"]


def test_stream_keeps_latest_over_batches(spark, tmp_path):
    schema = "k string, t int, v string"
    src = tmp_path / "in"
    for i, rows in enumerate(([("a", 1, "x"), ("b", 5, "y")], [("a", 2, "z"), ("b", 4, "late"), ("a", 2, "a"), (None, 1, "n")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(schema).parquet(str(src))
        got = feeds.keep_latest(s, "k", ["t", "v"], str(tmp_path / "out"), str(tmp_path / "state"), 4).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 2, "z"), ("b", 5, "y"), (None, 1, "n")]


def test_stream_of_more_files_than_a_batch(spark, tmp_path):
    """150 files come in batches of 50; the table is that of all of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    src = tmp_path / "in.parquet"
    src.mkdir()
    for i in range(150):
        pq.write_table(pa.table({"k": [f"k{i % 7}", f"only{i}"], "t": pa.array([i, 0], pa.int32()), "v": [f"v{i}", "x"]}), src / f"{i:03}.parquet")
    s = feeds.files(spark, str(tmp_path), "in.parquet", at_once=50)
    got = {r.k: r.v for r in feeds.keep_latest(s, "k", ["t"], str(tmp_path / "out"), str(tmp_path / "state"), 3).collect()}
    assert len(got) == 157 and got["k0"] == "v147" and got["k6"] == "v146" and got["only149"] == "x"


def test_previous_rows_of_a_hot_group(spark):
    from metaloom.operators.sequence import previous

    rows = [("hot" if i % 3 else f"k{i % 4}", (i * 37) % 101, f"v{i}", None if i % 7 == 0 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t int, v string, x int")
    got = {(r.k, r.t): (None if r.prev is None else tuple(r.prev)) for r in previous(df, ["k"], ["t"], ["v", "x"]).collect()}
    want, last = {}, {}
    for k, t, v, x in sorted(rows, key=lambda r: r[:2]):
        want[k, t] = last.get(k)
        last[k] = (v, x)
    assert got == want
    assert previous(df.where("false"), ["k"], ["t"], ["v"]).count() == 0


def test_numbers_along_an_order(spark):
    from metaloom.operators.sequence import numbered

    df = spark.createDataFrame([(f"g{(i * 7) % 5}", i) for i in range(60)], "g string, i int")
    got = [(r.no, r.g, r.i) for r in numbered(df, ["g", "i"]).collect()]
    assert sorted(got) == [(n, *x) for n, x in enumerate(sorted((f"g{(i * 7) % 5}", i) for i in range(60)))]
    assert numbered(df.where("false"), ["g"]).count() == 0


def test_column_edits(spark):
    doc = json.dumps([{"name": "a", "pii_detected": True, "pii_types": ["X"], "masking_logic_analytical": "hash"}, {"name": "b", "pii_detected": False}])
    a = spark.createDataFrame([("1", doc), ("2", doc), ("3", None)], "id string, columns string")
    e = spark.createDataFrame([("1", "a", False, None, "x", "y"), ("1", "b", True, None, " ", "redact"), ("1", "b", True, None, " ", "redact"), ("9", "a", True, None, None, None), (None, "a", True, None, None, None)], "id string, name string, pii_detected boolean, pii_types array<string>, analytical string, operational string")
    got = {r.id: r.columns and json.loads(r.columns) for r in K.edit_columns(a, e).collect()}
    assert got["1"] == [{"name": "a", "pii_detected": False}, {"name": "b", "pii_detected": True, "pii_types": ["PII"], "masking_logic_operational": "redact"}]
    assert got["2"][0]["masking_logic_analytical"] == "hash" and got["3"] is None


def test_dictionary_scan_over_jdbc(spark):
    """The scan's query runs in the database: here the embedded one that comes with Spark."""
    url, driver = "jdbc:derby:memory:dictionary;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded database here")
    t = spark.createDataFrame([("HR", "EMP", 3, None), ("SYS", "OBJ$", 1, None), ("HR", "DEPT", None, None)], "OWNER string, TABLE_NAME string, NUM_ROWS int, LAST_ANALYZED timestamp")
    t.write.format("jdbc").options(url=url, dbtable="ALL_TABLES", driver=driver, createTableColumnTypes="OWNER VARCHAR(128), TABLE_NAME VARCHAR(128)").mode("overwrite").save()
    got = dictionary.scan(spark, url, "tables", driver=driver)
    assert sorted((r.OWNER, r.TABLE_NAME) for r in got.collect()) == [("HR", "DEPT"), ("HR", "EMP")]
    assert [r.owner for r in dictionary.schemas(got).collect()] == ["HR"]


def test_table_folder_with_a_log(spark, tmp_path):
    from metaloom.sources import files

    for i in range(3):
        spark.createDataFrame([(i,)], "x int").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        part.rename(tmp_path / f"f{i}.parquet")
    log = tmp_path / "_delta_log"
    log.mkdir()
    (log / ("0" * 20 + ".json")).write_text('{"add": {"path": "f0.parquet"}}\n{"metaData": {"id": "m"}}\n{"add": {"path": "f1.parquet"}}\n')
    (log / ("0" * 19 + "1.json")).write_text('{"remove": {"path": "f0.parquet"}}\n{"add": {"path": "f2.parquet"}}\n')
    assert sorted(r.file for r in files.delta_files(spark, str(tmp_path)).collect()) == ["f1.parquet", "f2.parquet"]
    assert sorted(r.x for r in files.read(spark, str(tmp_path), "delta").collect()) == [1, 2]
