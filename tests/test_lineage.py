import difflib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metaloom.functions.sqlparse import statements
from metaloom.operators import graph as G
from metaloom.operators import inference as N
from metaloom.operators import sqltext as X

LINKS = "id bigint, source_asset_id string, target_asset_id string, relationship_type string, discovered_at timestamp, edge_id string, depth int"


def lineage(spark, pairs):
    return spark.createDataFrame([(i, s, t, "x", datetime(2025, 1, 1 + i % 20), "clash", 1) for i, (s, t) in enumerate(pairs)], LINKS)


def test_traversal_on_a_ring(spark):
    e = G.edges(lineage(spark, [("a", "b"), ("B ", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "b"), (None, "z"), ("", "z")]))
    starts = spark.createDataFrame([("A",), ("a ",), (None,), ("zz",)], "id string")
    nodes, edges = G.traverse(e, starts, 2)
    assert sorted((r.start, r.node, r.depth) for r in nodes.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("zz", "zz", 0)]
    assert sorted((r.edge_id, r.depth) for r in edges.collect()) == [(0, 1), (1, 2), (5, 1)]
    nodes, edges = G.traverse(e, starts, None)
    assert {(r.node, r.depth) for r in nodes.collect() if r.start == "a"} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}
    assert len(edges.collect()) == 6
    up, _ = G.traverse(e, spark.createDataFrame([("e",)], "id string"), None, upstream=True)
    assert {r.node: r.depth for r in up.collect()} == {"e": 0, "d": 1, "c": 2, "b": 3, "a": 4}


def test_layout(spark):
    e = G.edges(lineage(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("s", "s"), ("p", "q"), ("q", "p")]))
    got = {r.id: (r.level, r.x, r.y) for r in G.layout(e).collect()}
    assert got["r"][:2] == (0, 0) and got["a"] == (1, 300, 0) and got["b"] == (1, 300, 120) and got["c"][:2] == (2, 600)
    assert got["p"][0] == got["q"][0] == 0
    ring = G.layout(G.edges(lineage(spark, [("p", "q"), ("q", "p")]))).collect()
    assert {r.level for r in ring} == {0}


def test_validity(spark):
    df = spark.createDataFrame([(1, datetime(2025, 1, 1), None), (2, datetime(2025, 3, 1), None), (3, datetime(2025, 1, 1), datetime(2025, 2, 1)), (4, None, None)], "id int, valid_from timestamp, valid_to timestamp")
    assert sorted(r.id for r in G.valid(df, datetime(2025, 2, 15)).collect()) == [1, 4]


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    x, y = a.strip().lower(), b.strip().lower()
    r = difflib.SequenceMatcher(None, x, y).ratio()
    u, v = (n.translate({ord(c): None for c in "_- "}) for n in (x, y))

    def bare(n):
        for p in "tbl_ dim_ fact_ stg_ raw_ src_".split():
            n = n.removeprefix(p)
        for p in "_id _key _pk _fk".split():
            n = n.removesuffix(p)
        return n

    held = 0.85 if u in v or v in u else 0.0
    return 1.0 if x == y else 0.95 if u == v else max(r, held, 0.9 if bare(x) == bare(y) else 0.0)


NAMES = ["Email", "email ", "user_id", "userid", "cust_key", "cust_id", "dim_name", "name", "first_name", "amount_due", "amt_due", "tbl_dim_x_fk_id", "x", "_id", "", None, "abc", "xyz", "total_amount", "amount", "amounts", "A-B", "a_b", "Created At", "created_on", "stg_raw_q"]


def test_similarity_of_names(spark):
    pairs = [(a, b) for a in NAMES for b in NAMES]
    got = {(r.a, r.b): (r.similarity, r.kind) for r in N.scored_pairs(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert {p: pytest.approx(plain_similarity(*p)) for p in pairs} == {p: got[p][0] for p in pairs}
    assert got["amount", "total_amount"][1] == "aggregate" and got["amount", "amounts"][1] == "rename" and got["abc", "abc"][1] == "pass_through"
    found = {(r.a, r.b) for r in N.similar_names(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = {p for p in pairs if p[0] and p[1] and plain_similarity(*p) >= 0.6}
    assert found <= want and len(found) >= 0.9 * len(want)


def plain_match(s, t, least_ratio):
    free, total, n = set(t), 0.0, 0
    for a in s:
        best = max(((plain_similarity(a, b), -k, b) for k, b in enumerate(t) if b in free), default=(0,))
        if best[0] >= 0.6:
            free.discard(best[2])
            total, n = total + best[0], n + 1
    if not n:
        return 0, 0.0
    share = n / max(len(s), len(t))
    c = 0.6 * share + 0.4 * total / n
    return n, min(0.95, c + 0.1) if share >= least_ratio else c


def test_search_of_similar_columns_against_all_pairs(spark):
    rng = random.Random(2)
    words = [n for n in NAMES if n]
    cols = {f"k{i}": [rng.choice(words) for _ in range(rng.randint(0, 6))] for i in range(60)}
    where = {k: rng.choice(["azure_x", "azure_y", "oracle_z", None]) for k in cols}
    doc = lambda c: json.dumps([{"name": n, "type": "t"} for n in c]) if c else None
    a = assets(spark, [(k, f"n{k}", where[k], "c", "table", None, doc(c)) for k, c in cols.items()])
    q = [k for k in cols if int(k[1:]) % 5 == 0]
    for across, least, cap in ((False, 0.65, 0.85), (True, 0.7, 0.9)):
        scope = {k: ((w or "unknown").split("_")[0] if across else w or "unknown") for k, w in where.items()}
        want = {}
        for s in q:
            for t in cols:
                n, c = plain_match(cols[s], cols[t], 0.4)
                if s != t and (scope[s] == scope[t]) != across and n and c >= least:
                    want[s, t] = (n, pytest.approx(min(c, cap), abs=1e-5))
        got = {(r.source, r.target): (r.n_matches, r.confidence) for r in N.search_columns(a.where(F.col("id").isin(q)), a, across, least, 0.4, cap).collect()}
        assert len(want) > 20 and len(set(got) & set(want)) >= 0.9 * len(want)
        assert sum(got[p] == want.get(p) for p in got) >= 0.95 * len(got)
    pairs = spark.createDataFrame([(s, t) for s in q for t in cols], "source string, target string")
    got = {(r.source, r.target): (r.n_matches, r.confidence) for r in N.matched_assets(pairs, a).collect()}
    want = {(s, t): (n, pytest.approx(min(c, 0.85), abs=1e-5)) for s in q for t in cols for n, c in [plain_match(cols[s], cols[t], 0.4)] if s != t and n and c >= 0.65}
    assert got == want
    assert N.search_columns(a.where("false"), a).count() == 0 and N.search_columns(a, a.where("false")).count() == 0


def test_search_by_names(spark):
    doc = '[{"name": "a_id", "type": "t"}, {"name": "b", "type": "t"}]'
    a = assets(spark, [
        ("t1", "HR.SALES_2024", "oracle_p", "s", "table", None, doc), ("f1", "exports/sales-2024.csv", "azure_q", "s", "csv", None, None), ("f2", "in/sales_2025_load.csv", "azure_q", "s", "csv", None, doc),
        ("f3", "unrelated.csv", "azure_q", "s", "csv", None, doc), ("f4", "sales_2024_all.csv", "aws_r", "s", "csv", None, None), (None, "sales_2024.csv", "aws_r", "s", "csv", None, None), ("f5", None, "aws_r", "s", "csv", None, None),
    ]).withColumn("operational_metadata", F.lit(None).cast("string"))
    got = {r.file_id: (r.direction, r.confidence) for r in N.search_files(a.where("id = 't1'"), a.where("connector_id not like 'oracle%' or connector_id is null")).collect()}
    assert got["f1"] == ("table_to_file", 0.9) and got["f4"] == ("table_to_file", 0.75) and got["f2"] == ("file_to_table", 0.9) and set(got) == {"f1", "f2", "f4"}
    n = {(r.source, r.target): r.confidence for r in N.search_names(a, a).collect()}
    assert n == {} and N.search_names(a.withColumn("connector_id", F.lit("k")), a.withColumn("connector_id", F.lit("k")), 0.6).count() == 2
    s = N.schema_links(spark.createDataFrame([("s", "s"), ("s", "none"), ("s", "s")], "source_schema string, target_schema string"), a).collect()
    assert [(r.n_sources, r.n_targets, r.n_links) for r in s] == [(7, 7, 49)]


def assets(spark, rows):
    return spark.createDataFrame([(i, n, c, cat, ty, t, cols, "clash") for i, n, c, cat, ty, t, cols in rows], "id string, name string, connector_id string, catalog string, type string, technical_metadata string, columns string, depth string")


def test_folders_and_names(spark):
    loc = lambda p: '{"location": "' + p + '", "container": "c"}'
    a = assets(spark, [
        ("1", "s_raw.csv", "azure_x", "k", "csv", loc("a/s_raw.csv"), None), ("2", "s_processed.csv", "azure_x", "k", "csv", loc("a/b/s.csv"), None), ("3", "t", "oracle_y", "k", "table", loc("/a/b/t"), None),
        ("4", "T.parquet", "azure_x", "k", "parquet", loc("root.csv"), None), ("5", None, None, None, "view", None, None), ("6", "s_stg.csv", "azure_x", "k", "csv", loc("a/d/q/s"), None), ("7", "v", "oracle_y", "k", "view", "{", ""),
    ])
    f = {(r.parent_folder, r.child_folder): (r.n_parents, r.n_children) for r in N.folder_edges(a).collect()}
    assert f == {("", "a"): (1, 1), ("a", "a/b"): (1, 1)}
    n = {r.id: (r.n_same, r.n_parent, r.n_child, r.n_sibling) for r in N.folder_neighbours(a).collect()}
    assert n["1"] == (0, 1, 2, 0) and n["4"] == (0, 0, 3, 0) and n["2"] == (0, 1, 0, 0) and n["3"] == (0, 0, 0, 0)
    g = {r.id: (r.base, r.role, r.n_links) for r in N.naming_groups(a).collect()}
    assert g == {"1": ("s", "source", 1), "6": ("s", "source", 1)} or set(g) == {"1", "6"}
    x = {r.id: (r.class_id, r.n_links) for r in N.same_name_across(a).collect()}
    assert x == {"3": ("3", 1), "4": ("3", 1)}
    assert [tuple(r)[:3] for r in N.table_and_file(a).collect()] == [("3", 1, "4")]
    assert [(r.n_tables, r.n_views, r.n_links) for r in N.schema_edges(a).collect()] == [(1, 1, 1)]
    assert N.folder_edges(a.where("false")).count() == 0


def test_shared_columns_of_assets_without_an_edge(spark):
    doc = lambda *c: "[" + ",".join(f'{{"name": "{n}", "type": "{t}"}}' for n, t in c) + "]"
    x, y, z = ("X", "int"), ("y", "INT"), ("z", "date")
    cols = {"a": doc(x, y), "b": doc(y, x), "c": doc(x, y, z), "d": doc(z), "e": doc(("x", "text"), y, z), "f": None}
    df = assets(spark, [(i, i, "k", None, "table", None, c) for i, c in cols.items()])
    assert {r.key: r.class_id for r in N.column_classes(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert sorted(map(tuple, N.shared_classes(df).collect())) == [("a", "a", 2, 0.7), ("a", "c", 2, 0.7), ("c", "e", 2, 0.7)]


BANK = {
    "CREATE VIEW customer_account_summary AS SELECT c.customer_id, c.first_name || ' ' || c.last_name AS customer_name, COUNT(a.account_id) AS total_accounts, SUM(a.balance) AS total FROM customers c LEFT JOIN accounts a ON c.customer_id = a.customer_id GROUP BY c.customer_id": ("CREATE_VIEW", "customer_account_summary", ["customers", "accounts"]),
    "CREATE OR REPLACE VIEW transaction_summary AS SELECT a.account_id, SUM(CASE WHEN t.amount > 0 THEN t.amount ELSE 0 END) AS deposits FROM accounts a, transactions t WHERE a.account_id = t.account_id": ("CREATE_VIEW", "transaction_summary", ["accounts", "transactions"]),
    "INSERT INTO dw.loans (id, rate) SELECT l.loan_id, ROUND(l.interest_rate * 100, 2) FROM loans l JOIN customers USING (customer_id)": ("INSERT", "dw.loans", ["loans", "customers"]),
    "WITH q AS (SELECT * FROM base), r AS (SELECT * FROM q) SELECT * FROM r JOIN \"Odd Name\" o ON 1 = 1": ("SELECT", None, ["base", "Odd Name"]),
    "MERGE INTO t USING s ON t.i = s.i WHEN MATCHED THEN UPDATE SET v = s.v": ("MERGE", "t", ["s"]),
    "UPDATE accounts SET balance = balance + 1 WHERE id IN (SELECT id FROM x)": ("UPDATE", "accounts", ["x"]),
    "DELETE FROM a.b.c WHERE 1 = 1": ("DELETE", "a.b.c", []),
    "CREATE TABLE n AS SELECT 1 AS one -- FROM comment\n /* JOIN none */": ("CTAS", "n", []),
}


@pytest.mark.parametrize("sql", BANK)
def test_statements(sql):
    (s,) = statements(sql)
    assert (s.kind, s.target, s.sources) == BANK[sql]


def test_columns_of_statements():
    (s,) = statements(list(BANK)[0])
    assert s.columns == [("customer_id", "customers", "customer_id", "column", 0.95), ("customer_name", "customers", "first_name", "arithmetic", 0.7), ("total_accounts", "accounts", "account_id", "aggregate", 0.85), ("total", "accounts", "balance", "aggregate", 0.85)]
    (s,) = statements(list(BANK)[2])
    assert [c[:3] for c in s.columns] == [("id", "loans", "loan_id"), ("rate", "loans", "interest_rate")]
    assert s.complexity == pytest.approx(0.2)
    (s,) = statements(list(BANK)[4])
    assert s.columns == [("v", "s", "v", "column", 0.95)]
    assert statements(None) == [] and statements("") == [] and statements("hello; 'world") == [] and len(statements("select 1; select 2;;")) == 2


def test_texts(spark):
    rows = [(1, "create view v as select x.a from s.x join y on x.id = y.id"), (2, None), (3, ""), (4, "nothing"), (5, "select a from b " * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id int, text string, target string")
    got = {(r.doc_id, r.statement_no): r for r in X.parsed_statements(df, "doc_id", "text").collect()}
    assert got[1, 0].sources == ["s.x", "y"] and {k for k, _ in got} == {1, 5}
    p = {r.doc_id: r.x for r in df.select("doc_id", X.by_pattern(F.col("text")).alias("x")).collect()}
    assert p[1].query_type == "CREATE" and p[1].target == "V" and p[1].sources == ["S.X", "Y"] and p[4].confidence == 0.3
    j = X.join_keys(df, "doc_id", "text").collect()
    assert [tuple(r)[1:5] for r in j] == [("x", "id", "y", "id")]


def test_procedures(spark):
    code = "BEGIN\n -- SELECT * FROM gone;\n UPDATE accounts SET balance = 1 WHERE id = p;\n SELECT balance INTO v_b FROM ledger WHERE x = 1;\n v_sql := 'INSERT INTO audit_log SELECT * FROM moves';\n EXECUTE IMMEDIATE v_sql;\n pay.run_all(1);\nEND;"
    assert X.dynamic_sql(code, "plsql") == ["INSERT INTO audit_log SELECT * FROM moves"]
    assert X.dynamic_sql("EXECUTE IMMEDIATE 'DELETE FROM t' || x;") == ["DELETE FROM t..."] and X.dynamic_sql(None) == []
    assert X.dynamic_sql("@q = 'SELECT 1 FROM u' EXEC sp_executesql @q", "tsql") == ["SELECT 1 FROM u"]
    r = X.procedure_lineage(spark.createDataFrame([(1, code), (2, None)], "id int, code string"), "id", "code").orderBy("id").collect()
    assert sorted(r[0].targets) == ["accounts", "audit_log"] and sorted(r[0].sources) == ["ledger", "moves"] and r[0].confidence == 0.7 and "pay.run_all" in r[0].calls
    assert r[1].confidence == 0.3 and r[1].sources == []


def test_names_that_contain_a_token(spark):
    n = spark.createDataFrame([("1", "Orders_2024"), ("2", "orders"), ("3", "my orders orders"), ("4", None), (None, "orders"), ("5", "")], "id string, name string")
    t = spark.createDataFrame([("ORDERS",), ("2024",), ("x",), ("",), (None,)], "token string")
    got = sorted(map(tuple, X.containing(t, n).collect()))
    assert got == [("2024", "1", False), ("orders", "1", False), ("orders", "2", True), ("orders", "3", False)]
    assert sorted(map(tuple, X.first_containing(t, n).collect())) == [("2024", "1"), ("orders", "2")]
    assert X.containing(t.where("false"), n).count() == 0


def test_triggers_and_sql_of_assets(spark):
    code = "BEGIN INSERT INTO audit_log SELECT * FROM hr.old_emp; END;"
    t = spark.createDataFrame([("HR", "TRG", "EMP", code), ("HR", "TRG", "EMP", code), ("HR", None, "EMP", code), ("HR", "T2", "EMP", None)], "owner string, trigger_name string, table_name string, trigger_body string")
    got = sorted(map(tuple, X.trigger_edges(t).collect()))
    assert got == [("hr.emp", "hr.t2", "on", 0.9), ("hr.emp", "hr.trg", "on", 0.9), ("hr.old_emp", "hr.trg", "reads", 0.85)]
    a = spark.createDataFrame([("A ", json.dumps({"sql_query": "select 1", "ddl": " ", "view_definition": None})), ("b", "{"), (None, '{"ddl": "x"}')], "id string, technical_metadata string")
    d = spark.createDataFrame([(1, "a", '{"view_sql_commands": {"analytical_sql": "old"}}'), (2, " A", json.dumps(json.dumps({"view_sql_commands": {"operational_sql": "create view"}})))], "id int, asset_id string, schema_json string")
    assert sorted(map(tuple, X.asset_sql(a, d).collect())) == [("a", "operational_sql", "create view"), ("a", "sql_query", "select 1")]
