import json
import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_lineage import NAMES, plain_match

from metaloom.operators import blocks as B
from metaloom.operators import inference as N


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    sets = {f"{'Ké' if i % 3 else 'k'}{i}": rng.sample(range(40), rng.randint(1, 9)) for i in range(90)}
    want = {(a, b): len({*sets[a]} & {*sets[b]}) for a, b in combinations(sorted(sets, key=str.encode), 2)}
    df = spark.createDataFrame(list(sets.items()), "key string, items array<bigint>")
    for rows in (7, 1000):
        got = {(r.a, r.b): r.n for r in B.overlaps(df, 2, rows).collect()}
        assert got == {p: n for p, n in want.items() if n >= 2} and len(got) > 100
    assert B.overlaps(df.where("false"), 2).count() == 0


def shuffled(node) -> int:
    """Records that the exchanges of a plan that has run wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_sets_are_not_copied_for_every_block(spark):
    sets = {f"k{i:03d}": [i % 5, 10 + i % 7, 20 + i % 3, 30 + i % 2] for i in range(200)}
    df = spark.createDataFrame(list(sets.items()), "key string, items array<bigint>")
    links = B.overlaps(df, 3, 10)
    want = {(a, b, n) for a, b in combinations(sets, 2) if (n := len({*sets[a]} & {*sets[b]})) >= 3}
    assert {(r.a, r.b, r.n) for r in links.collect()} == want and len(want) > 500
    assert shuffled(links._jdf.queryExecution().executedPlan()) <= 2 * len(sets)  # 20 blocks


def test_texts_of_columns_that_run_together_differ(spark):
    cols = {"p": [("ab", "c"), ("x", "t")], "q": [("a", "bc"), ("x", "t")], "r": [("1", ":t"), ("AB", "C"), ("X", "T")]}
    a = spark.createDataFrame([(k, json.dumps([{"name": n, "type": t} for n, t in c])) for k, c in cols.items()], "id string, columns string")
    assert [tuple(r) for r in N.shared_classes(a).collect()] == [("p", "r", 2, 0.7)]


def test_links_of_classes_are_not_shuffled(spark):
    a = spark.range(40).select(F.concat(F.lit("k"), "id").alias("id"), F.format_string('[{"name": "x", "type": "t"}, {"name": "Y", "type": "t"}, {"name": "c%d", "type": "t"}]', F.col("id")).alias("columns"))
    links = N.shared_classes(a)
    assert links.count() == 40 * 39 // 2 and {(r.n_shared, r.confidence) for r in links.collect()} == {(2, 0.7)}
    assert "hashpartitioning(class_a" not in links._jdf.queryExecution().executedPlan().toString()


def test_similar_texts_against_all_pairs():
    rng = random.Random(7)
    words = ["".join(rng.choice("aábc_-0") for _ in range(rng.choice((0, 1, 2, 5, 9, 12, 70, 210)))) for _ in range(150)] + ["axbxc", "aybyc", "", "_"]
    names = [(w, w.replace("_", "").replace("-", ""), w.removesuffix("_0")) for w in words]
    for least in (0.6, 0.7):
        i, j, s = B.similar(names, names[::-1], least, 0.95, 0.9, 0.85)
        got = dict(zip(zip(i.tolist(), j.tolist()), s.tolist()))
        want = {}
        for p, (a, u, x) in enumerate(names):
            for q, (b, v, y) in enumerate(names[::-1]):
                r = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
                z = 1.0 if a == b else 0.95 if u == v else max(r, 0.9) if x == y else max(r, 0.85) if u in v or v in u else r
                if z >= least:
                    want[p, q] = z
        assert got == want


def test_names_without_a_common_pair_of_letters(spark):
    a, b = spark.createDataFrame([("AxBxC",), ("AxBxC",), (None,), ("",)], "a string"), spark.createDataFrame([("aybyc",), ("qqq",)], "b string")
    assert [(r.a, r.b, r.similarity) for r in N.similar_names(a, b).collect()] == [("AxBxC", "aybyc", 0.6)]


def test_files_of_tables_in_any_blocks(spark, monkeypatch):
    doc = lambda *c: json.dumps([{"name": n, "type": "t"} for n in c])
    rows = [("t1", "S.LOAN_0000100", "o", doc("x_id", "name")), ("t1 ", "LOAN_0000100", "o", None), ("t2", "LOAN_0000250", "o", None), ("t3", None, "o", doc("q"))]
    rows += [(f"f{i}", f"a/loan-{i * 37:07d}.csv", "a", doc("name", "x_key") if i % 2 else doc("zzz") if i % 4 else None) for i in range(60)]
    a = spark.createDataFrame(rows, "id string, name string, connector_id string, columns string").withColumn("operational_metadata", F.lit(None).cast("string"))
    search = lambda: sorted(map(tuple, N.search_files(a.where("connector_id = 'o'"), a.where("connector_id = 'a'")).collect()))
    want = search()
    assert len(want) > 20 and {r[3] for r in want if r[0] == "t1" and int(r[1][1:]) % 2} == {0.9} and {r[0] for r in want} == {"t1", "t2"}
    monkeypatch.setattr(B, "FEW", 9)
    assert search() == want


def test_search_finds_all_pairs_without_shuffling_them(spark, monkeypatch):
    rng = random.Random(3)
    words = [n for n in NAMES if n]
    cols = {f"k{i}": [rng.choice(words) for _ in range(rng.randint(0, 6))] for i in range(50)}
    where = {k: rng.choice(["azure_x", "azure_y", "oracle_z", None]) for k in cols}
    a = spark.createDataFrame([(k, where[k], json.dumps([{"name": n, "type": "t"} for n in c])) for k, c in cols.items()], "id string, connector_id string, columns string")
    q = [k for k in cols if int(k[1:]) % 5 == 0]
    monkeypatch.setattr(B, "FEW", 4)
    monkeypatch.setattr(B, "PIECE", 3)
    for across, least, cap in ((False, 0.65, 0.85), (True, 0.7, 0.9)):
        scope = {k: ((w or "unknown").split("_")[0] if across else w or "unknown") for k, w in where.items()}
        want = {}
        for s in q:
            for t in cols:
                n, c = plain_match(cols[s], cols[t], 0.4)
                if s != t and (scope[s] == scope[t]) != across and n and c >= least:
                    want[s, t] = (n, pytest.approx(min(c, cap), abs=1e-5))
        links = N.search_columns(a.where(F.col("id").isin(q)), a, across, least, 0.4, cap)
        assert {(r.source, r.target): (r.n_matches, r.confidence) for r in links.collect()} == want and len(want) > 10
        assert "hashpartitioning(source" not in links._jdf.queryExecution().executedPlan().toString()
