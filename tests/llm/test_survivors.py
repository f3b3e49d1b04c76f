import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from metaloom.llm import survivors as S

SCHEMA = "id bigint, asset_id string, discovered_at timestamp, file_metadata string, record string, field_name string"


def usable(doc, at):
    """Plain Python reading of one document."""
    for _ in range(3):
        if isinstance(doc, str):
            try:
                doc = json.loads(doc)
            except ValueError:
                return {}
    if not isinstance(doc, dict):
        return {}

    def part(k):
        v = doc.get(k)
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return {}
        return v if isinstance(v, dict) else {}

    def text(v):
        v = None if v is None else str(v).strip()
        return v if v and v.lower() not in S.NOT_KNOWN else None

    def size(v):
        try:
            return str(int(float(v))) if text(v) and float(v) > 0 else None
        except ValueError:
            return None

    def digest(v):
        v = text(v)
        return v.lower() if v and v.lower() not in S.EMPTY_HASHES and len(set(v.lower())) > 1 else None

    def when(v):
        v = text(v)
        try:
            t = datetime.fromisoformat(v.replace("Z", "+00:00"))
        except (AttributeError, ValueError):
            return None
        t = (t - t.utcoffset()).replace(tzinfo=None) if t.tzinfo else t
        return v if t >= datetime(2000, 1, 1) and (at is None or t <= at) else None

    b, h, t = part("basic"), part("hash"), part("timestamps")
    out = {
        "name": text(b.get("name")) or text(doc.get("file_name")), "size_bytes": size(b.get("size_bytes")) or size(doc.get("size")), "format": text(b.get("format")) or text(doc.get("format")),
        "hash": digest(h.get("value")) or digest(doc.get("file_hash")), "last_modified": when(t.get("last_modified")) or when(doc.get("last_modified")),
    }
    return {k: v for k, v in out.items() if v is not None}


def later(moves, f, v):
    """All values that the learned order puts after v."""
    seen, todo = set(), [v]
    while todo:
        x = todo.pop()
        for g, a, w in moves:
            if g == f and a == x and moves[f, x, w] > moves[f, w, x] and w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def brute(rows):
    groups = defaultdict(list)
    for i, a, at, doc in rows:
        if a and a.strip():
            groups[a.strip().lower()].append((i, at, usable(doc, at)))
    moves = Counter()
    for g in groups.values():
        for f in S.FIELDS:
            chain = [u[f] for i, at, u in sorted((r for r in g if r[1]), key=lambda r: (r[1], r[0])) if f in u]
            moves.update((f, x, y) for x, y in zip(chain, chain[1:]) if x != y)
    out = {}
    for a, g in groups.items():
        if len(g) < 2:
            continue
        low = datetime.min
        out[a, "record"] = max((len(u), at or low, i) for i, at, u in g)[2]
        for f in S.FIELDS:
            timed = {}
            for at, i, v in sorted((at, i, u[f]) for i, at, u in g if at and f in u):
                timed[v] = (at, i)
            loose = {}
            for i, at, u in g:
                if at is None and f in u and u[f] not in timed:
                    loose[u[f]] = max(i, loose.get(u[f], i))
            last = max(timed, key=timed.get) if timed else None
            before = lambda v, w: w in later(moves, f, v) and v not in later(moves, f, w)
            behind = {v for v in loose if any(before(v, w) for w in timed)}
            top = [(not (v in behind or any(before(v, w) for w in loose if w != v)), False, i, v) for v, i in loose.items()]
            if timed:
                top.append((not any(before(last, w) for w in loose if w not in behind), True, timed[last][1], last))
            if top:
                out[a, f] = max(top)[2]
    return out


def doc(rng, k):
    b = {"name": rng.choice(["x.csv", " ", "N/A", None, f"f{k}"]), "size_bytes": rng.choice([1, 0, -3, "17", "x", 2.0, None, "1e3"]), "format": rng.choice(["csv", "parquet", "?", "json"])}
    h = {"value": rng.choice(["abc1", "00000000000000000000000000000000", "D41D8CD98F00B204E9800998ECF8427E", None])}
    t = {"last_modified": rng.choice(["2024-01-05", "2024-01-05T10:00:00Z", "1999-12-31", "2099-01-01", "2024-01-04 09:00:00", "2024-01-09T23:30:00+02:00", "soon", ""])}
    d = rng.choice([{"basic": b, "hash": h, "timestamps": t}, {"basic": json.dumps(b), "hash": h}, {"file_name": b["name"], "size": b["size_bytes"], "format": b["format"], "file_hash": h["value"], "last_modified": t["last_modified"]}, {"object_type": "table"}])
    return rng.choice([json.dumps(d), json.dumps(json.dumps(d)), json.dumps(d), None, '{"basic": {"name": "cut'])


def made(seed, untimed):
    rng = random.Random(seed)
    rows = []
    for i in range(1, 220):
        asset = "hot" if rng.random() < 0.35 else rng.choice(["A ", "a", "b", " C", "c", None, "  ", f"one{i}"])
        at = None if rng.random() < untimed else datetime(2024, 1, 1) + timedelta(days=rng.randrange(15))
        rows.append((i, asset, at, doc(rng, i % 3)))
    return rows


@pytest.mark.parametrize("seed, untimed", [(1, 0.0), (2, 0.0), (3, 0.3), (4, 0.7), (5, 1.0)])
def test_against_brute_force(spark, seed, untimed):
    rows = made(seed, untimed)
    got = S.survivors(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), values=False).collect()
    assert {(r.asset_id, r.field_name): r.discovery_id for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_learned_precedence_decides(spark):
    d = lambda f: json.dumps({"format": f})
    rows = [(i * 2 + k, f"g{i}", datetime(2024, 1, 1 + k), d(f)) for i in range(3) for k, f in enumerate(("csv", "parquet"))]
    rows += [(90, "new", None, d("parquet")), (91, "new", None, d("csv")), (92, "mixed", datetime(2024, 5, 1), d("csv")), (93, "mixed", None, d("parquet")), (94, "free", None, d("orc")), (95, "free", None, d("xml"))]
    got = S.survivors(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).where("field_name = 'format'").collect()
    best = {r.asset_id: r.discovery_id for r in got}
    assert best["new"] == 90 and best["mixed"] == 93 and best["free"] == 95
    p = S.precedence(S.transitions(S.observations(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)))).collect()
    assert [(r.earlier, r.later, r.n_for, r.n_against) for r in p] == [("csv", "parquet", 3, 0)]


def formats(spark, groups):
    """The surviving format of each group of (day or None, format)."""
    rows = [(i, g, d and datetime(2024, 1, d), json.dumps({"format": f}), "", "") for i, (g, d, f) in enumerate((g, d, f) for g, x in groups.items() for d, f in x)]
    got = S.survivors(spark.createDataFrame(rows, SCHEMA)).where("field_name = 'format'").collect()
    return {r.asset_id: r.value for r in got}


def test_own_order_stands_above_the_learned_one(spark):
    back = {f"e{i}": [(1, "parquet"), (2, "csv")] for i in range(3)}
    assert formats(spark, back | {"g": [(1, "csv"), (2, "parquet"), (None, "csv")]})["g"] == "parquet"


def test_order_is_closed_over_other_groups(spark):
    got = formats(spark, {"x": [(1, "a1"), (2, "b1")], "y": [(1, "b1"), (2, "c1")], "g": [(None, "c1"), (None, "a1")]})
    assert got["g"] == "c1"
    chain = {f"s{i}": [(1, f"v{i}"), (2, f"v{i + 1}")] for i in range(40)}
    assert formats(spark, chain | {"g": [(None, "v40"), (None, "v0")], "h": [(1, "v7"), (None, "v3")], "k": [(1, "v7"), (None, "v9")]}).items() >= {"g": "v40", "h": "v7", "k": "v9"}.items()


def test_cycles_of_majorities_decide_nothing(spark):
    ring = {"x": [(1, "aa"), (2, "bb")], "y": [(1, "bb"), (2, "cc")], "z": [(1, "cc"), (2, "aa")], "w": [(1, "cc"), (2, "dd")]}
    got = formats(spark, ring | {"g": [(None, "bb"), (None, "aa")], "h": [(None, "dd"), (None, "aa")], "t": [(1, "aa"), (None, "bb")]})
    assert got["g"] == "aa" and got["h"] == "dd" and got["t"] == "aa"


def test_moves_across_task_borders(spark):
    rows = [(i, "hot", datetime(2024, 1, 1) + timedelta(minutes=i), json.dumps({"format": f"f{i % 3}"} if i % 5 else {}), "", "") for i in range(300)]
    got = S.transitions(S.observations(spark.createDataFrame(rows, SCHEMA))).groupBy("was", "becomes").sum("n").collect()
    seq = [f"f{i % 3}" for i in range(300) if i % 5]
    assert {(r[0], r[1]): r[2] for r in got} == Counter((a, b) for a, b in zip(seq, seq[1:]) if a != b)


def test_fused_and_empty(spark):
    rows = made(6, 0.0)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    f = S.fused(df).collect()
    assert {r.asset_id for r in f} == {a for a, _ in brute(rows)}
    assert S.survivors(spark.createDataFrame([], SCHEMA)).count() == 0
