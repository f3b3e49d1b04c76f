import hashlib
import random

import pytest

from hypothesis import given
from hypothesis import strategies as st

from metaloom.operators.hierarchy import Md5, cycles, descendants, hierarchy, several_parents

SCHEMA = "p string, c string, path string, comp string"


def brute(links):
    parent, nodes = {}, set()
    for p, c in links:
        p, c = (x.strip().lower() if x and x.strip() else None for x in (p, c))
        if p and c:
            nodes |= {p, c}
            parent[c] = min(p, parent.get(c, p))
    out = {}
    below = {n: set() for n in nodes}
    for n in nodes:
        at, seen = n, []
        while at in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        for a in seen:
            if a != n:
                below[a].add(n)
        chain, x = [n], n
        while x in parent and parent[x] not in chain:
            x = parent[x]
            chain.append(x)
        if x not in parent:
            out[n] = ("tree", x, len(chain) - 1, hashlib.md5(">".join(reversed(chain)).encode()).hexdigest())
        else:
            ring = chain[chain.index(parent[x]) :]
            out[n] = ("cycle" if n in ring else "below_cycle", min(ring), 0 if n in ring else chain.index(ring[0]), "")
    return sorted((n, s, r, d, len(below[n]), m) for n, (s, r, d, m) in out.items())


def run(spark, links, **kw):
    df = spark.createDataFrame([(*x, "extra", "extra") for x in links], SCHEMA)
    return sorted(tuple(r)[:6] for r in hierarchy(df, "p", "c", **kw).collect())


CASES = {
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(30)],
    "star": [("hub", f"s{i}") for i in range(200)],
    "self": [("a", "a"), ("a", "b"), ("b", "c")],
    "ring": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("t", "u")],
    "dirt": [(" A", "b "), ("a", "B"), (None, "q"), ("", "r"), ("z", None), ("b", "c")],
    "long ring": [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("r5", "k0")] + [(f"k{i}", f"k{i + 1}") for i in range(9)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most", [250_000, 4])
def test_cases(spark, name, most):
    assert run(spark, CASES[name], piece=most) == brute(CASES[name])


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_rings(spark, seed):
    rng = random.Random(seed)
    links = [(f"v{rng.randrange(max(1, i))}" if rng.random() < 0.9 else f"v{rng.randrange(80)}", f"v{i}") for i in range(80) if rng.random() < 0.85]
    want = brute(links)
    assert run(spark, links) == want
    assert run(spark, links, piece=5) == want


@given(st.lists(st.binary(max_size=90), max_size=8))
def test_digest_goes_on_from_a_state(parts):
    h = Md5()
    for p in parts:
        h = Md5(h.plus(p).state())
    assert h.hex() == hashlib.md5(b"".join(parts)).hexdigest()


def test_deep_chain_and_caterpillar_in_pieces(spark):
    n = 3000
    links = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [(f"n{i}", f"leaf{i}") for i in range(0, n, 7)]
    df = spark.createDataFrame(links, "p string, c string")
    whole = {tuple(r)[:6] for r in hierarchy(df, "p", "c", with_path=False).collect()}
    cut = {tuple(r)[:6] for r in hierarchy(df, "p", "c", piece=700, with_path=False).collect()}
    assert whole == cut and len(whole) == n + 1 + len(range(0, n, 7))
    h, got = hashlib.md5(b"n0"), {r[0]: r for r in whole}
    for i in range(1, n + 1):
        h.update(b">n%d" % i)
        assert got[f"n{i}"][3] == i and got[f"n{i}"][5] == h.hexdigest()


def test_cycles_and_parents(spark):
    df = spark.createDataFrame([*CASES["ring"], ("x", "b"), ("q", "q")], "p string, c string")
    assert sorted(map(tuple, cycles(df, "p", "c").collect())) == [("a", 3, "c", "a"), ("q", 1, "q", "q")]
    assert sorted(map(tuple, several_parents(df, "p", "c").collect())) == [("b", "a", True), ("b", "x", False)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "p string, c string")
    assert sorted(map(tuple, descendants(df, "p", "c").collect())) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def brute_pairs(links):
    parent = {}
    for p, c in links:
        p, c = (x.strip().lower() if x and x.strip() else None for x in (p, c))
        if p and c:
            parent[c] = min(p, parent.get(c, p))
    out = []
    for n in parent:
        at, seen = parent[n], [n]
        while at not in seen:
            out.append((at, n, len(seen)))
            seen.append(at)
            if at not in parent:
                break
            at = parent[at]
    return sorted(out)


@pytest.mark.parametrize("name", ["self", "ring", "long ring"])
@pytest.mark.parametrize("most", [250_000, 4])
def test_descendants_in_cyclic_components(spark, name, most):
    df = spark.createDataFrame(CASES[name], "p string, c string")
    got = sorted(map(tuple, descendants(df, "p", "c", piece=most).collect()))
    assert got == brute_pairs(CASES[name])
    counts = {r.asset_id: r.n_descendants for r in hierarchy(df, "p", "c").collect()}
    assert {n: sum(a == n for a, *_ in got) for n in counts} == counts
