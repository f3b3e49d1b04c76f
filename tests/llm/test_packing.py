import os
import random
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metaloom.llm import packing as P
from metaloom.llm import tokens as T

needs_tokens = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary here")


def square(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_pack_is_a_partition_within_capacity(sizes, cap):
    start, bins = P.as_they_come(sizes, cap), P.pack(sizes, cap)
    for x in (start, bins):
        assert sorted(i for b in x for i in b) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in b) <= cap for b in x)
    assert -(-sum(sizes) // cap) <= len(bins) <= len(start)
    assert square(bins, sizes) >= square(start, sizes)
    assert square(P.local_search(bins, sizes, cap), sizes) == square(bins, sizes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(30, 60))
def test_no_step_is_left(sizes, cap):
    bins = P.pack(sizes, cap)
    fill = [sum(sizes[i] for i in b) for b in bins]
    for d in range(len(bins)):
        for s in range(len(bins)):
            if s == d or fill[s] > fill[d]:
                continue
            space = cap - fill[d]
            for out in (c for k in (1, 2) for c in combinations(bins[s], k)):
                for back in (c for k in (0, 1, 2) if len(out) + k < 4 and (len(out), k) != (2, 0) for c in combinations(bins[d], k)):
                    gain = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                    assert not 0 < gain <= space, (sizes, cap, bins, out, back)


def test_search_empties_containers_the_start_left():
    rng = random.Random(5)
    for least, most, cap in ((500, 1199, 2048), (20, 400, 512), (1, 60, 256)):
        sizes = [rng.randint(least, most) for _ in range(2000)]
        start, bins = P.as_they_come(sizes, cap), P.pack(sizes, cap)
        assert len(bins) < 0.95 * len(start) and len(bins) <= 1.05 * -(-sum(sizes) // cap)


def test_each_kind_of_step():
    assert P.local_search([[0], [1]], [4, 5], 10) == [[0, 1]]  # a move
    assert len(P.local_search([[0, 1], [2, 3], [4]], [7, 2, 6, 3, 2], 10)) == 2
    two = P.local_search([[0, 1, 2], [3, 4]], [8, 3, 3, 10, 1], 16)
    assert square(two, [8, 3, 3, 10, 1]) > square([[0, 1, 2], [3, 4]], [8, 3, 3, 10, 1])
    held, fill = [{0, 1}, {2, 3}], [12, 8]
    assert P._two_for_one(held, fill, [7, 5, 4, 4], 13) == 1 and fill == [13, 7]  # 4 + 4 for 7


@needs_tokens
def test_documents(spark):
    texts = ["word " * k for k in (1, 5, 30, 60, 200, 900)] * 30 + [None, "", "  ", "é中" * 400, "a" * 30_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, container_id string, n_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in T.token_counts(df.select("doc_id", "text")).collect()}
    enc = T.encoding(T.RANKS)
    assert all(sizes[i] == len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    budgets = [("s", 64), ("l", 1000), ("none", 0)]
    out = P.pack_documents(df, budgets, shard_items=40).collect()
    for name, cap in budgets[:2]:
        rows = [r for r in out if r.budget_name == name]
        parts, fill = defaultdict(list), defaultdict(int)
        for r in rows:
            parts[r.doc_id].append((r.part_no, r.token_from, r.n_tokens))
            if r.container_id is not None:
                fill[r.container_id] += r.n_tokens
        assert set(parts) == set(sizes)
        for i, p in parts.items():
            p.sort()
            assert sum(n for *_, n in p) == sizes[i]
            assert len(p) == max(1, -(-sizes[i] // cap)) and [k for k, *_ in p] == list(range(len(p)))
            assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:])) and p[0][1] == 0
        assert max(fill.values()) <= cap
        assert len(fill) <= -(-sum(sizes.values()) // cap) * 1.05 + 2
        assert all((r.container_id is None) == (sizes[r.doc_id] == 0) for r in rows)
    assert not [r for r in out if r.budget_name == "none"]
    report = {r.budget_name: r for r in P.fill_report(P.placements(df, budgets, shard_items=40), budgets[:2]).collect()}
    assert report["s"].n_over == 0 and report["s"].fill > 0.95
    assert report["s"].n_emptied == report["s"].n_started - report["s"].n_containers > 0


@needs_tokens
def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), [("s", 8)]).count() == 0
