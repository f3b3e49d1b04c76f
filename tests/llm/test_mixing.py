import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from metaloom.llm import mixing as M
from metaloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary here")
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutations(n):
    for key in (1, 12345678901234567):
        got = M.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got) == list(range(n))
    if n > 100:
        a, b = (M.permute(np.arange(n), np.full(n, n), np.full(n, k)) for k in (1, 2))
        assert (a == b).mean() < 0.05 and (a == np.arange(n)).mean() < 0.05


def test_shards_add_up():
    totals, n = [700, 0, 41, 259], 16
    c, before = M.shard_counts(totals, 64, 3, 0, n)
    assert c.sum(axis=0).tolist() == totals and (c.sum(axis=1)[:-1] == 64).all() and c.sum(axis=1)[-1] == 1000 - 15 * 64 and not before.any()
    for lo, hi in ((0, 1), (3, 9), (15, 16)):  # any task draws the same
        part, before = M.shard_counts(totals, 64, 3, lo, hi)
        assert (part == c[lo:hi]).all() and (before == c[:lo].sum(axis=0)).all()
    spread = np.array([M.shard_counts([500, 500], 100, k, 0, 10)[0][4, 0] for k in range(400)])
    assert abs(spread.mean() - 50) < 1.5 and 3.5 < spread.std() < 6.5  # without replacement: 4.7


def test_shards_of_any_number():
    totals = [10**12, 3 * 10**11, 7]
    a, before = M.shard_counts(totals, 1024, 1, 10**9, 10**9 + 3)
    assert (a.sum(axis=1) == 1024).all() and before.sum() == 1024 * 10**9 and (before <= totals).all()
    assert abs(before[0] / before.sum() - 10 / 13) < 1e-6
    n = -(-sum(totals) // 1024)
    last, before = M.shard_counts(totals, 1024, 1, n - 1, n)
    assert (before + last[0]).tolist() == totals


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "clash", "clash") for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, mix_name string, block_no string")


def test_mix(spark):
    rows = [("Big-Source ", f"text number {i} " * 20) for i in range(400)] + [("small", f"tiny {i} " * 10) for i in range(20)] + [("small", "tiny 0 " * 10)] * 5
    rows += [("SMALL", "text number 3 " * 20), ("other", "never drawn"), (None, "x"), ("small", None), ("small", ""), ("long", "word " * 5000)]
    t = spark.createDataFrame([("m", "big source", 0.6, 1), ("m", " Small", 0.3, 3), ("m", "absent", 0.1, 2), ("n", "long", 1.0, 2), (None, "q", 0.5, 1), ("z", "absent", 1.0, 1)], TARGETS)
    pieces, report = M.mix(docs(spark, rows), t, block_tokens=32)
    p, r = pieces.collect(), {(x.mix_name, x.source): x for x in report.collect()}
    assert set(r) == {("m", "big_source"), ("m", "small"), ("m", "absent"), ("n", "long"), ("z", "absent")}
    assert r["m", "absent"].actual_tokens == 0 and r["m", "small"].n_texts == 20
    assert abs(r["m", "small"].actual_share - 1 / 3) < 0.01 and abs(r["m", "big_source"].actual_share - 2 / 3) < 0.01
    assert r["n", "long"].actual_share == 1.0 and r["n", "long"].most_repeats == 2
    # every token of a text occurs at most max_repeats times in a mix, copies counted together
    enc, seen = T.encoding(T.RANKS), Counter()
    for x in p:
        for k in range(x.token_from, x.token_to):
            seen[x.mix_name, rows[x.doc_id][1], k] += 1
    assert max(v for (m, s, _), v in seen.items() if m == "m" and s.startswith("text")) == 1
    assert max(v for (m, s, _), v in seen.items() if m == "m" and s.startswith("tiny")) <= 3
    # slots are filled without gaps, up to the block size
    slots = defaultdict(list)
    for x in p:
        slots[x.mix_name, x.shard_no, x.slot_no].append((x.token_at, x.token_to - x.token_from))
    for s in slots.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 32
    assert len(slots) == sum(x.n_slots for x in r.values())
    for shard in {(m, k) for m, k, _ in slots}:
        assert sorted(n for m, k, n in slots if (m, k) == shard) == list(range(sum((m, k) == shard for m, k, _ in slots)))
    assert sum(len(enc.encode_ordinary(t)) for s, t in dict((t, (s, t)) for s, t in rows if s == "Big-Source ").values()) == r["m", "big_source"].available_tokens
    blocks = M.render(pieces, docs(spark, rows)).collect()
    assert len(blocks) == len(slots) and all(len(b.token_ids) <= 32 for b in blocks)
    short = [b for b in blocks if len(b.token_ids) < 32]
    assert len({(b.mix_name, b.source) for b in blocks if len(b.token_ids) < 32}) <= 3 and len(short) <= 6
    assert Counter(b.mix_name for b in blocks for _ in b.token_ids) == Counter({m: sum(x.actual_tokens for x in r.values() if x.mix_name == m) for m in ("m", "n")})
    word = enc.encode_ordinary(" word")[0]
    assert sum(b.token_ids.count(word) for b in blocks if b.mix_name == "n") == 2 * enc.encode_ordinary("word " * 5000).count(word)
    again = M.mix(docs(spark, rows), t, block_tokens=32)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, p))


def test_fixed_size_reports_the_shortfall(spark):
    rows = [("a", f"many words here {i} " * 30) for i in range(60)] + [("b", "few words")]
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], TARGETS)
    r = {x.source: x for x in M.mix(docs(spark, rows), t, block_tokens=16, total_tokens=2000)[1].collect()}
    assert r["b"].most_repeats == 2 and r["b"].actual_share < 0.02 < 0.5 and r["a"].actual_tokens >= 990


def test_empty(spark):
    p, r = M.mix(docs(spark, []), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS))
    assert p.count() == 0 and r.collect()[0].actual_tokens == 0
    p, r = M.mix(docs(spark, []), spark.createDataFrame([], TARGETS))
    assert p.count() == 0 and r.count() == 0
