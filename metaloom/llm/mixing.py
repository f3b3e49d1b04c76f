"""Mixing sources to target weights.

The distinct texts of each source, in a pseudorandom order, are packed into blocks of a fixed number
of tokens. For every output shard the number of slots of each source is drawn multinomially under the
condition that the totals come out exactly. Such draws split: the shards are halved again and again, and what
the one half holds is drawn from what both hold, so a task draws the counts of its own shards from the totals in
log2(shards) steps and nothing is planned elsewhere, however many shards there are. The g-th slot of a source maps
through the source's pseudorandom permutation of its block numbers, a new one for each repetition, and the
blocks are joined on by number.

Every block occurs at most max_repeats times, so does every text. The size of a mix is the largest
at which every source that has any text reaches its share; shares of absent sources go to the others
in proportion, and the report shows target and actual shares of all and what stays unused.

Skew: texts are spread over buckets by hash, a source that holds a third of all rows is as many
buckets; prefix sums run within buckets, over buckets and over thousands of them. Blocks are drawn equally
often, so the final join has no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.tokens import RANKS, share, token_counts
from metaloom.util import arrow_map, cut, strip, tasks


def source_key(c):
    """Sources compare without case, blanks around them and kind of separator."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"[\s_./\\-]+", "_"), F.lit(""))


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") >> 1


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index -> its place under the pseudorandom permutation of 0..n-1 that key names: four Feistel
    rounds over the smallest even number of bits that holds n, walked until the place is below n."""
    index, n, key = (np.asarray(x, dtype=np.uint64) for x in (index, n, key))
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def mix(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    out, todo = index.copy(), np.ones(len(index), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            b, m, k = bits[todo], mask[todo], key[todo]
            x = out[todo]
            left, right = x >> b, x & m
            for r in range(4):
                left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
            x = (left << b) | right
            out[todo] = x
            todo[todo] = x >= n[todo]
    return out.astype(np.int64)


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Beyond numpy's range the normal law of the same mean and
    variance stands in, whose error is far below one part in a million there."""
    if max(good, bad, n) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    m = good + bad
    mean, var = n * good / m, n * (good / m) * (bad / m) * ((m - n) / (m - 1))
    return min(good, n, max(0, n - bad, round(rng.normal(mean, var**0.5))))


def shard_counts(totals: list[int], shard_slots: int, seed: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts[shard, source] of the shards lo to hi - 1, slots of each source in the shards before). Every shard
    but the last has shard_slots slots; over all shards each source has its total."""
    whole = sum(totals)
    counts, before = np.zeros((hi - lo, len(totals)), dtype=np.int64), np.zeros(len(totals), dtype=np.int64)
    stack = [(0, -(-whole // shard_slots), list(totals))]
    while stack:
        a, z, left = stack.pop()
        if z <= lo:
            before += np.array(left, dtype=np.int64)
        elif a >= hi or a >= z:
            continue
        elif z - a == 1:
            counts[a - lo] = left
        else:
            mid = (a + z) // 2
            want, rest = min(whole, mid * shard_slots) - a * shard_slots, sum(left)
            rng = np.random.Generator(np.random.PCG64([seed, a, z]))
            first = []
            for n in left:
                rest -= n
                first.append(_drawn(rng, n, rest, want) if n and want else 0)
                want -= first[-1]
            stack += [(a, mid, first), (mid, z, [n - k for n, k in zip(left, first)])]
    return counts, before


def pool(docs: DataFrame, targets: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(mix_name, source, doc_id, text_id, n_tokens): the texts each mix can draw on. Copies of a text
    count once in a mix, under the source and id of the copy with the smallest doc_id. Texts without
    tokens and documents of no listed source take no part."""
    t = targets.select("mix_name", source_key(F.col("source")).alias("source")).where("mix_name is not null and source is not null").distinct()
    d = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where("source is not null and text is not null and text <> ''")
    d = d.join(F.broadcast(t.select("source").distinct()), "source", "left_semi")
    n = token_counts(d.withColumn("text_id", F.unhex(F.md5("text"))), "text", ranks).where("n_tokens > 0")
    n = n.join(F.broadcast(t), "source")  # one row per listed mix and source, a table of fixed size
    one = n.groupBy("mix_name", "text_id").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("m"))
    return one.select("mix_name", "m.source", "m.doc_id", "text_id", "m.n_tokens")


def blocks(texts: DataFrame, sizes: list[tuple[str, str, int]], block_tokens: int, seed: int, bucket_texts: int = 10_000) -> DataFrame:
    """(mix_name, source, block_no, piece_no, doc_id, token_from, token_to). sizes has the number of texts
    of each (mix, source). The last block of a source may be short."""
    n_buckets = F.lit(1)
    for m, s, n in sizes:
        n_buckets = F.when((F.col("mix_name") == m) & (F.col("source") == s), max(1, -(-n // bucket_texts))).otherwise(n_buckets)
    r = texts.withColumn("r", F.xxhash64(F.lit(seed), "source", "text_id")).withColumn("bucket", F.pmod(F.col("r"), n_buckets))
    tot = r.groupBy("mix_name", "source", "bucket").agg(F.sum("n_tokens").alias("b"))
    # sums over buckets, in groups of a thousand, so that no window holds all buckets of a large source
    tot = tot.withColumn("group", F.floor(F.col("bucket") / 1000))
    by = lambda *k: Window.partitionBy("mix_name", "source", *k[:-1]).orderBy(k[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = tot.groupBy("mix_name", "source", "group").agg(F.sum("b").alias("g")).withColumn("earlier", F.coalesce(F.sum("g").over(by("group")), F.lit(0))).drop("g")
    tot = tot.withColumn("within", F.coalesce(F.sum("b").over(by("group", "bucket")), F.lit(0))).join(groups, ["mix_name", "source", "group"])
    tot = tot.select("mix_name", "source", "bucket", (F.col("within") + F.col("earlier")).alias("before"))
    run = Window.partitionBy("mix_name", "source", "bucket").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("upto", F.sum("n_tokens").over(run)).join(tot, ["mix_name", "source", "bucket"])
    start = F.col("before") + F.col("upto") - F.col("n_tokens")
    r = r.select("mix_name", "source", "doc_id", start.alias("a"), (start + F.col("n_tokens")).alias("z"))
    size = F.lit(block_tokens).cast("bigint")
    r = r.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("z") - 1) / size))))
    lo, hi = F.greatest("a", F.col("block_no") * size), F.least("z", (F.col("block_no") + 1) * size)
    return r.select(
        "mix_name", "source", "block_no", (lo - F.col("block_no") * size).cast("int").alias("at"), "doc_id",
        (lo - F.col("a")).cast("int").alias("token_from"), (hi - F.col("a")).cast("int").alias("token_to"),
    )


def plan(available: dict[tuple[str, str], tuple[int, int]], targets: list[tuple[str, str, float, int]], block_tokens: int, total_tokens: int | str | None = None):
    """(mix, source, share, repeats, tokens, blocks, slots) of each target. available has (texts, tokens).

    Without total_tokens a mix is as large as its scarcest present source allows; with it (a number, or
    "available" for all tokens of its sources), a source that cannot fill its share gives all it may, and the shortfall shows in the report. Targets that
    give a source twice, no positive share or no repeats are taken as absent."""
    out = []
    for mix in sorted({m for m, *_ in targets}):
        rows = {s: (sh, rep) for m, s, sh, rep in reversed(targets) if m == mix}
        have = {s: available[mix, s][1] for s, (sh, rep) in rows.items() if (mix, s) in available and (sh or 0) > 0 and (rep or 0) > 0}
        weight = sum(rows[s][0] for s in have)
        whole = min((rows[s][1] * n * weight / rows[s][0] for s, n in have.items()), default=0)
        if total_tokens is not None:
            whole = sum(have.values()) if total_tokens == "available" else total_tokens
        for s, (sh, rep) in sorted(rows.items()):
            n = have.get(s, 0)
            b = -(-n // block_tokens)
            slots = min(rep * b, round(whole * sh / weight / (n / b))) if n else 0
            out.append((mix, s, sh, rep, n, b, slots))
    return out


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = 256, seed: int = 7, total_tokens: int | str | None = None, shard_slots: int = 1024, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(pieces, report).

    pieces: (mix_name, shard_no, slot_no, source, block_no, piece_no, doc_id, token_from, token_to), the
    content of every slot in order. report: (mix_name, source, target_share, max_repeats, n_texts,
    available_tokens, n_slots, actual_tokens, actual_share, unused_tokens, most_repeats) of every target; unused are
    the tokens that occur nowhere in the mix.
    The targets are a small table and are read to the driver; so are the counts per target."""
    spark = docs.sparkSession
    wanted = [(r.mix_name, r.source, r.target_share, r.max_repeats) for r in targets.select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect() if r.mix_name is not None and r.source is not None]
    texts = cut(pool(docs, targets, ranks), "pool")
    counted = texts.groupBy("mix_name", "source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    have = {(r.mix_name, r.source): (r.n, r.t) for r in counted}
    rows = plan(have, wanted, block_tokens, total_tokens)
    made = cut(blocks(texts, [(m, s, n) for (m, s), (n, _) in have.items()], block_tokens, seed), "blocks")

    plans, at_once, n_chunks = [], 64, 0  # of each mix: name, first chunk, shards, and lists by source
    for name in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == name and r[6]]
        if mine:
            n = -(-sum(r[6] for r in mine) // shard_slots)
            plans.append((name, n_chunks, n, [r[1] for r in mine], [r[6] for r in mine], [r[5] for r in mine], [_seed(seed, name, r[1]) for r in mine], _seed(seed, name)))
            n_chunks += -(-n // at_once)

    def run(batches):
        for b in batches:
            for chunk in b.column(0).to_pylist():
                name, first, n_shards, sources, totals, n_blocks, keys, own = next(p for p in reversed(plans) if p[1] <= chunk)
                lo = (chunk - first) * at_once
                counts, before = shard_counts(totals, shard_slots, own, lo, min(n_shards, lo + at_once))
                n, key = np.array(n_blocks, dtype=np.int64), np.array(keys, dtype=np.uint64)
                for k, c in enumerate(counts):
                    s, p, size = np.repeat(np.arange(len(c)), c), np.arange(c.sum()), int(c.sum())
                    g = before[s] + p - np.repeat(np.cumsum(c) - c, c)
                    before += c
                    with np.errstate(over="ignore"):
                        epoch = (g // n[s]).astype(np.uint64)
                        block = permute(g % n[s], n[s], key[s] + epoch * np.uint64(0xD1B54A32D192ED03))
                        slot = permute(p, np.full(size, size), np.full(size, lo + k + seed))
                    names = pa.DictionaryArray.from_arrays(pa.array(s, pa.int32()), pa.array(sources, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * size, pa.string()), pa.array([lo + k] * size, pa.int64()), names, pa.array(slot), pa.array(block)],
                        names=["mix_name", "shard_no", "source", "slot_no", "block_no"],
                    )

    chunks = spark.range(0, n_chunks, 1, max(1, min(n_chunks, 4 * tasks(spark))))
    slots = arrow_map(chunks, run, "mix_name string, shard_no bigint, source string, slot_no bigint, block_no bigint")
    pieces = cut(slots.join(made, ["mix_name", "source", "block_no"]).select(
        "mix_name", "shard_no", "slot_no", "source", "block_no", F.col("at").alias("token_at"), "doc_id", "token_from", "token_to",
    ), "mix")
    by_block = pieces.where("token_from = 0").groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("k"))
    most = by_block.groupBy("mix_name", "source").agg(F.max("k").cast("int").alias("most_repeats"))
    used = pieces.groupBy("mix_name", "source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("actual_tokens"))
    base = spark.createDataFrame(
        [(m, s, sh, rep, have.get((m, s), (0, 0))[0], have.get((m, s), (0, 0))[1], k) for m, s, sh, rep, _, _, k in rows],
        "mix_name string, source string, target_share double, max_repeats int, n_texts bigint, available_tokens bigint, n_slots bigint",
    )
    w = Window.partitionBy("mix_name")
    report = base.join(used, ["mix_name", "source"], "left").join(most, ["mix_name", "source"], "left").fillna(0, ["actual_tokens", "most_repeats"])
    report = report.withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(w)), 6), F.lit(0.0)))
    return pieces, report.withColumn("unused_tokens", F.greatest(F.col("available_tokens") - F.col("actual_tokens"), F.lit(0)))


def render(pieces: DataFrame, docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(mix_name, shard_no, slot_no, source, token_ids array<int>): the tokens of every slot of a mix.

    Pieces are gathered per document, a list that the document's length and repeats bound; each text is
    tokenised once, and pieces go to their slots, which a block's size bounds."""
    where = F.struct("mix_name", "shard_no", "slot_no", "source", "token_at", "token_from", "token_to")
    p = pieces.groupBy("doc_id").agg(F.collect_list(where).alias("p"))
    d = p.join(docs.select("doc_id", "text"), "doc_id").select("text", "p")
    share(docs.sparkSession, ranks)
    names = ["mix_name", "shard_no", "slot_no", "source", "token_at", "ids"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32())]

    def run(batches):
        from metaloom.llm.tokens import encoding

        enc = encoding(ranks).encode_ordinary
        for b in batches:
            for text, parts in zip(*(b.column(i) for i in range(2))):
                ids, rows = enc(text.as_py() or ""), parts.as_py()
                cols = [[r[n] for r in rows] for n in names[:-1]]
                cols.append([ids[r["token_from"] : r["token_to"]] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    out = arrow_map(d, run, "mix_name string, shard_no bigint, slot_no bigint, source string, token_at int, ids array<int>")
    g = out.groupBy("mix_name", "shard_no", "slot_no", "source").agg(F.array_sort(F.collect_list(F.struct("token_at", "ids"))).alias("x"))
    return g.select("mix_name", "shard_no", "slot_no", "source", F.flatten(F.transform("x", lambda y: y["ids"])).alias("token_ids"))
