"""All pairs of two sets of rows, compared without a shuffle of pairs.

The rows are dealt into blocks and copied to the tasks that need them, so that any two rows meet in exactly one task,
which holds one block of either set. The shuffle holds each row once for every block of the other set; what is
compared and thrown away never leaves its task.
"""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.util import arrow_map, cut, tasks

#: Rows of a block at most, on average, and those under which a block is not cut further to give all tasks work.
ROWS, FEW = 10_000, 250
#: Rows of a batch that a task hands on, and rows of a left block that are compared at once.
BATCH, PIECE = 50_000, 2_000
#: Bits of each of the three numbers of a link: of a, of b, and how many items they share.
SHIFT = 21


def _blocks(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def _held(batches):
    """(part, table) for each part of a task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        for p in pc.unique(t["part"]).to_pylist():
            yield p, t.filter(pc.equal(t["part"], p))


def _side(t, name: str):
    import pyarrow as pa
    import pyarrow.compute as pc

    c = t[name].combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_struct_array(c.filter(pc.is_valid(c)))


def compare(left: DataFrame, right: DataFrame, fn, schema: str, rows: int = ROWS) -> DataFrame:
    """What fn(l, r) yields as record batches for every piece l of left's blocks and every block r of right. The first column of
    either is its key. Both are read twice (a count before), so cut what is dear to make."""
    nl, nr, want = left.count(), right.count(), 2 * tasks(left.sparkSession)
    m, n = _blocks(nl, rows), _blocks(nr, rows)
    m = max(m, min(_blocks(want, n), _blocks(nl, FEW)))  # large blocks on the right: a row of left is compared with all of one at once
    n = max(n, min(_blocks(want, m), _blocks(nr, FEW)))
    deal = lambda d, k: F.pmod(F.xxhash64(d.columns[0]), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.select(F.struct("*").alias("l"), deal(left, m).alias("i"), each(n).alias("j"))
    two = right.select(F.struct("*").alias("r"), each(m).alias("i"), deal(right, n).alias("j"))
    part = (F.col("i") * n + F.col("j")).alias("part")
    both = one.select(part, "l", F.lit(None).cast(two.schema["r"].dataType).alias("r")).unionByName(two.select(part, F.lit(None).cast(one.schema["l"].dataType).alias("l"), "r"))

    def run(batches):
        for _, t in _held(batches):
            l, r = _side(t, "l"), _side(t, "r")
            if l.num_rows and r.num_rows:
                for k in range(0, l.num_rows, PIECE):
                    yield from fn(l.slice(k, PIECE), r)

    return arrow_map(both.repartitionById(m * n, "part"), run, schema)


def overlaps(sets: DataFrame, least: int, rows: int = ROWS) -> DataFrame:
    """(a, b, n), a < b: the keys of all two sets that share at least so many items. sets is (key, items), a row a key, with
    items as distinct numbers or texts; it is read three times, so cut what is dear to make. Blocks are ranges of keys, a row
    each; a cartesian product hands a task two of them, so the shuffle holds each set twice, however many blocks there are.
    A task hands on its links as numbers, with the keys beside them, ordered by a and n: a file then has few distinct keys, in
    runs, and is small."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = sets.sparkSession
    count, want = sets.count(), 2 * tasks(spark)
    k = _blocks(count, rows)
    while k * (k + 1) // 2 < want and count > k * FEW:
        k += 1
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def pack(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by("key")  # of bytes, as keys compare in SQL
            keys, items = pa.concat_arrays(t["key"].chunks), pa.concat_arrays(t["items"].chunks)
            words = items.flatten().dictionary_encode()
            yield pa.RecordBatch.from_arrays([keys[:1], one(keys), one(pc.list_value_length(items)), one(words.indices), one(words.dictionary)], names=["low", "keys", "sizes", "codes", "words"])

    item = sets.schema["items"].dataType.elementType.simpleString()
    made = arrow_map(sets.select("key", "items").repartitionByRange(k, "key"), pack, f"low string, keys array<string>, sizes array<int>, codes array<int>, words array<{item}>")
    packs = cut(made.withColumn("block", F.spark_partition_id()), "blocks").repartitionById(k, "block").drop("block")
    both = packs.select(F.struct("*").alias("l")).join(packs.select(F.struct("*").alias("r")).hint("shuffle_replicate_nl"), F.expr("l.low <= r.low"))

    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                l, r = ({n: s.field(n)[x].values for n in ("keys", "sizes", "codes", "words")} for s in (batch.column(0), batch.column(1)))
                yield from links(l, r, batch.column(0).field("low")[x].equals(batch.column(1).field("low")[x]))

    def links(l, r, alone: bool):
        place = {w: i for i, w in enumerate(r["words"].to_pylist())}
        codes = np.array([place.get(w, -1) for w in l["words"].to_pylist()], np.int64)[l["codes"].to_numpy()]
        ends = np.cumsum(l["sizes"].to_numpy()).tolist()
        of = r["codes"].to_numpy()
        order = np.argsort(of, kind="stable")
        index = np.split(np.repeat(np.arange(len(r["keys"])), r["sizes"].to_numpy())[order], np.cumsum(np.bincount(of, minlength=len(place)))[:-1])
        held, size, first, start = [], 0, 0, 0
        for i, end in enumerate(ends):
            lists = [index[c] for c in codes[start:end].tolist() if c >= 0]
            start = end
            if len(lists) >= least:
                n = np.bincount(np.concatenate(lists))
                found = np.flatnonzero(n >= least)
                if alone:
                    found = found[found > i]
                n = n[found]
                order = np.argsort(n.astype(np.uint16) if len(lists) < 1 << 16 else n, kind="stable")
                held.append((i - first << SHIFT) + found[order] << SHIFT | n[order])
                size += len(found)
            if size >= BATCH or size and i + 1 == len(ends):
                yield pa.RecordBatch.from_arrays([one(l["keys"][first : i + 1]), one(r["keys"]), one(pa.array(np.concatenate(held)))], names=["l", "r", "link"])
                held, size, first = [], 0, i + 1

    found = arrow_map(both, run, "l array<string>, r array<string>, link array<bigint>").select("l", "r", F.explode("link").alias("x"))
    low = (1 << SHIFT) - 1
    return found.select(
        F.get("l", F.shiftright("x", 2 * SHIFT).cast("int")).alias("a"), F.get("r", F.shiftright("x", SHIFT).bitwiseAND(low).cast("int")).alias("b"), F.col("x").bitwiseAND(low).alias("n"),
    )


def matching(x: str, b: SequenceMatcher) -> int:
    """The letters in matching blocks of x and the second text of b, as SequenceMatcher.ratio() counts them."""
    b.set_seq1(x)
    todo, total = [(0, len(x), 0, len(b.b))], 0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, k = b.find_longest_match(alo, ahi, blo, bhi)
        if k:
            total += k
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
    return total


class Texts:
    """Texts of a block as arrays: their letters as numbers, and how often each letter occurs in each text."""

    WIDE = 128

    def __init__(self, texts: list[str], letters: dict[str, int]) -> None:
        self.texts, self.length = texts, np.array([len(t) for t in texts], np.int32)
        self.codes = np.zeros((int(self.length.max(initial=0)), len(texts)), np.int32)  # 0: past the end
        self.counts = np.zeros((self.WIDE, len(texts)), np.uint8 if self.length.max(initial=0) < 128 else np.int32)
        for i, t in enumerate(texts):
            c = np.array([letters.setdefault(x, len(letters) + 1) for x in t], np.int32)
            self.codes[: len(t), i] = c
            np.add.at(self.counts[:, i], c % self.WIDE, 1)


def common(x: list[int], t: Texts, of: np.ndarray, letters: int) -> np.ndarray:
    """The length of the longest common subsequence of x (63 letters at most) and each text of t numbered in `of`,
    64 places at once: never less than the letters in matching blocks."""
    at = np.zeros(letters + 1, np.uint64)
    for i, c in enumerate(x):
        at[c] |= np.uint64(1 << i)
    v = np.full(len(of), 2**64 - 1, np.uint64)
    for j in range(int(t.length[of].max(initial=0))):
        u = v & at[t.codes[j, of]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & np.uint64((1 << len(x)) - 1)).astype(np.int32)


def similar(left: list[tuple[str, str, str]], right: list[tuple[str, str, str]], least: float, squeezed: float, bare: float, within: float):
    """(i, j, similarity) arrays of all pairs that are so similar. A name is (text, squeezed, bare); see `scored_pairs`.
    The ratio is computed only where bounds that it never exceeds leave it a chance."""
    letters: dict[str, int] = {}
    y = Texts([r[0] for r in right], letters)
    counts_of = Texts([l[0] for l in left], letters)
    short = np.array([len(r[1]) for r in right], np.int32)
    codes: dict[str, int] = {}
    kind = np.array([codes.setdefault(r[2], len(codes)) for r in right], np.int32)
    found, slack = [], 1e-9
    for i, (text, sq, ba) in enumerate(left):
        x = counts_of.codes[: len(text), i].tolist()
        shared = np.zeros(len(right), np.result_type(counts_of.counts.dtype, y.counts.dtype))
        for c in np.flatnonzero(counts_of.counts[:, i]):
            shared += np.minimum(y.counts[c], counts_of.counts[c, i])
        both = y.length + len(text)
        shared = shared.astype(np.int32)
        chance = 2 * shared >= (least - slack) * both
        if len(x) <= 63:
            of = np.flatnonzero(chance)
            chance[of] = 2 * common(x, y, of, len(letters)) >= (least - slack) * both[of]
        named = (shared >= np.minimum(short, len(sq))) | (kind == codes.get(ba, -1))
        for j in np.flatnonzero(chance | named).tolist():
            found.append((j, i, bool(chance[j])))
    found.sort()
    ii, jj, ss, last, m = [], [], [], -1, None
    for j, i, chance in found:
        (a, u, p), (b, v, q) = left[i], right[j]
        if a == b:
            s = 1.0
        elif u == v:
            s = squeezed
        else:
            s = bare if p == q else within if u in v or v in u else 0.0
            if chance and a and b:
                if j != last:
                    m, last = SequenceMatcher(None, "", b), j
                s = max(s, 2.0 * matching(a, m) / (len(a) + len(b)))
        if s >= least:
            ii.append(i), jj.append(j), ss.append(s)
    return np.array(ii, np.int64), np.array(jj, np.int64), np.array(ss, np.float64)


class Targets:
    """Where each name stands among the columns of a block of assets: (asset, place), the first place of an asset."""

    def __init__(self, columns: list[list[dict]]) -> None:
        first: dict[str, dict[int, int]] = defaultdict(dict)
        for i, cols in enumerate(columns):
            for c in cols or ():
                at = first[c["name"]]
                at[i] = min(c["pos"], at.get(i, c["pos"]))
        self.n = len(columns)
        self.at = {n: (np.array(list(p), np.int64), np.array(list(p.values()), np.int64)) for n, p in first.items()}

    def match(self, columns: list[dict]):
        """(n, total): how many of a source's columns find a match in each asset, and the sum of their similarities. Each
        column in turn takes the most similar name that none before it took, the first in place among equals. A column
        is its place and its similar names, each with a similarity."""
        n, total, used = np.zeros(self.n, np.int32), np.zeros(self.n), {}
        by: dict[int, dict[float, set[str]]] = defaultdict(lambda: defaultdict(set))
        for c in columns or ():
            for a in c["alike"]:
                if a["b"] in self.at:
                    by[c["pos"]][a["similarity"]].add(a["b"])
        for pos in sorted(by):
            done = np.zeros(self.n, bool)
            for s in sorted(by[pos], reverse=True):
                names = sorted(by[pos][s])
                parts = []
                for k, b in enumerate(names):
                    i, place = self.at[b]
                    free = ~done[i]
                    if b in used:
                        free &= ~used[b][i]
                    parts.append((i[free], place[free], np.full(int(free.sum()), k)))
                i, place, k = parts[0] if len(parts) == 1 else (np.concatenate(p) for p in zip(*parts))
                if len(parts) > 1:
                    order = np.lexsort((k, place, i))
                    i, k = i[order], k[order]
                    first = np.ones(len(i), bool)
                    first[1:] = i[1:] != i[:-1]
                    i, k = i[first], k[first]
                done[i] = True
                n[i] += 1
                total[i] += s
                for x, b in enumerate(names):
                    got = i[k == x]
                    if len(got):
                        used.setdefault(b, np.zeros(self.n, bool))[got] = True
        return n, total
