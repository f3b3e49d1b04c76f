"""Filling containers of fixed capacity with whole items.

Items go to shards by hash. Within a shard and capacity the start takes items as they come; swap-based
local search then does the packing. Between two underfull containers it moves an item, exchanges one for
one, two for one or one for two, always from the less to the more filled one, so the sum of squared fills
grows with every step, until containers empty and no such step is left. What stays loosely filled is
packed again among the loose containers of other shards. An item is split only if it alone exceeds the
capacity: into full containers and a rest that is packed like any item.

Shards and the groups of the second pass hold a bounded number of items whatever their sizes, and each
(shard, capacity) is a task's work of its own, so there is no hot one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.tokens import RANKS, token_counts
from metaloom.util import cut, ship, tasks


def as_they_come(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes; a new one is begun where an item does not fit."""
    bins: list[list[int]] = []
    space = 0
    for i, n in enumerate(sizes):
        if n > space:
            bins.append([])
            space = capacity
        bins[-1].append(i)
        space -= n
    return bins


class _Sizes:
    """The items of open containers by size; a bit for each size tells whether there is one."""

    def __init__(self) -> None:
        self.items: dict[int, list[int]] = {}
        self.count: dict[int, int] = {}
        self.bits = 0

    def add(self, size: int, item: int) -> None:
        self.items.setdefault(size, []).append(item)
        n = self.count.get(size, 0)
        self.count[size] = n + 1
        if not n:
            self.bits |= 1 << size

    def drop(self, size: int) -> None:
        """One item of a size counts no more; its entry stays until it comes up."""
        self.count[size] -= 1
        if not self.count[size]:
            self.bits &= ~(1 << size)

    def most(self, at_most: int) -> int:
        """The largest size there is up to a bound; 0 if none."""
        return max(0, (self.bits & ((1 << (at_most + 1)) - 1)).bit_length() - 1)


def _exchange(dst: list[int], sizes: list[int], space: int, there: _Sizes) -> tuple[int, tuple[int, ...]]:
    """The exchange that fills a container best: (size of the item that comes, items of dst that go for it).
    Of equal ones the largest item comes, for small ones fit elsewhere. Size 0 if none makes it fuller."""
    size, away = there.most(space), ()
    gain = size
    own = sorted({sizes[i]: i for i in dst}.items())
    for n, b in own:  # one for one
        s = there.most(n + space)
        if s - n >= gain and s > n:
            size, away, gain = s, (b,), s - n
    if gain < space or len(own) < 8:  # with many items, one that leaves no space needs no better
        twice = {sizes[i]: i for i in dst if i not in {b for _, b in own}}
        for k, (n, b) in enumerate(own):  # one for two
            for m, c in own[:k] + ([(n, twice[n])] if n in twice else []):
                s = there.most(n + m + space)
                if s - n - m > gain or (s - n - m == gain and s > size):
                    size, away, gain = s, (b, c), s - n - m
            if gain == space and k > 8:
                break
    return (size, away) if gain > 0 else (0, ())


def _sweep(bins: list[set[int]], fill: list[int], sizes: list[int], capacity: int, order) -> int:
    """Fill the underfull containers one after another from those still to come; the least filled give first.
    Returns the number of steps."""
    low = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
    there, home, steps = _Sizes(), {}, 0
    for b in sorted(low, key=lambda b: (-fill[b], b)):
        for i in sorted(bins[b]):
            home[i] = b
            there.add(sizes[i], i)
    for d in sorted(low, key=order):
        for i in bins[d]:
            there.drop(sizes[i])
            home[i] = -1
        while bins[d] and fill[d] < capacity:
            size, away = _exchange(bins[d], sizes, capacity - fill[d], there)
            if not size:
                break
            stack = there.items[size]
            while home[stack[-1]] < 0:
                stack.pop()
            i = stack[-1]
            s, gain = home[i], size - sum(sizes[j] for j in away)
            if fill[d] + gain <= fill[s]:  # the squared fill would not grow; the other takes its turn later
                break
            stack.pop()
            there.drop(size)
            home[i] = -1
            bins[s].remove(i)
            bins[d].add(i)
            for j in away:
                bins[d].remove(j)
                bins[s].add(j)
                home[j] = s
                there.add(sizes[j], j)
            fill[d] += gain
            fill[s] -= gain
            steps += 1
    return steps


def _two_for_one(bins: list[set[int]], fill: list[int], sizes: list[int], capacity: int) -> int:
    """Two items of a less filled container for one of a fuller one, each container at most once, found by
    the sums of pairs. Returns the number of steps."""
    low = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
    sums, steps, used = _Sizes(), 0, set()
    pairs: list[tuple[int, int, int]] = []
    for s in low:  # the least filled come up first
        own = sorted(bins[s])
        for k, i in enumerate(own):
            for j in own[:k]:
                if sizes[i] + sizes[j] <= capacity:
                    sums.add(sizes[i] + sizes[j], len(pairs))
                    pairs.append((s, i, j))
    for d in low:
        if d in used:
            continue
        space, best, found = capacity - fill[d], 0, None
        for b in bins[d]:
            top = sizes[b] + space
            while (n := sums.most(top)) - sizes[b] > best:
                stack = sums.items[n]
                while stack and pairs[stack[-1]][0] in used:
                    stack.pop()
                    sums.drop(n)
                for e in reversed(stack):
                    s = pairs[e][0]
                    if s != d and s not in used and fill[s] <= fill[d]:
                        best, found = n - sizes[b], (b, e)
                        break
                top = n - 1
        if found:
            b, (s, i, j) = found[0], pairs[found[1]]
            bins[s] -= {i, j}
            bins[s].add(b)
            bins[d] |= {i, j}
            bins[d].remove(b)
            fill[s] -= best
            fill[d] += best
            used |= {s, d}
            steps += 1
    return steps


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty the less filled containers into the fuller ones until no move and no exchange of one for one,
    two for one or one for two between two of them raises the squared fill that the steps look for."""
    held = [set(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    orders = (
        lambda b: (-max(sizes[i] for i in held[b]), -fill[b], b),  # large items are the hardest to place
        lambda b: (-fill[b], b),
        lambda b: (-fill[b], -b),
    )
    while any(_sweep(held, fill, sizes, capacity, o) for o in orders) or _two_for_one(held, fill, sizes, capacity):
        pass
    return [sorted(b) for b in held if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers for items that all fit into one."""
    return local_search(as_they_come(sizes, capacity), sizes, capacity)


OUT = "budget_name string, container_id bigint, doc_id bigint, part_no int, token_from int, n_tokens int, loose boolean, start_id bigint"
#: Container numbers of the second pass begin here, beyond those of any shard.
SECOND = 2**24


def _pack_unit(budgets: list[tuple[str, int]], keep: float, first: bool):
    """Pack the items of one shard for one capacity. In the first pass documents larger than the capacity are
    split and items taken as they come; in the second the search goes on from the containers there are."""

    def run(key, pdf):
        import pandas as pd

        unit = int(key[0])
        (name, cap), shard = budgets[unit % len(budgets)], unit // len(budgets) + (0 if first else SECOND)
        pdf = pdf.sort_values(["doc_id", "part_no"], kind="stable")
        doc, part, at, n = (pdf[c].to_numpy() for c in ("doc_id", "part_no", "token_from", "n_tokens"))
        whole = None
        if first:
            full = np.where(n > cap, n // cap, 0)
            i = np.repeat(np.arange(len(n)), full)
            k = np.arange(len(i)) - np.repeat(np.cumsum(full) - full, full)
            whole = pd.DataFrame({"doc_id": doc[i], "part_no": k, "token_from": k * cap, "n_tokens": cap, "bin": np.arange(len(i)), "loose": False})
            some = n - full * cap > 0
            doc, part, at, n = doc[some], full[some], (full * cap)[some], (n - full * cap)[some]
        sizes = n.tolist()
        start = np.zeros(len(sizes), dtype=np.int64)
        if first:
            bins = as_they_come(sizes, cap)
            for b, items in enumerate(bins):
                start[items] = (shard << 32) + len(whole) + b
        else:
            start = pdf.start_id.to_numpy()
            held: dict = {}
            for i, c in enumerate(pdf.container_id.tolist()):
                held.setdefault(c, []).append(i)
            bins = [held[c] for c in sorted(held)]
        which, loose = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
        for b, items in enumerate(local_search(bins, sizes, cap)):
            which[items] = b
            loose[items] = sum(sizes[i] for i in items) < keep * cap
        out = pd.DataFrame({"doc_id": doc, "part_no": part, "token_from": at, "n_tokens": n, "bin": which + (len(whole) if first else 0), "loose": loose, "start_id": start})
        if first:
            out = pd.concat([whole.assign(start_id=(shard << 32) + whole.bin), out], ignore_index=True)
        out = out.assign(budget_name=name, container_id=(shard << 32) + out.bin.astype("int64"))
        return out[["budget_name", "container_id", "doc_id", "part_no", "token_from", "n_tokens", "loose", "start_id"]]

    return run


def _spread(df: DataFrame, units: int) -> DataFrame:
    """Units over a number of tasks of their own choosing, which adaptive execution does not merge: the rows are
    few bytes, the work on them is not."""
    spark = df.sparkSession
    return df.repartition(max(1, min(2 * units, 4 * max(tasks(spark), spark.sparkContext.defaultParallelism))), "unit").groupBy("unit")


def placements(docs: DataFrame, budgets: list[tuple[str, int]], ranks: str = RANKS, shard_items: int = 20_000, keep: float = 0.98) -> DataFrame:
    """The rows of `pack_documents` with start_id, the container that a part was in before the search."""
    budgets = [(n, int(c)) for n, c in budgets if c is not None and c > 0]
    none = F.lit(None).cast("bigint")
    if not budgets:
        return docs.sparkSession.createDataFrame([], OUT).drop("loose")
    sizes = cut(token_counts(docs.select("doc_id", "text"), "text", ranks), "tokens")
    ship(docs.sparkSession)
    shards = max(1, -(-sizes.count() // shard_items))
    each = F.explode(F.sequence(F.lit(0), F.lit(len(budgets) - 1)))
    some = sizes.where("n_tokens > 0").select("doc_id", F.lit(0).alias("part_no"), F.lit(0).alias("token_from"), "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).alias("shard"), each.alias("k"))
    some = some.withColumn("unit", F.col("shard") * len(budgets) + F.col("k")).drop("shard", "k")
    first = cut(_spread(some, shards * len(budgets)).applyInPandas(_pack_unit(budgets, keep, True), OUT), "packed")
    again = first.where("loose")
    n = {r.budget_name: r.n for r in again.groupBy("budget_name").agg(F.count("*").alias("n")).collect()}  # a row a budget
    groups, unit = [max(1, -(-n.get(b, 0) // shard_items)) for b, _ in budgets], F.lit(None)
    for k, (b, _) in enumerate(budgets):
        unit = F.when(F.col("budget_name") == b, F.pmod(F.xxhash64("container_id"), F.lit(groups[k])) * len(budgets) + k).otherwise(unit)
    second = _spread(again.withColumn("unit", unit.cast("bigint")), max(groups) * len(budgets)).applyInPandas(_pack_unit(budgets, keep, False), OUT)
    empty = sizes.where("n_tokens = 0").select(
        F.explode(F.array(*(F.lit(b) for b, _ in budgets))).alias("budget_name"), none.alias("container_id"), "doc_id",
        F.lit(0).alias("part_no"), F.lit(0).alias("token_from"), F.lit(0).alias("n_tokens"), none.alias("start_id"),
    )
    return first.where("not loose").drop("loose").unionByName(second.drop("loose")).unionByName(empty)


def pack_documents(docs: DataFrame, budgets: list[tuple[str, int]], ranks: str = RANKS, shard_items: int = 20_000, keep: float = 0.98) -> DataFrame:
    """(budget_name, container_id, doc_id, part_no, token_from, n_tokens): where every part of every
    document goes, for each (name, capacity in tokens); names are distinct.

    part_no and token_from place the part within its document; only a document larger than the
    capacity has more than one. Documents without tokens (null or empty text) need no space: they come
    out once per budget with a null container. Budgets without a positive capacity are ignored.
    Containers filled below `keep` after the first pass are packed once more with those of other shards,
    in groups of about shard_items items. Repeated rows are items of their own."""
    return placements(docs, budgets, ranks, shard_items, keep).drop("start_id")


def fill_report(placed: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """(budget_name, capacity_tokens, n_started, n_emptied, n_containers, least_possible, n_parts, n_tokens, fill,
    n_over) of `placements`: n_started containers before the search, n_emptied of them emptied by it."""
    spark = placed.sparkSession
    b = spark.createDataFrame(budgets, "budget_name string, capacity_tokens int")
    p = placed.where("container_id is not null")
    c = p.groupBy("budget_name", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    began = p.select("budget_name", "start_id").distinct().groupBy("budget_name").agg(F.count("*").alias("n_started"))
    return c.join(b, "budget_name").groupBy("budget_name", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum("n") / F.first("capacity_tokens")).alias("least_possible"), F.sum("parts").alias("n_parts"), F.sum("n").alias("n_tokens"),
        F.round(F.sum("n") / (F.count("*") * F.first("capacity_tokens")), 6).alias("fill"), F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over"),
    ).join(began, "budget_name").withColumn("n_emptied", F.col("n_started") - F.col("n_containers"))
