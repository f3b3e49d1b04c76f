"""Neighbouring rows within groups of any size.

A window over a group brings the whole group into one task. Here rows are range-partitioned by
group and order instead, so a hot group is spread like any other; each task looks back one row while
it streams, and the first row of a task finds its neighbour among the last rows of the tasks before
it, two rows a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.util import arrow_map, cut


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """df with prev, a struct of cols from the row before in the group, null for the first. Keys must not be
    null, and keys and order together must tell rows apart; equal rows come in any order."""
    by = [F.col(c) for c in (*keys, *order)]
    src = df.repartitionByRange(*by).sortWithinPartitions(*by)
    names = src.columns
    kinds = dict(src.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __what string, __has boolean, " + ", ".join(f"`__p_{c}` {kinds[c]}" for c in cols)
    n_keys = [names.index(k) for k in keys]
    n_cols = [names.index(c) for c in cols]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        carry = None

        def made(now, before, what):
            n = now.num_rows
            if before is None:
                same = pa.array([False] * n)
                prev = [pa.nulls(n, now.column(i).type) for i in n_cols]
            else:
                same = pc.equal(now.column(n_keys[0]), before.column(n_keys[0]))
                for i in n_keys[1:]:
                    same = pc.and_(same, pc.equal(now.column(i), before.column(i)))
                same = pc.fill_null(same, False)
                prev = [pc.if_else(same, before.column(i), pa.nulls(n, before.column(i).type)) for i in n_cols]
            arrays = [*now.columns, pa.array([what] * n), same, *prev]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "__what", "__has", *(f"__p_{c}" for c in cols)])

        for b in batches:
            if not b.num_rows:
                continue
            if carry is None:
                yield made(b.slice(0, 1), None, "head")
                now, before = b.slice(1), b.slice(0, b.num_rows - 1)
            else:
                t = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
                now, before = t.slice(1), t.slice(0, t.num_rows - 1)
            if now.num_rows:
                yield made(now, before, "row")
            carry = b.slice(b.num_rows - 1)
        if carry is not None:
            yield made(carry, None, "tail")

    got = cut(arrow_map(src, run, out), "neighbours")
    w = Window.partitionBy(*keys).orderBy(*order, F.when(F.col("__what") == "head", 0).otherwise(1))
    marks = got.where("__what <> 'row'").withColumn("__q", F.lag(F.struct("__what", *cols)).over(w)).where("__what = 'head'")
    prev = F.struct(*(F.col(f"__p_{c}").alias(c) for c in cols))
    rows = got.where("__what = 'row'").select(*names, F.when(F.col("__has"), prev).alias("prev"))
    heads = marks.select(*names, F.when(F.col("__q.__what") == "tail", F.struct(*(F.col(f"__q.{c}").alias(c) for c in cols))).alias("prev"))
    return rows.unionByName(heads)


def numbered(df: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """df with a number from 0 along a total order over all rows. Rows are range-partitioned and numbered
    within their task; the tasks' sizes, one row each, give the offsets."""
    by = [F.col(c) for c in order]
    m = F.monotonically_increasing_id()  # the task in the upper bits, the place within it in the lower 33
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", m), "numbered")
    rows = rows.withColumn("__task", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit(2**33 - 1)))
    sizes = rows.groupBy("__task").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__task", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return rows.join(offsets, "__task").withColumn(name, F.col("__before") + F.col("__at")).drop("__m", "__task", "__at", "__before")
