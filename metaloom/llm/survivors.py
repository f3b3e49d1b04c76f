"""The best representative of each duplicate group, field by field, by currency reasoning.

Rows with a time give a total order within their group. From neighbours along it the value transitions
of each field are learned over all groups, always: v comes before w where v -> w was seen more often
than w -> v. The learned order is closed over values outside a group, and values on a cycle of
majorities come neither before nor after one another.

In each group the values of a field form a partial order: timed values by their last times, values that
only rows without a time hold by the learned order. The group's own order stands above the learned one.
The topologically latest value wins; of several, a timed one, then the one of the largest id. A group
whose values all have a time is a total order and yields its last value.

Skew: everything per group is a maximum, aggregated in the map tasks before the shuffle. Transitions are
counted while tasks stream rows range-partitioned by (group, time, id), which spreads a hot group; two
marks a task and field join the ends. The order is closed outwards from the values in question only, over
a graph whose unbranched stretches are cut short by pointer doubling, so a long history is few rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.util import arrow_map, cut, cut_counted, instant, loose_id, strip

#: Words and signs for a value that is not known (fixed values).
NOT_KNOWN = (
    "unknown", "not known", "none", "null", "nil", "nan", "n/a", "na", "n.a.", "n/k", "#n/a", "not available", "not applicable", "unavailable",
    "missing", "undefined", "unspecified", "not specified", "not set", "tbd", "tba", "tbc", "to be determined",
    "-", "--", "---", "?", "??", "???", ".", "..", "...", "_", "*", "<unknown>", "<null>", "(null)", "(none)", "(unknown)", "[null]", "\\n",
)
#: Digests of empty content: SHAKE-128 (16 and 32 bytes), MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512, CRC-32 (fixed values).
EMPTY_HASHES = (
    "7f9c2ba4e88f827d616045507605853e",
    "7f9c2ba4e88f827d616045507605853ed73b8093f6efbc88eb1a6eacfa66ef26",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "d14a028c2a3a2bc9476102bb288234c415a2b01f828ea62ac5b3e42f",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "38b060a751ac96384cd9327eb1b1e36a21fdb71114be07434c0cc7bf63f6e1da274edebfe76f65fb51ad2f14898b95b",
    "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e",
    "00000000",
)
FIELDS = ("name", "size_bytes", "format", "hash", "last_modified")


def _known(v: Column) -> Column:
    """A trimmed value unless it stands for not known."""
    return F.when(~F.lower(v).isin(*NOT_KNOWN), v)


def _number(v: Column) -> Column:
    return F.when(v.rlike(r"^\+?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), v.try_cast("double"))


def _hash(v: Column) -> Column:
    """A digest in lower case unless it is that of empty content or one repeated digit."""
    return F.when(~v.isin(*EMPTY_HASHES) & (F.replace(v, F.substring(v, 1, 1), F.lit("")) != ""), v)


def _zoned(v: Column) -> Column:
    """A date with a time of day and a zone: without a zone it is UTC, without a time of day midnight."""
    z = F.when(v.rlike(r"^[0-9-]+$"), F.concat(v, F.lit(" 00:00:00Z"))).when(v.rlike(r"([Zz]|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"), v).otherwise(F.concat(v, F.lit("Z")))
    return F.when(v.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ]|$)"), z)


def _document(c: Column) -> Column:
    """JSON text that was delivered inside a JSON string, at most twice."""
    for _ in range(2):
        c = F.when(c.rlike(r'^\s*"'), F.get_json_object(c, "$")).otherwise(c)
    return c


def observations(rows: DataFrame) -> DataFrame:
    """(asset_id, id, at, name, size_bytes, format, hash, last_modified): the usable values of
    file_metadata, in the nested or the flat form, else null. Rows of no asset are left out; a document
    that is null or not complete JSON has no usable value. All of it stays in the JVM."""
    top = F.from_json(
        _document(F.col("file_metadata")),
        "basic string, hash string, timestamps string, file_name string, size string, format string, file_hash string, last_modified string",
    )
    r = rows.select(loose_id("asset_id").alias("asset_id"), F.col("id").cast("bigint").alias("id"), instant(rows, "discovered_at").alias("at"), top.alias("d")).where("asset_id is not null")
    r = r.select(
        "asset_id", "id", "at", "d",
        F.from_json("d.basic", "name string, size_bytes string, format string").alias("b"),
        F.from_json("d.hash", "value string").alias("h"),
        F.from_json("d.timestamps", "last_modified string").alias("t"),
    )
    # one step a select: what a later step uses twice is computed once, and the code stays small
    raw = {
        "name": ("b.name", "d.file_name"), "size_bytes": ("b.size_bytes", "d.size"), "format": ("b.format", "d.format"),
        "hash": ("h.value", "d.file_hash"), "last_modified": ("t.last_modified", "d.last_modified"),
    }
    key, forms = ["asset_id", "id", "at"], [f"{f}{i}" for f in raw for i in (0, 1)]
    r = r.select(*key, *(F.nullif(strip(F.col(c)), F.lit("")).alias(f"{f}{i}") for f, cs in raw.items() for i, c in enumerate(cs)))
    r = r.select(*key, *((_number(F.col(c)) if c.startswith("size") else _known(F.col(c))).alias(c) for c in forms))
    each = {"size_bytes": lambda c: F.when(c > 0, F.floor(c).cast("string")), "hash": lambda c: _hash(F.lower(c))}
    r = r.select(
        *key, "last_modified0", "last_modified1", *(_zoned(F.col(f"last_modified{i}")).try_cast("timestamp").alias(f"t{i}") for i in (0, 1)),
        *(F.coalesce(*(each.get(f, lambda c: c)(F.col(f"{f}{i}")) for i in (0, 1))).alias(f) for f in FIELDS[:4]),
    )
    since = F.lit("2000-01-01 00:00:00Z").cast("timestamp")
    times = (F.when((F.col(f"t{i}") >= since) & (F.col("at").isNull() | (F.col(f"t{i}") <= F.col("at"))), F.col(f"last_modified{i}")) for i in (0, 1))
    return r.select(*key, *FIELDS[:4], F.coalesce(*times).alias("last_modified"))


def _long(obs: DataFrame, fields=FIELDS) -> DataFrame:
    """(asset_id, id, at, field_name, value), one row per usable value."""
    return obs.select("asset_id", "id", "at", F.inline(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))).where("value is not null")


_MOVES = "what string, field_name string, was string, becomes string, n bigint, asset_id string, at bigint, id bigint"


def _streamed(fields):
    """Arrow batches of (asset_id, at, id, *fields) in order -> counts of moves, and the first and last value of
    each field in the first and last group of the task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c.split(" ")[0] for c in _MOVES.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def marks(what, asset, ends):
        rows = [(what, f, v, v, 0, asset, at, i) for f, (v, at, i) in ends.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    def run(batches):
        group, first, last, head = None, {}, {}, True  # of the group the stream is in; head: it is the task's first
        for b in batches:
            if not b.num_rows:
                continue
            asset, at, ids = b.column(0), b.column(1), b.column(2)
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = pc.not_equal(asset[1:], asset[:-1]).to_numpy(zero_copy_only=False)
            new[0] = group is not None and asset[0].as_py() != group
            no = np.cumsum(new)
            if group is None:
                group = asset[0].as_py()
            moved, begin, end = [], {}, {}
            for k, f in enumerate(fields):
                col = b.column(3 + k)
                at_ = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
                if not len(at_):
                    continue
                v, g = col.take(pa.array(at_)), no[at_]
                for ends, j in ((begin, 0), (end, -1)):
                    ends[f] = (g[j], v[j].as_py(), at[int(at_[j])].as_py(), ids[int(at_[j])].as_py())
                if f in last:
                    v, g = pa.concat_arrays([pa.array([last[f][0]], pa.string()), v]), np.concatenate([[0], g])
                turn = pc.and_(pa.array(g[1:] == g[:-1]), pc.not_equal(v[1:], v[:-1]))
                t = pa.table({"was": v[:-1].filter(turn), "becomes": v[1:].filter(turn)}).group_by(["was", "becomes"]).aggregate([([], "count_all")])
                moved.append(t.add_column(0, "field_name", pa.array([f] * t.num_rows, pa.string())))
            if head:
                for f, (g, *x) in begin.items():
                    if g == 0:
                        first.setdefault(f, x)
                if no[-1] > 0:
                    if first:
                        yield marks("head", group, first)
                    head = False
            if no[-1] > 0:
                last = {}
            last |= {f: x for f, (g, *x) in end.items() if g == no[-1]}
            group = asset[-1].as_py()
            for t in moved:
                for r in t.combine_chunks().to_batches():
                    n = r.num_rows
                    cols = [pa.array(["move"] * n, pa.string()), r["field_name"], r["was"], r["becomes"], r["count_all"], *(pa.nulls(n, k) for k in kinds[5:])]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if head and first:
            yield marks("head", group, first)
        if last:
            yield marks("tail", group, last)

    return run


def transitions(obs: DataFrame, fields=FIELDS) -> DataFrame:
    """(field_name, was, becomes, n): how often a usable value follows another one along the timed rows of a
    group, in parts that still have to be added up. Rows without a time and repeats of a value are no move."""
    key = ["asset_id", "at", "id"]
    timed = obs.where("at is not null").select("asset_id", F.unix_micros("at").alias("at"), "id", *fields)
    timed = timed.repartitionByRange(*key).sortWithinPartitions(*key, *fields)
    got = cut(arrow_map(timed, _streamed(fields), _MOVES), "moves")
    w = Window.partitionBy("asset_id", "field_name").orderBy("at", "id", F.when(F.col("what") == "head", 0).otherwise(1))
    ends = got.where("what <> 'move'").withColumn("prev", F.lag(F.struct("what", "was")).over(w))
    ends = ends.where("what = 'head' and prev.what = 'tail' and prev.was <> becomes")
    return got.where("what = 'move'").select("field_name", "was", "becomes", "n").unionByName(
        ends.select("field_name", F.col("prev.was").alias("was"), "becomes", F.lit(1).cast("bigint").alias("n"))
    )


def precedence(moves: DataFrame) -> DataFrame:
    """(field_name, earlier, later, n_for, n_against): the direction seen more often."""
    least, most = F.least("was", "becomes"), F.greatest("was", "becomes")
    both = moves.groupBy("field_name", least.alias("a"), most.alias("b")).agg(
        F.sum(F.when(F.col("was") < F.col("becomes"), F.col("n")).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("was") > F.col("becomes"), F.col("n")).otherwise(0)).alias("down"),
    )
    up = F.col("up") > F.col("down")
    return both.where("up <> down").select(
        "field_name", F.when(up, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("later"),
        F.greatest("up", "down").alias("n_for"), F.least("up", "down").alias("n_against"),
    )


def _shortened(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(field_name, value, nxt): the learned order with every unbranched stretch of values that are not
    wanted jumped over, found by pointer doubling. A stretch that runs into a ring of its own ends nowhere."""
    e = edges.select("field_name", F.col("earlier").alias("value"), F.col("later").alias("nxt"))
    lone = e.groupBy("field_name", "value").agg(F.count("*").alias("n"), F.first("nxt").alias("nxt")).where("n = 1").drop("n")
    lone = lone.join(wanted, ["field_name", "value"], "left_anti")
    n, k = 1, 0
    done, (left, m) = [], cut_counted(lone, "stretch", n=F.lit(True))
    total = m["n"]
    all_ = left
    while n and 2**k <= 2 * total:
        step = left.join(all_.select("field_name", F.col("value").alias("nxt"), F.col("nxt").alias("on")), ["field_name", "nxt"], "left")
        step = step.select("field_name", "value", F.coalesce("on", "nxt").alias("nxt"), F.col("on").isNull().alias("at_end"))
        step, m = cut_counted(step, "stretch", n=~F.col("at_end"))
        done.append(step.where("at_end").drop("at_end"))
        left, n, k = step.where("not at_end").drop("at_end"), m["n"], k + 1
        all_ = left
        for d in done:
            all_ = all_.unionByName(d)
    ends = None
    for d in done:
        ends = d if ends is None else ends.unionByName(d)
    if ends is None:
        return e
    j = e.join(ends.select("field_name", F.col("value").alias("nxt"), F.col("nxt").alias("end")), ["field_name", "nxt"], "left")
    return cut(j.select("field_name", "value", F.coalesce("end", "nxt").alias("nxt")).where("value <> nxt").distinct(), "shortened")


def _reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(field_name, value, later): all that the sources (field_name, value) come before, over any values
    between; a round for each step of the longest way."""
    e = edges.select("field_name", F.col("value").alias("at"), "nxt")
    front = sources.select("field_name", "value", F.col("value").alias("at")).distinct()
    seen, n = None, 1
    while n:
        step = front.join(e, ["field_name", "at"]).where("value <> nxt").select("field_name", "value", F.col("nxt").alias("at")).distinct()
        if seen is not None:
            step = step.join(seen, ["field_name", "value", "at"], "left_anti")
        front, m = cut_counted(step, "reach", n=F.lit(True))
        n = m["n"]
        seen = front if seen is None else seen.unionByName(front)
    return seen.withColumnRenamed("at", "later")


def _partial_orders(obs: DataFrame, fields, learned: DataFrame) -> DataFrame:
    """(asset_id, field_name, id, value): the topologically latest value of the groups and fields in which
    some usable value occurs without a time only."""
    g, gv = ["asset_id", "field_name"], ["asset_id", "field_name", "value"]
    values = _long(obs, fields)
    # of every value of a group its last time and largest id, and the largest id it has without a time
    seen = values.groupBy(*gv).agg(F.max(F.when(F.col("at").isNotNull(), F.struct("at", "id"))).alias("last"), F.max(F.when(F.col("at").isNull(), F.col("id"))).alias("id"))
    without = values.where("at is null").select(*g).distinct()
    seen = cut(seen.join(without, g, "left_semi"), "untimed")
    free, m = cut_counted(seen.where("last is null").select(*gv, "id", F.lit(False).alias("timed")), "loose", n=F.lit(True))
    timed = seen.where("last is not null").join(free.select(*g).distinct(), g, "left_semi")
    last = timed.groupBy(*g).agg(F.max(F.struct("last", "value")).alias("m"))
    last = last.select(*g, F.col("m.value").alias("value"), F.col("m.last.id").alias("id"), F.lit(True).alias("timed"))
    cand = free.unionByName(last)
    members = timed.select(*gv, F.lit(True).alias("to_timed")).unionByName(free.select(*gv, F.lit(False).alias("to_timed")))
    fv = members.select("field_name", "value").distinct()
    order = _shortened(learned, fv) if m["n"] else learned.select("field_name", F.col("earlier").alias("value"), F.col("later").alias("nxt"))
    ahead = _reach(order, cand.select("field_name", "value"))
    hits = (
        cand.select(*gv, "timed").join(ahead, ["field_name", "value"])
        .join(members.withColumnRenamed("value", "later"), [*g, "later"]).where("not (timed and to_timed)")
    )
    hits = cut(hits, "hits")
    # values that come before one another lie on a cycle of majorities, which decides nothing
    back = _reach(order, hits.select("field_name", F.col("later").alias("value")))
    hits = hits.join(back.select("field_name", F.col("value").alias("later"), F.col("later").alias("value")), ["field_name", "later", "value"], "left_anti")
    behind = hits.where("not timed").groupBy(*gv).agg(F.max("to_timed").alias("behind"))
    # a value that comes before one of the group's timed values comes before the last of them too
    over = hits.where("timed").join(behind.select(*g, F.col("value").alias("later"), "behind"), [*g, "later"], "left").where("behind is null or not behind")
    beaten = behind.select(*gv).unionByName(over.select(*gv)).distinct().withColumn("beaten", F.lit(True))
    top = cand.join(beaten, gv, "left").groupBy(*g).agg(F.max(F.struct(F.col("beaten").isNull().alias("free"), F.col("timed"), F.col("id"), F.col("value"))).alias("m"))
    return top.select(*g, F.col("m.id").alias("id"), F.col("m.value").alias("value"))


def survivors(rows: DataFrame, fields=FIELDS, values: bool = True) -> DataFrame:
    """(asset_id, field_name, discovery_id, value) for every group of at least two rows.

    field_name record: the row with most usable fields, then the latest time (null lowest), then the
    largest id; its value is the number of usable fields. Any other field: the row that supplies the
    topologically latest usable value; a field without one has no row. Repeated rows and equal times
    are settled by the larger id. An empty table gives no rows."""
    obs = cut(observations(rows), "usable")  # read by each of the steps below, parsed once
    learned = cut(precedence(transitions(obs, fields)), "precedence")
    full = sum(F.col(f).isNotNull().cast("int") for f in fields)
    best = obs.groupBy("asset_id").agg(
        F.count("*").alias("n"),
        F.max(F.struct(full.alias("full"), F.col("at"), F.col("id"))).alias("record"),
        *(F.max(F.when(F.col(f).isNotNull(), F.struct("at", "id", *([F.col(f).alias("v")] if values else [])))).alias(f) for f in fields),
    ).where("n > 1")
    each = [F.struct(F.lit("record").alias("field_name"), F.col("record.id").alias("discovery_id"), F.col("record.full").cast("string").alias("value"))]
    each += [F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.id").alias("discovery_id"), (F.col(f"{f}.v") if values else F.lit(None).cast("string")).alias("value")) for f in fields]
    out = best.select("asset_id", F.inline(F.array(*each))).where("discovery_id is not null")
    latest = _partial_orders(obs, fields, learned).select("asset_id", "field_name", F.col("id").alias("l_id"), F.col("value").alias("l_value"))
    return out.join(latest, ["asset_id", "field_name"], "left").select(
        "asset_id", "field_name", F.coalesce("l_id", "discovery_id").alias("discovery_id"),
        F.when(F.col("l_id").isNull(), F.col("value")).otherwise(F.col("l_value")).alias("value"),
    )


def fused(rows: DataFrame, fields=FIELDS) -> DataFrame:
    """One built record per group: asset_id, n_usable, and for each field its best value and the row
    that supplies it."""
    s = survivors(rows, fields)
    cols = []
    for f in fields:
        mine = F.col("field_name") == f
        cols += [F.max(F.when(mine, F.col("value"))).alias(f), F.max(F.when(mine, F.col("discovery_id"))).alias(f"{f}_id")]
    return s.groupBy("asset_id").agg(F.max(F.when(F.col("field_name") == "record", F.col("discovery_id"))).alias("record_id"), *cols)
