"""Parent-child links into full hierarchies.

1. Connected components. Every node has at most one parent, so pointer jumping finds the root of
   every node: a round of two joins makes the jumps three times as long. What never finishes is caught in a cycle or hangs
   below one; the ends of its jumps are then exactly the nodes of the cycles.
2. The nodes of a component are co-located and walked depth-first without recursion, with node colours: a
   link to a grey node is the back edge of a cycle.
3. No task holds more than `piece` nodes of one component. A larger component is cut into pieces: subtrees of at
   most so many nodes, and above them bands of as many levels as give pieces of that size. Sizes and depths
   come by doubling sums, a row a node, and pieces are walked band by band; what a piece needs of all that lies
   above it is the state of the digest at its top's parent, a few bytes, so a deep chain costs no more than
   any other shape. Cyclic components need no digest and are finished by the sums alone.

A hot parent gathers nowhere: links are aggregated to one row per node before anything is joined,
and joins on the parent are split by the adaptive skew join.
"""

from __future__ import annotations

import hashlib
import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.util import arrow_map, cut, cut_counted, loose_id, tasks

OUT = "asset_id string, node_status string, root_id string, depth int, n_descendants bigint, path_md5 string, path string"


def nodes_of(links: DataFrame, parent: Column | str, child: Column | str) -> DataFrame:
    """(id, parent), one row per id at either end of a link whose ends are both non-blank. Repeated
    links count once; where a child is given several parents the smallest one is taken (`several_parents` reports
    the others)."""
    e = links.select(loose_id(parent).alias("p"), loose_id(child).alias("c")).where("p is not null and c is not null")
    both = F.array(F.struct(F.col("c").alias("id"), F.col("p").alias("parent")), F.struct(F.col("p").alias("id"), F.lit(None).cast("string").alias("parent")))
    return e.select(F.inline(both)).groupBy("id").agg(F.min("parent").alias("parent"))


def several_parents(links: DataFrame, parent: Column | str, child: Column | str) -> DataFrame:
    """(asset_id, parent_id, is_kept): the parents of every child that has more than one, and which of them counts."""
    e = links.select(loose_id(child).alias("asset_id"), loose_id(parent).alias("parent_id")).where("asset_id is not null and parent_id is not null").distinct()
    kept = e.groupBy("asset_id").agg(F.min("parent_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return e.join(kept, "asset_id").select("asset_id", "parent_id", (F.col("parent_id") == F.col("kept")).alias("is_kept"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Files sized to their rows: what is read again in every round should not be many small ones."""
    return df.coalesce(max(1, min(rows // 50_000, max(4 * tasks(df.sparkSession), rows // 2_000_000))))


def components(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, parent, comp, cyclic), (id) of all nodes on cycles). comp is the root's id, of a cyclic
    component the smallest id on its cycle."""
    # nxt: the ancestor so many steps up, three times as many each round, null when the root is known; low: the least id on the way
    first = nodes.select("id", "parent", F.col("parent").alias("nxt"), F.col("id").alias("low"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"))
    is_open = F.col("root").isNull()
    state, m = cut_counted(first, "jump", open=is_open, all=F.lit(True))
    n, steps, before = m["open"], 1, -1
    while n and not (n == before and steps >= n):
        before, steps = n, 3 * steps
        u = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("u_nxt"), F.col("low").alias("u_low"), F.col("root").alias("u_root"))
        once = state.where(is_open).join(u, "nxt").select(
            "id", "parent", F.when(F.col("u_root").isNull(), F.col("u_nxt")).alias("nxt"), F.least("low", "u_low").alias("low"), F.col("u_root").alias("root")
        )
        # rows with a root now stand beside the second jump, spread by a key of their own
        v = u.withColumnRenamed("nxt", "at")
        twice = once.withColumn("at", F.coalesce("nxt", F.concat(F.lit("\0"), "id"))).join(v, "at", "left").select(
            "id", "parent", F.when(F.col("u_root").isNull(), F.coalesce("u_nxt", "nxt")).alias("nxt"), F.least("low", "u_low").alias("low"), F.coalesce("root", "u_root").alias("root")
        )
        twice = twice.withColumn("nxt", F.when(is_open, F.col("nxt")))
        state, c = cut_counted(_few(state.where(~is_open).unionByName(twice), m["all"]), "jump", open=is_open)
        n = c["open"]
    done, left = state.where(~is_open), state.where(is_open)
    out = done.select("id", "parent", F.col("root").alias("comp"), F.lit(False).alias("cyclic"))
    ring = left.select(F.col("id").alias("nxt"), F.col("low").alias("comp"))
    out = out.unionByName(left.join(ring, "nxt").select("id", "parent", "comp", F.lit(True).alias("cyclic")))
    return out, left.select(F.col("nxt").alias("id")).distinct()


def _walk(members: list[tuple[str, str | None]], with_path: bool):
    """The rows of one component, depth-first with colours."""
    parent = dict(members)
    kids: dict[str, list[str]] = {}
    for c, p in members:
        if p is not None:
            kids.setdefault(p, []).append(c)
    tops = [c for c, p in members if p is None]
    ring: list[str] = []
    if not tops:  # climb from any node; the first link back to a grey node closes the cycle
        at, grey = members[0][0], {}
        while at not in grey:
            grey[at] = len(grey)
            at = parent[at]
        ring = [x for x, i in grey.items() if i >= grey[at]]
    on_ring = set(ring)
    root = min(ring) if ring else None
    total = len(members) - 1
    for top in ring or tops:
        status = "cycle" if ring else "tree"
        h = None if ring else hashlib.md5(top.encode())
        # entry: (id, depth, digest so far, path so far, white or grey)
        stack: list = [(top, 0, h, "" if ring else top, True)]
        size: dict[str, int] = {}
        while stack:
            x, depth, h, path, white = stack.pop()
            if white:
                stack.append((x, depth, h, path, False))
                for c in kids.get(x, ()):
                    if c in on_ring:
                        continue
                    g = None
                    if h is not None:
                        g = h.copy()
                        g.update(b">" + c.encode())
                    stack.append((c, depth + 1, g, f"{path}>{c}" if with_path and not ring else "", True))
                continue
            n = size.pop(x, 0)
            if depth:
                p = parent[x]
                size[p] = size.get(p, 0) + n + 1
            if not ring:
                yield x, status, top, depth, n, h.hexdigest(), path if with_path else None
            elif depth == 0:
                yield x, "cycle", root, 0, total, "", ""
            else:
                yield x, "below_cycle", root, depth, n, "", ""


def _grouped(df: DataFrame, walk, out: str, carry) -> DataFrame:
    """Rows of (group, ...), co-located and in order within a task, through walk(list of rows of one group)."""
    fields = [f.split(" ") for f in out.split(", ")]
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kind[t]) for n, t in fields])

    def run(batches):
        cols: list[list] = [[] for _ in fields]
        at, group = None, []

        def close():
            for row in walk(group):
                for c, v in zip(cols, row):
                    c.append(v)

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            for c in cols:
                c.clear()
            return b

        for b in batches:
            for g, *row in zip(*(x.to_pylist() for x in b.columns)):
                if g != at:
                    if group:
                        close()
                    at, group = g, []
                    if len(cols[0]) >= 20_000:
                        yield flush()
                group.append(row)
        if group:
            close()
        if cols[0]:
            yield flush()

    key, *rest = carry
    return arrow_map(df.repartition(key).sortWithinPartitions(key, "id").select(key, *rest), run, out)


#: MD5's sines and shifts.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]


class Md5:
    """MD5 whose state can be written down, so that a path's digest goes on in another task."""

    __slots__ = ("h", "n", "tail")

    def __init__(self, state: bytes | None = None):
        if state is None:
            self.h, self.n, self.tail = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), 0, b""
        else:
            *self.h, self.n = struct.unpack_from("<4IQ", state)
            self.tail = state[24:]

    def state(self) -> bytes:
        return struct.pack("<4IQ", *self.h, self.n) + self.tail

    def plus(self, more: bytes) -> Md5:
        """The digest of the text with more at its end."""
        out = Md5.__new__(Md5)
        data, out.h, out.n = self.tail + more, self.h, self.n + len(more)
        for i in range(0, len(data) - 63, 64):
            out.h = self._block(out.h, data[i : i + 64])
        out.tail = data[len(data) // 64 * 64 :]
        return out

    def hex(self) -> str:
        pad = b"\x80" + b"\0" * ((55 - self.n) % 64) + struct.pack("<Q", self.n * 8 % 2**64)
        return struct.pack("<4I", *self.plus(pad).h).hex()

    @staticmethod
    def _block(h, block):
        w = struct.unpack("<16I", block)
        a, b, c, d = h
        for i in range(64):
            if i < 16:
                f, g = b & c | ~b & d, i
            elif i < 32:
                f, g = d & b | ~d & c, (5 * i + 1) & 15
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) & 15
            else:
                f, g = c ^ (b | ~d & 0xFFFFFFFF), (7 * i) & 15
            f = (f + a + _SINES[i] + w[g]) & 0xFFFFFFFF
            a, d, c, b = d, c, b, (b + (f << _SHIFTS[i] | f >> 32 - _SHIFTS[i])) & 0xFFFFFFFF
        return tuple((x + y) & 0xFFFFFFFF for x, y in zip(h, (a, b, c, d)))


def _doubled(df: DataFrame, tag: str, up: str, sums: dict[str, Column], below: str | None = None) -> DataFrame:
    """Pointer doubling along `up` until no pointer is left; sums are columns made from a row's own and those of
    the row it points to (prefixed u_). With below, a column of partial sums over 2^k steps downwards grows too."""
    state, m = cut_counted(df, tag, n=F.col(up).isNotNull())
    while m["n"]:
        s = state
        if below:
            more = s.where(F.col(up).isNotNull()).groupBy(F.col(up).alias("id")).agg(F.sum(below).alias("more"))
            s = s.join(more, "id", "left").withColumn(below, F.col(below) + F.coalesce("more", F.lit(0))).drop("more")
        u = state.select(F.col("id").alias("at"), *(F.col(c).alias(f"u_{c}") for c in state.columns if c != "id"))
        j = s.withColumn("at", F.coalesce(up, F.concat(F.lit("\0"), "id"))).join(u, "at", "left")
        j = j.withColumns({f"n_{n}": c for n, c in sums.items()} | {f"n_{up}": F.col(f"u_{up}")})
        state, m = cut_counted(j.select(*(F.col(f"n_{c}" if c in sums or c == up else c).alias(c) for c in df.columns)), tag, n=F.col(up).isNotNull())
    return state


_PIECE = "asset_id string, path_md5 string, path string, state binary"


def _split(members: DataFrame, rings: DataFrame, piece: int, with_path: bool) -> DataFrame:
    """The rows of components larger than a piece."""
    ring = rings.select("id", F.lit(True).alias("on_ring"))
    m = members.join(ring, "id", "left").select("id", "comp", "cyclic", F.coalesce("on_ring", F.lit(False)).alias("on_ring"), F.when(F.col("on_ring").isNull(), F.col("parent")).alias("parent"))
    m = cut(m, "opened")
    plus = F.col("depth") + F.coalesce("u_depth", F.lit(0))
    s = _doubled(m.select("id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth"), F.lit(1).cast("bigint").alias("size")), "sizes", "up", {"depth": plus}, "size")
    m = cut(m.join(s.select("id", "depth", "size"), "id").withColumn("crown", F.col("size") > piece), "sized")
    total = m.where("cyclic").groupBy("comp").agg(F.sum(F.lit(1)).alias("n_comp"))
    out = m.where("cyclic").join(total, "comp").select(
        F.col("id").alias("asset_id"), F.when(F.col("on_ring"), "cycle").otherwise("below_cycle").alias("node_status"), F.col("comp").alias("root_id"), "depth",
        F.when(F.col("on_ring"), F.col("n_comp") - 1).otherwise(F.col("size") - 1).alias("n_descendants"), F.lit("").alias("path_md5"), F.lit("").alias("path"),
    )
    t = m.where("not cyclic")
    wide = t.where("crown").groupBy("comp", "depth").agg(F.count("*").alias("n")).groupBy("comp").agg(F.greatest(F.lit(1), F.floor(piece / F.max("n"))).cast("int").alias("levels"))
    above = t.where("crown").select(F.col("id").alias("parent"), F.lit(True).alias("under_crown"))
    t = t.join(wide, "comp").withColumn("at", F.coalesce("parent", F.concat(F.lit("\0"), "id"))).join(above.withColumnRenamed("parent", "at"), "at", "left")
    top = F.when(F.col("crown"), F.col("depth") % F.col("levels") == 0).otherwise(F.coalesce("under_crown", F.lit(False)))
    band = F.when(F.col("crown"), F.floor(F.col("depth") / F.col("levels"))).otherwise(F.floor((F.col("depth") - 1) / F.col("levels")) + 1).cast("int")
    p = t.select("id", F.when(~top, F.col("parent")).alias("up"), F.when(top, F.col("id")).alias("piece"), F.when(top, F.col("parent")).alias("entry"), F.when(top, band).alias("band"))
    p = _doubled(p, "pieces", "up", {c: F.coalesce(c, f"u_{c}") for c in ("piece", "entry", "band")})
    t = cut(t.select("id", "parent", "comp", "depth", "size", "crown").join(p.drop("up"), "id"), "pieces")
    bands = t.agg(F.max("band")).first()[0]

    def walk(rows):
        kids: dict = {}
        for r in rows:
            kids.setdefault(r[1] if r[0] != r[4] else None, []).append(r)
        state, path = rows[0][5], rows[0][6]
        stack = [(r, Md5(state), path) for r in kids[None]]
        while stack:
            (x, _, crown, _, _, _, _), h, path = stack.pop()
            h = h.plus((b">" if h.n else b"") + x.encode())
            path = (f"{path}>{x}" if path else x) if with_path else None
            yield x, h.hex(), path, h.state() if crown else None
            stack += [(r, h, path) for r in kids.get(x, ())]

    states, walked = None, None
    for b in range((bands if bands is not None else -1) + 1):
        n = t.where(F.col("band") == b)
        if states is None:
            n = n.withColumn("state", F.lit(None).cast("binary")).withColumn("above", F.lit(None).cast("string"))
        else:
            n = n.join(states, "entry", "left")
        got = cut(_grouped(n.withColumn("group", F.col("piece")), walk, _PIECE, ("group", "id", "parent", "crown", "depth", "piece", "state", "above")), "walked")
        states = got.where("state is not null").select(F.col("asset_id").alias("entry"), "state", F.col("path").alias("above"))
        walked = got if walked is None else walked.unionByName(got)
    if walked is None:
        return out
    return out.unionByName(
        t.withColumnRenamed("id", "asset_id").join(walked, "asset_id").select(
            "asset_id", F.lit("tree").alias("node_status"), F.col("comp").alias("root_id"), "depth", (F.col("size") - 1).alias("n_descendants"), "path_md5", "path",
        )
    )


def hierarchy(links: DataFrame, parent: Column | str, child: Column | str, piece: int = 250_000, with_path: bool = True) -> DataFrame:
    """(asset_id, node_status, root_id, depth, n_descendants, path_md5, path), one row per id.

    tree: depth counts from the top ancestor; cycle: the id is its own ancestor, depth 0, root the
    smallest id of the cycle; below_cycle: depth counts steps to the cycle. The path of the last two
    is empty. Null and blank ends make a link void; an empty table gives no rows. piece is the number of nodes
    of one component that a task may hold; it does not change the rows."""
    found, rings = components(nodes_of(links, parent, child))
    found = cut(found, "components")
    big, m = cut_counted(found.groupBy("comp").count().where(F.col("count") > piece).select("comp"), "large", n=F.lit(True))
    whole = found if not m["n"] else found.join(big, "comp", "left_anti")
    out = _grouped(whole, lambda rows: _walk(rows, with_path), OUT, ("comp", "id", "parent"))
    if m["n"]:
        out = out.unionByName(_split(found.join(big, "comp", "left_semi"), rings, piece, with_path))
    return out


def cycles(links: DataFrame, parent: Column | str, child: Column | str) -> DataFrame:
    """(cycle_id, n_nodes, back_source, back_target): every cycle with its smallest id, its number of nodes and the
    link that closes it when it is walked from that id."""
    nodes = nodes_of(links, parent, child)
    c = hierarchy(links, parent, child, with_path=False).where("node_status = 'cycle'").groupBy("root_id").agg(F.count("*").alias("n_nodes"))
    return c.join(nodes.withColumnRenamed("id", "root_id"), "root_id").select(F.col("root_id").alias("cycle_id"), "n_nodes", F.col("parent").alias("back_source"), F.col("root_id").alias("back_target"))


def folder_links(lineage: DataFrame) -> DataFrame:
    return lineage.where(F.col("relationship_type") == "folder_hierarchy")


def _below(paths: DataFrame) -> DataFrame:
    """(asset_id, descendant_id, steps), read off the paths of trees."""
    p = paths.where("depth > 0").select("asset_id", "depth", F.split("path", ">").alias("up"))
    return p.select(F.posexplode(F.slice("up", 1, F.col("depth"))).alias("i", "ancestor"), "asset_id", "depth").select(
        F.col("ancestor").alias("asset_id"), F.col("asset_id").alias("descendant_id"), (F.col("depth") - F.col("i")).alias("steps")
    )


def descendants(links: DataFrame, parent: str, child: str, piece: int = 250_000, trees_only: bool = False) -> DataFrame:
    """(asset_id, descendant_id, steps), every pair of a node and another one reachable downwards, as many
    for each node as its n_descendants; steps are the fewest. The rows are read off the paths, so their
    number is the sum of all depths, and in a component with a cycle every member under every node of the
    cycle. trees_only leaves the latter components out.

    A cycle is opened above its smallest id. That leaves a tree whose pairs are read off as elsewhere; the
    pairs missing then are those of cycle nodes and what is reached only over the opened link."""
    h = hierarchy(links, parent, child, piece)
    trees = _below(h.where("node_status = 'tree'"))
    if trees_only:
        return trees
    cyclic, m = cut_counted(h.where("node_status <> 'tree'").select(F.col("asset_id").alias("id"), "node_status", "root_id", F.col("depth").alias("under")), "cyclic", n=F.lit(True))
    if not m["n"]:
        return trees
    opened = nodes_of(links, parent, child).join(cyclic, "id").where("id <> root_id").select("parent", "id")
    paths = cut(hierarchy(opened, "parent", "id", piece).select("asset_id", "depth", "path"), "opened")
    at = paths.select(F.col("asset_id").alias("id"), "depth").join(cyclic, "id")
    # place: from the smallest id along the cycle; a member's own is that of the cycle node above it
    ring = at.where("node_status = 'cycle'").select("root_id", F.col("id").alias("asset_id"), F.col("depth").alias("place"))
    ring = ring.join(ring.groupBy("root_id").agg(F.count("*").cast("int").alias("n")), "root_id")
    around = at.select("root_id", F.col("id").alias("descendant_id"), "depth", (F.col("depth") - F.col("under")).alias("own"))
    around = around.join(ring, "root_id").where("place > own").select("asset_id", "descendant_id", (F.col("n") - F.col("place") + F.col("depth")).alias("steps"))
    return trees.unionByName(_below(paths)).unionByName(around)
