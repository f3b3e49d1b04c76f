"""The lineage graph: bounded and unbounded traversal from many starts, layout, documents, diagrams.

Traversal is a loop of equi-joins between a frontier and the edges, one for each step, with an
anti-join against what was reached. Each step is written to the shared folder, so the plan does not
grow and a lost executor costs one step. Edges at a hub are split by the adaptive skew join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators.sequence import numbered
from metaloom.util import cut, cut_counted, loose_id


def edges(lineage: DataFrame) -> DataFrame:
    """(edge_id, source, target, kind, at): links with both ends, ids comparable."""
    e = lineage.select(F.col("id").alias("edge_id"), loose_id("source_asset_id").alias("source"), loose_id("target_asset_id").alias("target"), F.col("relationship_type").alias("kind"), F.col("discovered_at").alias("at"))
    return e.where("source is not null and target is not null")


def valid(e: DataFrame, at: datetime | Column, valid_from: str = "valid_from", valid_to: str | None = "valid_to") -> DataFrame:
    """Edges in force at a time: begun by then and not ended before it. A null end is open."""
    t = at if isinstance(at, Column) else F.lit(at)
    keep = F.col(valid_from).isNull() | (F.col(valid_from) <= t)
    if valid_to:
        keep = keep & (F.col(valid_to).isNull() | (F.col(valid_to) >= t))
    return e.where(keep)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traverse(e: DataFrame, starts: DataFrame, depth: int | None = 3, upstream: bool = False) -> tuple[DataFrame, DataFrame]:
    """((start, node, depth), (start, edge_id, depth)) from each start (a column named id).

    Every edge that leaves a node first reached before the limit is emitted once per start, with the
    node's depth plus one; cycles end, for a node is reached once. depth None goes on to the end."""
    a, b = ("target", "source") if upstream else ("source", "target")
    step = cut(e.select(F.col(a).alias("node"), F.col(b).alias("next"), "edge_id"), "links")
    frontier = cut(starts.select(loose_id("id").alias("start")).where("start is not null").distinct().select("start", F.col("start").alias("node")), "frontier")
    nodes, out, k = [frontier.withColumn("depth", F.lit(0))], [], 0
    while depth is None or k < depth:
        k += 1
        hit = frontier.join(step, "node").select("start", "next", "edge_id")  # both sides are written, so it may be read twice
        out.append(hit.select("start", "edge_id", F.lit(k).alias("depth")))
        seen = _union([n.select("start", "node") for n in nodes])
        new = hit.select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        frontier, found = cut_counted(new, "frontier", n=F.lit(True))
        if not found["n"]:
            break
        nodes.append(frontier.withColumn("depth", F.lit(k)))
    return _union(nodes), _union(out)


def impacted(e: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, impacted): the assets directly downstream."""
    return starts.select(loose_id("id").alias("source")).distinct().join(e, "source").select(F.col("source").alias("id"), F.col("target").alias("impacted")).distinct()


def layout(e: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """(id, level, x, y): level is the least number of steps from a node that nothing leads to (from all
    nodes, where there is none); what no root reaches is at level 0. x is 300 a level; y counts the nodes
    of a level in the order of their group, then id, 120 apart; the count runs over range-partitioned
    rows, so that a wide level is no single task."""
    links = cut(e.select("source", "target").distinct(), "links")
    ids = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    targets = links.where("source <> target").select(F.col("target").alias("id")).distinct()
    roots, found = cut_counted(ids.join(targets, "id", "left_anti"), "roots", n=F.lit(True))
    if not found["n"]:
        roots = ids
    level, frontier, k = [roots.withColumn("level", F.lit(0))], roots, 0
    while True:
        k += 1
        new = frontier.join(links, frontier.id == links.source).select(F.col("target").alias("id")).distinct()
        frontier, found = cut_counted(new.join(_union([x.select("id") for x in level]), "id", "left_anti"), "level", n=F.lit(True))
        if not found["n"]:
            break
        level.append(frontier.withColumn("level", F.lit(k)))
    out = ids.join(_union(level), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    if group is not None:
        out = out.join(group, "id", "left")
    else:
        out = out.withColumn("grp", F.lit(""))
    out = numbered(out.select("id", "level", F.coalesce("grp", F.lit("")).alias("grp")), ["level", "grp", "id"])
    first = out.groupBy("level").agg(F.min("no").alias("first"))
    out = out.join(first, "level")
    return out.select("id", "level", (F.col("level") * 300).alias("x"), ((F.col("no") - F.col("first")) * 120).alias("y"))


COLUMN_LINEAGE = "array<struct<source_column: string, target_column: string, transformation: string, transformation_type: string, similarity_score: double>>"


def column_lineage(lineage: DataFrame) -> DataFrame:
    """(edge_id, source, target, source_column, target_column, transformation, similarity_score)."""
    c = lineage.select(F.col("id").alias("edge_id"), loose_id("source_asset_id").alias("source"), loose_id("target_asset_id").alias("target"), F.explode(F.from_json("column_lineage", COLUMN_LINEAGE)).alias("c"))
    return c.select("edge_id", "source", "target", "c.source_column", "c.target_column", "c.transformation", "c.similarity_score")


def first_column_lineage(lineage: DataFrame) -> DataFrame:
    """Column lineage of the first edge (least id) of every pair of assets."""
    c = column_lineage(lineage)
    first = c.groupBy("source", "target").agg(F.min("edge_id").alias("edge_id"))
    return c.join(first, ["source", "target", "edge_id"], "left_semi")


def folder_prefixes(assets: DataFrame) -> DataFrame:
    """(id, folder, level): the chain of folders above every asset that has a location."""
    from metaloom.operators.catalog import document

    p = F.btrim(F.get_json_object(document("technical_metadata"), "$.location"), F.lit("/"))
    parts = F.split(p, "/")
    a = assets.select("id", parts.alias("parts")).where(F.size("parts") > 1)
    n = F.explode(F.sequence(F.lit(1), F.size("parts") - 1))
    return a.select("id", "parts", n.alias("level")).select("id", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("folder"), "level")


def asset_documents(assets: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, name, n_upstream, n_downstream, n_columns, hierarchy): what the lineage page shows for an
    asset that takes part in lineage: its direct neighbours, mapped columns and folder chain."""
    e = edges(lineage)
    up = e.groupBy(F.col("target").alias("key")).agg(F.count_distinct("source").alias("n_upstream"))
    down = e.groupBy(F.col("source").alias("key")).agg(F.count_distinct("target").alias("n_downstream"))
    cols = column_lineage(lineage).groupBy(F.col("target").alias("key")).agg(F.count("*").alias("n_columns"))
    chain = folder_prefixes(assets).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "folder"))), lambda x: x["folder"]), ">").alias("hierarchy"))
    a = assets.select("id", "name", loose_id("id").alias("key"))
    j = a.join(up, "key", "left").join(down, "key", "left").join(cols, "key", "left").where("n_upstream is not null or n_downstream is not null")
    zero = {"n_upstream": 0, "n_downstream": 0, "n_columns": 0, "hierarchy": ""}
    return j.join(chain, "id", "left").fillna(zero).select("id", "name", "n_upstream", "n_downstream", "n_columns", "hierarchy")


def lineage_nodes(e: DataFrame, assets: DataFrame, places: DataFrame) -> DataFrame:
    """(id, name, type, catalog, connector_id, is_known, level, x, y): the nodes of the lineage document, an end of an
    edge each, with its place from `layout`. Ends that are no assets keep their id as their name."""
    ids = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    a = assets.select(loose_id("id").alias("id"), "name", "type", "catalog", "connector_id").where("id is not null").groupBy("id")
    a = a.agg(F.min(F.struct("name", "type", "catalog", "connector_id")).alias("a"))
    j = ids.join(a, "id", "left").join(places, "id", "left")
    return j.select("id", F.coalesce("a.name", "id").alias("name"), "a.type", "a.catalog", "a.connector_id", F.col("a").isNotNull().alias("is_known"), "level", "x", "y")


def lineage_edges(lineage: DataFrame) -> DataFrame:
    """(source, target, n_edges, kinds, n_columns, confidence): the edges of the lineage document, a row for each two
    assets, with the kinds of relationship, the mapped columns and the best confidence."""
    n = F.coalesce(F.size(F.from_json("column_lineage", COLUMN_LINEAGE)), F.lit(0))
    e = lineage.select(loose_id("source_asset_id").alias("source"), loose_id("target_asset_id").alias("target"), "relationship_type", F.greatest(n, F.lit(0)).alias("n"), F.col("confidence_score").cast("double").alias("c"))
    g = e.where("source is not null and target is not null").groupBy("source", "target")
    return g.agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("relationship_type")), ",").alias("kinds"), F.sum("n").alias("n_columns"), F.max("c").alias("confidence"))


def node_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def diagram(e: DataFrame, form: str = "mermaid") -> DataFrame:
    """(line): the lines of a diagram, an edge a line; the caller adds head and foot (see diagram_frame).
    Lines stay rows, so a diagram of any size is written out without gathering it."""
    s, t = node_name(F.col("source")), node_name(F.col("target"))
    if form == "mermaid":
        line = F.concat(F.lit("    "), s, F.lit("["), F.col("source"), F.lit("] --> "), t, F.lit("["), F.col("target"), F.lit("]"))
    elif form == "graphviz":
        line = F.concat(F.lit('    "'), F.col("source"), F.lit('" -> "'), F.col("target"), F.lit('";'))
    else:
        line = F.to_json(F.struct(F.concat_ws("-", s, t).alias("id"), F.col("source").alias("source"), F.col("target").alias("target")))
    return e.select(line.alias("line")).distinct()


def diagram_frame(form: str) -> tuple[str, str]:
    return {"mermaid": ("graph LR", ""), "graphviz": ("digraph lineage {\n    rankdir=LR;", "}")}.get(form, ("[", "]"))
