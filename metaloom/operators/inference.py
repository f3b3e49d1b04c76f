"""Lineage inferred from names, columns, folders and jobs.

Where many assets agree on a key (a folder, a name, a job), the pairs among them are not listed: each
asset gets its class and its number of links, or classes are linked with their sizes.

Names are compared once for each distinct pair: rules are column expressions, only the ratio of matching
blocks is computed in Arrow batches. New links by similar columns are found by search: a stated set of query
assets against all assets, in blocks, through an index from column name to the assets of a block, so an asset is looked
at only where it has a column that a query's column is similar to.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.paths import folder_of
from metaloom.operators.blocks import BATCH, Targets, compare, overlaps, similar
from metaloom.operators.catalog import asset_columns, document
from metaloom.util import arrow_map, cut, loose_id

#: What a name may begin or end with without saying what it holds, in this order (fixed values).
BEFORE = r"^(tbl_)?(dim_)?(fact_)?(stg_)?(raw_)?(src_)?"
AFTER = r"(_fk)?(_pk)?(_key)?(_id)?$"
#: What an aggregate's name holds (fixed values).
AGGREGATE = "sum_|avg_|count_|max_|min_|total_"
#: Similarities by rule, the least similarity of a match, and the weights of a match (fixed values).
SQUEEZED, BARE, WITHIN, LEAST = 0.95, 0.9, 0.85, 0.6
SHARE, MEAN, BONUS, CEILING = 0.6, 0.4, 0.1, 0.95


def squeezed(c: Column) -> Column:
    """A name in lower case without blanks, underscores and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\-\s]", "")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BEFORE, ""), AFTER, "")


def scored_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, similarity, kind): the distinct pairs of two name columns.

    similarity is 1 for names equal without case and blanks around, .95 without separators too; else the ratio of
    matching blocks, at least .9 where they agree without common affixes and .85 where one holds the other; 0
    for null and empty names. kind is aggregate, rename or pass_through, the step that leads from a to b."""
    import pyarrow as pa

    p = pairs.select(a, b).distinct().select(a, b, F.trim(F.lower(a)).alias("x"), F.trim(F.lower(b)).alias("y"))

    def run(batches):
        for batch in batches:
            ratio = [1.0 if x == y else SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=[*batch.schema.names, "ratio"])

    r = arrow_map(p, run, f"`{a}` string, `{b}` string, x string, y string, ratio double")
    u, v = squeezed(F.col("x")), squeezed(F.col("y"))
    rule = (
        F.when(F.col("x") == F.col("y"), 1.0).when(u == v, SQUEEZED)
        .when(_bare(F.col("x")) == _bare(F.col("y")), F.greatest("ratio", F.lit(BARE)))
        .when(u.contains(v) | v.contains(u), F.greatest("ratio", F.lit(WITHIN))).otherwise(F.col("ratio"))
    )
    empty = F.coalesce(F.col(a), F.lit("")).isin("") | F.coalesce(F.col(b), F.lit("")).isin("")
    s, t = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    aggregate = t.rlike(AGGREGATE) & (t.contains(s) | (F.regexp_replace(t, AGGREGATE, "") == s))
    kind = F.when(aggregate, "aggregate").when((s != t) & (F.col("ratio") > 0.7), "rename").otherwise("pass_through")
    return r.select(a, b, F.when(empty, 0.0).otherwise(rule).alias("similarity"), kind.alias("kind"))


def _written(d: DataFrame, name: str) -> list[Column]:
    """What names are compared by: text, squeezed, bare."""
    x = F.trim(F.lower(d[name]))
    return [x.alias("x"), squeezed(x).alias("u"), _bare(x).alias("bare")]


def _names(t):
    """The distinct names of a block, as `blocks.similar` takes them, and the rows of each."""
    rows: dict = {}
    for i, n in enumerate(zip(*(t[c].to_pylist() for c in ("x", "u", "bare")))):
        rows.setdefault(n, []).append(i)
    return list(rows), list(rows.values())


def _alike(l, r, least: float):
    """(i, j, similarity) of the rows of two blocks whose names are so similar."""
    (x, of_x), (y, of_y) = _names(l), _names(r)
    i, j, s = similar(x, y, least, SQUEEZED, BARE, WITHIN)
    if len(x) == l.num_rows and len(y) == r.num_rows:
        return i, j, s
    both = [(p, q, z) for a, b, z in zip(i.tolist(), j.tolist(), s.tolist()) for p in of_x[a] for q in of_y[b]]
    return np.array([p for p, _, _ in both], np.int64), np.array([q for _, q, _ in both], np.int64), np.array([z for _, _, z in both], np.float64)


def similar_names(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) of all distinct names of column a of left and b of right that are so similar. Every two names
    are compared, in blocks; the ratio is computed where bounds on it leave a chance."""
    import pyarrow as pa

    x, y = left.select("a").where("a <> ''").distinct(), right.select("b").where("b <> ''").distinct()

    def fn(l, r):
        i, j, s = _alike(l, r, least)
        if len(i):
            yield pa.RecordBatch.from_arrays([l["a"].take(pa.array(i)), r["b"].take(pa.array(j)), pa.array(s)], names=["a", "b", "similarity"])

    return compare(cut(x.select("a", *_written(x, "a")), "names"), cut(y.select("b", *_written(y, "b")), "names"), fn, "a string, b string, similarity double")


def named_columns(assets: DataFrame) -> DataFrame:
    """(key, pos, name): the columns of each asset that have a name."""
    return asset_columns(assets).select(loose_id("asset_id").alias("key"), "pos", "name").where("key is not null and name <> ''")


#: One pass over the similar columns of a pair, by the source's place and falling similarity: each source column
#: takes the best target name that none before it took.
_TAKE = """aggregate(array_sort(collect_list(struct(s_pos, -similarity AS worse, t_pos, t_name))),
  named_struct('done', -1, 'used', cast(array() AS array<string>), 'total', cast(0 AS double)),
  (a, e) -> if(e.s_pos = a.done OR array_contains(a.used, e.t_name), a, named_struct('done', e.s_pos, 'used', array_append(a.used, e.t_name), 'total', a.total - e.worse)))"""


def _matched(similar: DataFrame, sizes: DataFrame, least_ratio: float) -> DataFrame:
    """(source, target, n_matches, confidence) from rows of (source, target, s_pos, t_pos, t_name, similarity).
    confidence is .6 of the share of columns matched and .4 of their mean similarity, .1 more (up to .95) from
    a share of least_ratio on."""
    g = similar.groupBy("source", "target").agg(F.expr(_TAKE).alias("m"))
    g = g.join(sizes.select(F.col("key").alias("source"), F.col("n").alias("ns")), "source").join(sizes.select(F.col("key").alias("target"), F.col("n").alias("nt")), "target")
    n = F.size("m.used")
    share = n / F.greatest("ns", "nt")
    plain = SHARE * share + MEAN * F.col("m.total") / n
    return g.select("source", "target", n.alias("n_matches"), F.when(share >= least_ratio, F.least(F.lit(CEILING), plain + BONUS)).otherwise(plain).alias("confidence"))


def matched_assets(candidates: DataFrame, assets: DataFrame, least: float = 0.65, least_ratio: float = 0.4, cap: float = 0.85) -> DataFrame:
    """(source, target, n_matches, confidence) of the candidate pairs (source, target) whose columns match
    with a confidence of `least` at least, capped. Pairs of assets without columns do not match."""
    c = cut(named_columns(assets), "columns")
    p = candidates.select("source", "target").distinct().where("source <> target")
    s = c.select(F.col("key").alias("source"), F.col("pos").alias("s_pos"), F.col("name").alias("s_name"))
    t = c.select(F.col("key").alias("target"), F.col("pos").alias("t_pos"), F.col("name").alias("t_name"))
    both = p.join(s, "source").join(t, "target")
    alike = scored_pairs(both, "s_name", "t_name").where(F.col("similarity") >= LEAST).drop("kind")
    m = _matched(both.join(alike, ["s_name", "t_name"]), c.groupBy("key").agg(F.count("*").alias("n")), least_ratio)
    return m.where(F.col("confidence") >= least).withColumn("confidence", F.round(F.least("confidence", F.lit(cap)), 6))


def _columns(c: DataFrame) -> DataFrame:
    """(key, columns): the places and names of each asset's columns."""
    return c.groupBy("key").agg(F.collect_list(F.struct("pos", "name")).alias("columns"))


def _columns_alike(c: DataFrame, alike: DataFrame) -> DataFrame:
    """(key, columns): the place of each asset's columns and the names (b) similar to theirs (a)."""
    by = alike.groupBy(F.col("a").alias("name")).agg(F.collect_list(F.struct("b", "similarity")).alias("alike"))
    return c.join(by, "name").groupBy("key").agg(F.collect_list(F.struct("pos", "alike")).alias("columns"))


def _confidence(least_ratio: float) -> Column:
    """Of a pair with n matches of total similarity, of ns and nt columns; 0 without a match. See `_matched`."""
    share = F.col("n") / F.greatest("ns", "nt")
    plain = SHARE * share + MEAN * F.col("total") / F.col("n")
    return F.when(F.col("n") > 0, F.when(share >= least_ratio, F.least(F.lit(CEILING), plain + BONUS)).otherwise(plain)).otherwise(0.0)


def search_columns(queries: DataFrame, assets: DataFrame, across: bool = False, least: float = 0.65, least_ratio: float = 0.4, cap: float = 0.85) -> DataFrame:
    """(source, target, n_matches, confidence): all assets whose columns match those of a query asset, of the
    query's connector, or with across of other platforms only. queries and assets have id, connector_id and
    columns; a query is no match of itself."""
    import pyarrow as pa

    c, q = cut(named_columns(assets), "columns"), cut(named_columns(queries), "queries")
    alike = similar_names(q.select(F.col("name").alias("a")), c.select(F.col("name").alias("b")))
    a, b = _scopes(assets, across), _scopes(queries, across)
    n = lambda d, of: d.groupBy("key").agg(F.count("*").alias("n")).join(of, "key").select("key", (F.col("n") * F.size("scopes")).alias("n"))
    sizes = cut(n(c, a).unionByName(n(q, b)).groupBy("key").agg(F.max("n").alias("n")), "sizes")
    l = _columns_alike(q, alike).join(b, "key").join(sizes, "key").toDF("source", "columns", "scopes", "ns")
    r = _columns(c).join(a, "key").join(sizes, "key").toDF("target", "columns", "scopes", "nt")

    def fn(l, r):
        targets, ids, nt = Targets(r["columns"].to_pylist()), np.array(r["target"].to_pylist(), object), r["nt"].to_numpy()
        codes: dict = {}
        scope = np.array([codes.setdefault(frozenset(x), len(codes)) for x in r["scopes"].to_pylist()], np.int32)
        found, size = [], 0
        for k, (key, columns, of, ns) in enumerate(zip(*(l[x].to_pylist() for x in ("source", "columns", "scopes", "ns")))):
            fits = np.array([len(x.union(of)) > 1 if across else not x.isdisjoint(of) for x in codes])
            m, total = targets.match(columns)
            j = np.flatnonzero((m > 0) & fits[scope])
            share = m[j] / np.maximum(nt[j], ns)
            plain = SHARE * share + MEAN * total[j] / m[j]
            score = np.where(share >= least_ratio, np.minimum(CEILING, plain + BONUS), plain)
            j = j[(score >= least - 1e-9) & (ids[j] != key)]  # the exact bound is kept below
            found.append((np.full(len(j), k), j, m[j], total[j]))
            size += len(j)
            if size >= BATCH:
                yield batch(l, r, found)
                found, size = [], 0
        if size:
            yield batch(l, r, found)

    def batch(l, r, found):
        i, j, m, total = (pa.array(np.concatenate(x)) for x in zip(*found))
        return pa.RecordBatch.from_arrays([l["source"].take(i), r["target"].take(j), m, total, l["ns"].take(i), r["nt"].take(j)], names=["source", "target", "n", "total", "ns", "nt"])

    m = compare(cut(l, "sources"), cut(r, "targets"), fn, "source string, target string, n int, total double, ns bigint, nt bigint")
    m = m.select("source", "target", F.col("n").alias("n_matches"), _confidence(least_ratio).alias("confidence"))
    return m.where(F.col("confidence") >= least).withColumn("confidence", F.round(F.least("confidence", F.lit(cap)), 6))


def _scopes(assets: DataFrame, across: bool) -> DataFrame:
    """(key, scopes): the connector of each asset, or with across its platform; several where ids agree."""
    c = platform(F.col("connector_id")) if across else F.col("connector_id")
    return assets.select(loose_id("id").alias("key"), F.coalesce(c, F.lit("unknown")).alias("scope")).where("key is not null").groupBy("key").agg(F.collect_set("scope").alias("scopes"))


def search_names(queries: DataFrame, assets: DataFrame, least: float = 0.7) -> DataFrame:
    """(source, target, similarity, confidence): assets without columns of the query's connector whose name is so
    similar (.65), for queries without columns."""
    bare = lambda d: d.select(loose_id("id").alias("key"), "connector_id", "name").join(named_columns(d).select("key").distinct(), "key", "left_anti").where("key is not null and name <> ''")
    q, a = cut(bare(queries), "queries"), cut(bare(assets), "nameless")
    alike = similar_names(q.select(F.col("name").alias("a")), a.select(F.col("name").alias("b")), least)
    j = q.select(F.col("key").alias("source"), "connector_id", F.col("name").alias("a")).join(alike, "a")
    j = j.join(a.select(F.col("key").alias("target"), "connector_id", F.col("name").alias("b")), ["b", "connector_id"]).where("source <> target")
    return j.select("source", "target", F.round("similarity", 6).alias("similarity"), F.lit(0.65).alias("confidence"))


def search_files(tables: DataFrame, files: DataFrame, least: float = 0.7, cap: float = 0.9) -> DataFrame:
    """(table_id, file_id, direction, confidence): files that a table is exported to or loaded from. Names without
    schema, folder and extension must be equal (.9), hold one another (.75) or be similar (.7 at least, times .9);
    matching columns (times .95) may raise the confidence. Files named so are imports, all others exports."""
    import pyarrow as pa

    t = tables.select(loose_id("id").alias("table_id"), F.substring_index("name", ".", -1).alias("a")).where("table_id is not null")
    text = F.lower(F.concat_ws(" ", F.get_json_object(document("operational_metadata"), "$.path"), "name"))
    f = files.select(loose_id("id").alias("file_id"), F.substring_index(F.substring_index("name", "/", -1), ".", 1).alias("b"), text.alias("text")).where("file_id is not null")
    export, load = F.col("text").rlike("export|dump|backup|extract"), F.col("text").rlike("import|load|ingest|input")
    f = f.where("b <> ''").select("file_id", "b", F.when(~export & load, "file_to_table").otherwise("table_to_file").alias("direction"))
    t, f = cut(t.where("a <> ''"), "tables"), cut(f, "files")
    both = ["id", "columns"]
    c = named_columns(tables.select(*both).unionByName(files.select(*both)))
    of = lambda d, k: cut(d.select(F.col(k).alias("key")).distinct().join(c, "key"), "columns")
    s, g = of(t, "table_id"), of(f, "file_id")
    alike = similar_names(s.select(F.col("name").alias("a")), g.select(F.col("name").alias("b")))
    sizes = lambda d, n: d.groupBy("key").agg(F.count("*").alias(n))
    s, g = _columns_alike(s, alike).join(sizes(s, "ns"), "key"), _columns(g).join(sizes(g, "nt"), "key")
    l = t.join(s.withColumnRenamed("key", "table_id"), "table_id", "left").select("table_id", *_written(t, "a"), "columns", "ns")
    r = f.join(g.withColumnRenamed("key", "file_id"), "file_id", "left").select("file_id", *_written(f, "b"), "columns", "nt", "direction")

    def fn(l, r):
        i, j, score = _alike(l, r, least)
        if not len(i):
            return
        u, v = l["u"].to_pylist(), r["u"].to_pylist()
        by_name = np.array([0.9 if u[p] == v[q] else 0.75 if u[p] in v[q] or v[q] in u[p] else z * 0.9 for p, q, z in zip(i.tolist(), j.tolist(), score.tolist())])
        n, total = np.zeros(len(i), np.int32), np.zeros(len(i))
        targets, keys, columns, ids = Targets(r["columns"].to_pylist()), l["table_id"].to_pylist(), l["columns"].to_pylist(), np.array(r["file_id"].to_pylist(), object)
        order = np.argsort(i, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            p = int(i[at[0]])
            if columns[p]:
                m, z = targets.match(columns[p])
                n[at], total[at] = np.where(ids[j[at]] == keys[p], 0, m[j[at]]), z[j[at]]
        i, j = pa.array(i), pa.array(j)
        yield pa.RecordBatch.from_arrays([l["table_id"].take(i), r["file_id"].take(j), r["direction"].take(j), pa.array(by_name), pa.array(n), pa.array(total), l["ns"].take(i), r["nt"].take(j)], names=["table_id", "file_id", "direction", "by_name", "n", "total", "ns", "nt"])

    m = compare(cut(l, "tables"), cut(r, "files"), fn, "table_id string, file_id string, direction string, by_name double, n int, total double, ns bigint, nt bigint")
    c = F.greatest("by_name", F.round(F.least(_confidence(0.3), F.lit(1.0)), 6) * 0.95)
    return m.where(c >= least).select("table_id", "file_id", "direction", F.round(F.least(c, F.lit(cap)), 6).alias("confidence"))


def shared_columns(candidates: DataFrame, assets: DataFrame, least: int = 2) -> DataFrame:
    """(source, target, n_shared, confidence) of candidate pairs that share at least two columns by name
    and type: .7, .05 more for each further one up to .85."""
    c = asset_columns(assets).select(loose_id("asset_id").alias("key"), F.lower("name").alias("name"), F.lower("type").alias("type")).distinct()
    p = candidates.select("source", "target").distinct().where("source <> target")
    j = p.join(c.withColumnRenamed("key", "source"), "source").join(c.withColumnRenamed("key", "target"), ["target", "name", "type"])
    g = j.groupBy("source", "target").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)
    return g.withColumn("confidence", F.round(F.least(F.lit(0.85), 0.7 + 0.05 * (F.col("n_shared") - least)), 2))


def schema_links(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """(source_schema, target_schema, n_sources, n_targets, n_links): every asset of the one schema (catalog) leads
    to every asset of the other. The pairs are not listed: memberships are the assets' own catalogs."""
    n = assets.where("catalog <> ''").groupBy("catalog").agg(F.count("*").alias("n"))
    r = requests.select("source_schema", "target_schema").distinct()
    j = r.join(n.select(F.col("catalog").alias("source_schema"), F.col("n").alias("n_sources")), "source_schema").join(n.select(F.col("catalog").alias("target_schema"), F.col("n").alias("n_targets")), "target_schema")
    return j.select("source_schema", "target_schema", "n_sources", "n_targets", (F.col("n_sources") * F.col("n_targets")).alias("n_links"))


def _column_sets(assets: DataFrame) -> DataFrame:
    """(key, pairs): the distinct (name, type) of an asset without case, sorted."""
    c = asset_columns(assets).select(loose_id("asset_id").alias("key"), F.struct(F.lower("name").alias("name"), F.lower("type").alias("type")).alias("x"))
    return c.where("key is not null and x.type is not null").groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("pairs"))


def column_classes(assets: DataFrame) -> DataFrame:
    """(key, class_id, pairs): assets by their set of (name, type) without case; class_id is the smallest
    key with the set. Columns without a type share nothing and are left out."""
    a = _column_sets(assets)
    return a.join(a.groupBy("pairs").agg(F.min("key").alias("class_id")), "pairs").select("key", "class_id", "pairs")


def shared_classes(assets: DataFrame, least: int = 2) -> DataFrame:
    """(class_a, class_b, n_shared, confidence), class_a <= class_b: all classes of `column_classes` that share
    at least so many columns, found by an index over (name, type). Every member of the one is related to
    every member of the other, both ways; class_a = class_b where a class has several members."""
    text = lambda x: F.concat(F.length(x["name"]).cast("string"), F.lit(":"), x["name"], x["type"])
    c = _column_sets(assets).groupBy("pairs").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    g = cut(c.select("key", F.transform("pairs", text).alias("items"), "n"), "classes")
    across = overlaps(g.select("key", "items"), max(1, least)).toDF("class_a", "class_b", "n_shared")
    inside = g.where("n > 1").select(F.col("key").alias("class_a"), F.col("key").alias("class_b"), F.size("items").cast("bigint").alias("n_shared")).where(F.col("n_shared") >= least)
    more = F.col("n_shared") - least  # four values, so no row is rounded
    return across.unionByName(inside).withColumn("confidence", F.when(more == 0, 0.7).when(more == 1, 0.75).when(more == 2, 0.8).otherwise(0.85))


def located(assets: DataFrame) -> DataFrame:
    """(id, container, folder, file, depth): assets with a location."""
    t = document("technical_metadata")
    path = F.btrim(F.get_json_object(t, "$.location"), F.lit("/"))
    a = assets.select("id", "connector_id", F.coalesce(F.get_json_object(t, "$.container"), F.get_json_object(t, "$.bucket"), "catalog").alias("container"), path.alias("path")).where("path <> ''")
    folder = folder_of(F.col("path"))
    return a.select("id", "connector_id", "container", folder.alias("folder"), F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/"))).alias("depth"))


def folder_edges(assets: DataFrame) -> DataFrame:
    """(connector_id, container, parent_folder, child_folder, n_parents, n_children, confidence): folders
    whose parent folder holds assets too. Every asset of the one leads to every asset of the other; the
    memberships are in `located`."""
    f = located(assets).groupBy("connector_id", "container", "folder").agg(F.count("*").alias("n"))
    child = f.where("folder <> ''").select("connector_id", "container", folder_of(F.col("folder")).alias("parent_folder"), F.col("folder").alias("child_folder"), F.col("n").alias("n_children"))
    parent = f.select("connector_id", F.col("container").alias("p_container"), F.col("folder").alias("parent_folder"), F.col("n").alias("n_parents"))
    j = child.join(parent, ["connector_id", "parent_folder"]).where(F.col("container").eqNullSafe(F.col("p_container")))
    return j.select("connector_id", "container", "parent_folder", "child_folder", "n_parents", "n_children", F.lit(0.7).alias("confidence"))


def schema_edges(assets: DataFrame) -> DataFrame:
    """(connector_id, schema, n_tables, n_views, n_links, confidence): in each schema, tables lead to views."""
    g = assets.where(F.col("type").isin("table", "view")).groupBy("connector_id", F.col("catalog").alias("schema")).agg(F.count_if(F.col("type") == "table").alias("n_tables"), F.count_if(F.col("type") == "view").alias("n_views"))
    return g.where("n_tables > 0 and n_views > 0").withColumn("n_links", F.col("n_tables") * F.col("n_views")).withColumn("confidence", F.lit(0.6))


#: Naming patterns, tried in order: pattern, kind (fixed values).
NAMING = (
    (r"(?i)^(.+?)_(raw|staging|stg|temp|tmp)\.(.+)", "etl_pipeline"),
    (r"(?i)^(.+?)_(input|source)\.(.+)", "etl_pipeline"),
    (r"^(.+?)_(\d{8})\.(.+)", "date_partition"),
    (r"(?i)^(.+?)_(backup|archive)\.(.+)", "backup_relationship"),
)
SOURCE_WORDS = "raw|staging|stg|input|source|backup|archive"
TARGET_WORDS = "processed|final|output|target|result"


def naming_groups(assets: DataFrame, patterns=NAMING) -> DataFrame:
    """(id, connector_id, base, kind, role, n_sources, n_targets, n_links, confidence): assets whose names follow
    one pattern with one base, with their role in the group. With sources and targets each source leads
    to each target (.8); else every two assets are related (.75). Single assets are left out."""
    tried = F.array_compact(F.array(*(F.when(F.col("name").rlike(p), F.struct(F.lower(F.regexp_extract("name", p, 1)).alias("base"), F.lit(k).alias("kind"))) for p, k in patterns)))
    low = F.lower("name")
    role = F.when(low.rlike(SOURCE_WORDS), "source").when(low.rlike(TARGET_WORDS), "target").otherwise("member")
    a = assets.select("id", "connector_id", F.explode(F.array_distinct(tried)).alias("x"), role.alias("role")).select("id", "connector_id", "x.base", "x.kind", "role")
    g = a.groupBy("connector_id", "base", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "source").alias("n_sources"), F.count_if(F.col("role") == "target").alias("n_targets")).where("n > 1")
    directed = (F.col("n_sources") > 0) & (F.col("n_targets") > 0)
    g = g.withColumn("n_links", F.when(directed, F.col("n_sources") * F.col("n_targets")).otherwise((F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))).withColumn("confidence", F.when(directed, 0.8).otherwise(0.75))
    return a.join(g.drop("n"), ["connector_id", "base", "kind"]).select("id", "connector_id", "base", "kind", "role", "n_sources", "n_targets", "n_links", "confidence")


def plain_name(c: Column, numbered: bool = False) -> Column:
    """A name for comparison between platforms: no extension, no separators, lower case; with numbered
    also without the number at its end."""
    p = F.regexp_replace(F.regexp_replace(F.lower(c), r"\.[a-z0-9]+$", ""), r"[^\p{L}\p{N}]", "")
    return F.regexp_replace(p, "[0-9]+$", "") if numbered else p


def platform(c: Column) -> Column:
    """The platform of a connector: the text before the first underscore."""
    return F.substring_index(c, "_", 1)


def same_name_across(assets: DataFrame, numbered: bool = False) -> DataFrame:
    """(id, class_id, platform, n_links, confidence): assets of one plain name on several platforms. class_id is the
    smallest id of the name; n_links counts the assets of the name on other platforms."""
    a = assets.select("id", plain_name(F.col("name"), numbered).alias("plain"), platform(F.col("connector_id")).alias("platform")).where("plain <> '' and platform is not null")
    per = a.groupBy("plain", "platform").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    total = per.groupBy("plain").agg(F.sum("n").alias("total"), F.count("*").alias("platforms"), F.min("first").alias("class_id")).where("platforms > 1")
    j = a.join(per.join(total, "plain").select("plain", "platform", "class_id", (F.col("total") - F.col("n")).alias("n_links")), ["plain", "platform"])
    return j.select("id", "class_id", "platform", "n_links", F.lit(0.75).alias("confidence"))


def table_and_file(assets: DataFrame, numbered: bool = False) -> DataFrame:
    """(table_id, n_files, first_file, direction, confidence): database tables and the files that share
    their plain name (.9), a row a table. Files in an export folder or named so are fed by the table,
    all others feed it."""
    a = assets.select("id", plain_name(F.col("name"), numbered).alias("plain"), "connector_id", F.lower(F.concat_ws(" ", "id", "name")).alias("text")).where("plain <> ''")
    files = a.where(~F.col("connector_id").startswith("oracle")).groupBy("plain").agg(F.count("*").alias("n_files"), F.min("id").alias("first_file"), F.max(F.col("text").rlike("export|extract|dump")).alias("out"))
    t = a.where(F.col("connector_id").startswith("oracle")).select(F.col("id").alias("table_id"), "plain")
    return t.join(files, "plain").select("table_id", "n_files", "first_file", F.when(F.col("out"), "table_to_file").otherwise("file_to_table").alias("direction"), F.lit(0.9).alias("confidence"))


def job_links(lineage: DataFrame) -> DataFrame:
    """(source_job_id, n_inputs, n_outputs, n_links, confidence): what each job reads leads to what it
    writes (.8). Jobs are aggregated before the shuffle."""
    e = lineage.select("source_job_id", loose_id("source_asset_id").alias("s"), loose_id("target_asset_id").alias("t")).where("source_job_id is not null and s is not null and t is not null")
    ends = F.array(F.struct(F.col("s").alias("a"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("t").alias("a"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    one = e.select("source_job_id", F.inline(ends)).groupBy("source_job_id", "a").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    g = one.groupBy("source_job_id").agg(F.sum("i").alias("n_inputs"), F.sum("o").alias("n_outputs"), F.count_if((F.col("i") == 1) & (F.col("o") == 1)).alias("both"))
    return g.select("source_job_id", "n_inputs", "n_outputs", (F.col("n_inputs") * F.col("n_outputs") - F.col("both")).alias("n_links"), F.lit(0.8).alias("confidence"))


def folder_neighbours(assets: DataFrame) -> DataFrame:
    """(id, n_same, n_parent, n_child, n_sibling): how many assets of the container lie in the same folder,
    in the parent folder, anywhere below, or in another folder of the same parent at the same depth. Folders are
    counted once and counts joined on, so no pairs of assets arise."""
    a = located(assets)
    f = cut(a.groupBy("connector_id", "container", "folder", "depth").agg(F.count("*").alias("n")), "folders")  # read four times below
    f = f.withColumn("up", F.when(F.col("depth") > 0, folder_of(F.col("folder"))))
    key = ["connector_id", "container"]
    parent = f.select(*key, F.col("folder").alias("up"), F.col("n").alias("n_parent"))
    sib = f.where("up is not null").groupBy(*key, "up").agg(F.sum("n").alias("all"))
    levels = f.where("depth > 0").select(*key, "n", F.split("folder", "/").alias("p"))
    anc = levels.select(*key, "n", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("k")).select(*key, "n", F.when(F.col("k") == 0, "").otherwise(F.array_join(F.slice("p", 1, F.greatest("k", F.lit(1))), "/")).alias("folder"))
    below = anc.groupBy(*key, "folder").agg(F.sum("n").alias("n_child"))
    g = f.join(parent, [*key, "up"], "left").join(sib, [*key, "up"], "left").join(below, [*key, "folder"], "left")
    g = g.select(*key, "folder", (F.col("n") - 1).alias("n_same"), F.coalesce("n_parent", F.lit(0)).alias("n_parent"), F.coalesce("n_child", F.lit(0)).alias("n_child"), F.coalesce(F.col("all") - F.col("n"), F.lit(0)).alias("n_sibling"))
    return a.join(g, [*key, "folder"]).select("id", "n_same", "n_parent", "n_child", "n_sibling")


def folder_inputs(assets: DataFrame, at_most: int = 5) -> DataFrame:
    """(folder_id, id, rank): the first assets of each folder by id, the inputs of its process. The first
    few of a group are found by a bounded sort of each folder's ids."""
    from pyspark.sql import Window

    a = located(assets)
    w = Window.partitionBy("connector_id", "container", "folder").orderBy("id")
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= at_most).select("connector_id", "container", "folder", "id", "rank")


def manual_edges(links: DataFrame) -> DataFrame:
    """(source_urn, process, target_urn, source_column, target_column, kind) of an uploaded list whose
    source_table and target_table may hold several names apart by semicolons; every source of a row leads
    to every target of the same row."""
    from metaloom.functions.paths import identifier_urn

    def names(c: str) -> Column:
        return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")

    s = links.select("*", F.explode(names("source_table")).alias("s")).select("*", F.explode(names("target_table")).alias("t"))
    return s.select(identifier_urn(F.col("s")).alias("source_urn"), F.col("process_name").alias("process"), identifier_urn(F.col("t")).alias("target_urn"), "source_column", "target_column", F.coalesce("transformation_type", F.lit("direct")).alias("kind"))


def pipeline_stage(name: Column, catalog: Column, schema: Column, id_: Column, type_: Column) -> Column:
    """source, extract, transform or load by keywords of a node; null where none fits."""
    n, c, s, i = (F.lower(F.coalesce(x, F.lit(""))) for x in (name, catalog, schema, id_))
    t = F.upper(F.coalesce(type_, F.lit("")))
    return (
        F.when(c.contains("crm") | c.contains("source") | (s == "source") | i.contains(":source:") | (t == "API"), "source")
        .when(c.contains("staging") | (s == "staging") | n.rlike("raw|staging|transformed") | i.contains(":staging:"), "extract")
        .when(c.contains("warehouse") | n.rlike("dim|fact|transform"), "transform")
        .when(c.contains("analytics") | c.contains("report") | (s == "destination") | n.rlike("destination|warehouse") | i.contains(":destination:"), "load")
    )


def relation_stage(relationship: Column, source: Column, target: Column) -> Column:
    """extract, transform or load of an edge, by its kind, else by the places of its ends."""
    r, s, t = (F.lower(F.coalesce(x, F.lit(""))) for x in (relationship, source, target))
    return (
        F.when(r.contains("extract"), "extract").when(r.contains("transform"), "transform").when(r.contains("load"), "load")
        .when(s.contains(":source:") & t.contains(":staging:"), "extract").when(s.contains(":staging:") & t.contains(":destination:"), "load")
    )
