"""Lineage from SQL text: parsed statements and columns, and what regular expressions can find.

Texts are read in Arrow batches on the executors; everything by regular expression stays in the JVM.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.sqlparse import statements
from metaloom.operators.catalog import document
from metaloom.util import arrow_map, loose_id

STATEMENTS = "statement_no int, query_type string, target string, sources array<string>, n_columns int, complexity double, confidence double, counts map<string,int>"
COLUMNS = "statement_no int, target string, target_column string, source string, source_column string, kind string, confidence double"


def _emit(src: DataFrame, key: str, schema: str, types, rows):
    kind = dict(src.dtypes)[key]

    def run(batches):
        for b in batches:
            take, cols = [], [[] for _ in types]
            for i, text in enumerate(b.column(1).to_pylist()):
                for row in rows(text):
                    take.append(i)
                    for c, v in zip(cols, row):
                        c.append(v)
            arrays = [b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *(n for n, _ in types)])

    return arrow_map(src, run, f"{key} {kind}, {schema}")


def parsed_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per statement that can be read: its type, target, source tables in order without CTEs, the
    number of columns traced, complexity and confidence. Null texts have none."""

    def rows(t):
        for n, s in enumerate(statements(t)):
            yield n, s.kind, s.target, s.sources, len(s.columns), s.complexity, s.trust, list(s.counts.items())

    types = [("statement_no", pa.int32()), ("query_type", pa.string()), ("target", pa.string()), ("sources", pa.list_(pa.string())), ("n_columns", pa.int32()), ("complexity", pa.float64()), ("confidence", pa.float64()), ("counts", pa.map_(pa.string(), pa.int32()))]
    return _emit(df.select(key, text).where(F.col(text).isNotNull()), key, STATEMENTS, types, rows)


def parsed_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per output column of a statement: where it comes from and by what kind of expression."""

    def rows(t):
        for n, s in enumerate(statements(t)):
            for c in s.columns:
                yield n, s.target, *c

    types = [("statement_no", pa.int32()), ("target", pa.string()), ("target_column", pa.string()), ("source", pa.string()), ("source_column", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]
    return _emit(df.select(key, text).where(F.col(text).isNotNull()), key, COLUMNS, types, rows)


NAME = r"(\w+(?:\.\w+)*)"


def by_pattern(text: Column) -> Column:
    """struct(query_type, target, sources, confidence) by regular expressions on the upper-cased text: .5
    with a target, .3 without; sources sorted."""
    t = F.upper(text)
    insert = F.regexp_extract(t, r"INSERT\s+(?:INTO\s+)?" + NAME, 1)
    create = F.regexp_extract(t, r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+" + NAME, 1)
    sources = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"FROM\s+" + NAME), F.lit(1)), F.regexp_extract_all(t, F.lit(r"JOIN\s+" + NAME), F.lit(1)))))
    return F.struct(
        F.when(create != "", "CREATE").when(insert != "", "INSERT").otherwise("UNKNOWN").alias("query_type"), F.coalesce(F.nullif(create, F.lit("")), F.nullif(insert, F.lit(""))).alias("target"),
        sources.alias("sources"), F.when((create != "") | (insert != ""), 0.5).otherwise(0.3).alias("confidence"),
    )


def without_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")


#: What starts a statement inside a procedure (formats).
STATIC = (
    r"(?is)(SELECT\s+[^;]+?;)", r"(?is)(INSERT\s+(?:INTO\s+)?\w+\s+[^;]+?;)", r"(?is)(UPDATE\s+\w+\s+[^;]+?;)", r"(?is)(DELETE\s+(?:FROM\s+)?\w+\s+[^;]+?;)", r"(?is)(MERGE\s+[^;]+?;)",
    r"(?is)(CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+[^;]+?;)",
)


def static_statements(code: Column) -> Column:
    """The statements in a procedure's code, white space folded, longer than ten characters."""
    c = without_comments(code)
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in STATIC)))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 10)


def called_procedures(code: Column) -> Column:
    """Sorted names of what a procedure's code calls, statements' own words left out."""
    found = F.regexp_extract_all(without_comments(code), F.lit(r"(\w+(?:\.\w+)?)\s*\([^)]*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: ~F.upper(n).isin("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE"))))


#: How dynamic SQL is run, by language (formats).
DYNAMIC = {
    "oracle": (r"EXECUTE\s+IMMEDIATE\s+([^;]+)", r"EXEC\s+IMMEDIATE\s+([^;]+)", r"DBMS_SQL\.PARSE\s*\([^,]+,\s*([^,]+)"),
    "sqlserver": (r"sp_executesql\s+@?(\w+)\s*[,)]", r"EXEC\s+sp_executesql\s+@?(\w+)", r"EXECUTE\s+sp_executesql\s+@?(\w+)"),
    "postgres": (r"EXECUTE\s+([^;]+)", r"EXEC\s+([^;]+)"),
}


def dynamic_sql(code: str | None, language: str = "oracle") -> list[str]:
    """The texts that a procedure runs dynamically, found through the variable they are assigned to; a
    concatenation gives its first part with dots."""
    if not code:
        return []
    code = re.sub(r"(?s)/\*.*?\*/", "", re.sub(r"(?m)--.*$", "", code))
    language = {"plsql": "oracle", "tsql": "sqlserver"}.get(language.lower(), language.lower())
    sign = ":=" if language == "oracle" else "="
    out = []
    for p in DYNAMIC.get(language, ()):
        for m in re.finditer(p, code, re.I | re.S):
            ref = m[1].strip()
            if ref[:1] in "'\"":
                q = re.match(r"(['\"])(.*?)\1(\s*\|\|)?", ref, re.S)
                if q:
                    out.append(q[2] + ("..." if q[3] else ""))
                continue
            name = re.match(r"@?([\w.]+)", ref)
            if name:
                a = re.search(rf"{re.escape(name[1])}\s*{sign}\s*(['\"])(.*?)\1(\s*\|\|)?", code, re.I | re.S)
                if a:
                    out.append(a[2] + ("..." if a[3] else ""))
    return list(dict.fromkeys(out))


def procedure_lineage(procs: DataFrame, key: str, code: str, language: str = "oracle") -> DataFrame:
    """(key, sources, targets, calls, n_static, n_dynamic, confidence): what procedures read, write and
    call; .8 from static text alone, .7 with dynamic SQL, .3 where nothing is found."""

    def rows(t):
        dyn = dynamic_sql(t, language)
        src, dst, n = [], [], 0
        clean = re.sub(r"(?s)/\*.*?\*/", "", re.sub(r"(?m)--.*$", "", t or ""))
        parts = [m for p in STATIC for m in re.findall(p, clean)]
        for s in [*parts, *dyn]:
            for x in statements(re.sub(r"(?is)\bINTO\s+[\w.,\s]+?\s+FROM\b", "FROM", s) if re.match(r"\s*SELECT", s, re.I) else s):
                n += 1
                src += x.sources
                if x.target:
                    dst.append(x.target)
        src, dst = list(dict.fromkeys(src)), list(dict.fromkeys(dst))
        yield src, dst, len(parts), len(dyn), 0.3 if not n else 0.7 if dyn else 0.8

    types = [("sources", pa.list_(pa.string())), ("targets", pa.list_(pa.string())), ("n_static", pa.int32()), ("n_dynamic", pa.int32()), ("confidence", pa.float64())]
    out = _emit(procs.select(key, code), key, "sources array<string>, targets array<string>, n_static int, n_dynamic int, confidence double", types, rows)
    return out.join(procs.select(key, called_procedures(F.col(code)).alias("calls")), key)


JOIN_KEY = r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"


def join_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, left_table, left_column, right_table, right_column, confidence) of every a.b = c.d in a text."""
    parts = [F.regexp_extract_all(F.col(text), F.lit(JOIN_KEY), F.lit(i)).alias(n) for i, n in enumerate(("left_table", "left_column", "right_table", "right_column"), 1)]
    return df.select(key, F.inline(F.arrays_zip(*parts))).distinct().withColumn("confidence", F.lit(0.9))


def column_usage(df: DataFrame, text: str) -> DataFrame:
    """(qualifier, columns, n, confidence): for each qualifier in the texts the columns used under it, sorted,
    and how often. Counts are aggregated per column before sets are made, so sets stay small."""
    t = F.col(text)
    z = F.arrays_zip(F.regexp_extract_all(t, F.lit(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)"), F.lit(1)).alias("q"), F.regexp_extract_all(t, F.lit(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)"), F.lit(2)).alias("c"))
    one = df.select(F.inline(z)).groupBy("q", "c").agg(F.count("*").alias("n"))
    return one.groupBy(F.col("q").alias("qualifier")).agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("columns"), F.sum("n").alias("n")).withColumn("confidence", F.lit(0.85))


def resolve(parsed: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """(key, statement_no, status, target_id, source_ids): names of parsed statements as assets, by the
    last part of the name, without case; of several assets the smallest id. status is no_lineage,
    no_source_datasets, no_target_dataset or success."""
    last = lambda c: F.lower(F.substring_index(c, ".", -1))
    a = assets.select(F.regexp_replace(F.lower("name"), r"\.[a-z0-9]+$", "").alias("n"), "id").groupBy("n").agg(F.min("id").alias("id"))
    p = parsed.select(key, "statement_no", "target", "sources")
    s = p.select(key, "statement_no", F.explode("sources").alias("s")).select(key, "statement_no", last(F.col("s")).alias("n")).join(a, "n")
    s = s.groupBy(key, "statement_no").agg(F.array_sort(F.collect_set("id")).alias("source_ids"))
    t = p.withColumn("n", last(F.col("target"))).join(a.withColumnRenamed("id", "target_id"), "n", "left").drop("n")
    j = t.join(s, [key, "statement_no"], "left")
    status = (
        F.when(F.col("target").isNull() & (F.size("sources") == 0), "no_lineage").when(F.col("source_ids").isNull(), "no_source_datasets")
        .when(F.col("target_id").isNull(), "no_target_dataset").otherwise("success")
    )
    return j.select(key, "statement_no", status.alias("status"), "target_id", "source_ids")


def suffix_references(lineage: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, token, asset_id, confidence): assets whose id ends with a table name of an edge's SQL text. Names are
    matched by equality on suffixes of the lengths that occur, a small set, instead of by containment."""
    t = F.regexp_extract_all("sql_query", F.lit(r"(?i)(?:FROM|JOIN|INTO)\s+([^\s;,()]+)"), F.lit(1))
    tok = lineage.where("sql_query is not null").select("id", F.explode(F.array_distinct(t)).alias("token")).withColumn("token", F.lower("token")).where("token <> ''")
    sizes = tok.select(F.length("token").alias("k")).distinct()
    a = assets.select(loose_id("id").alias("asset_id")).where("asset_id is not null")
    a = a.select("asset_id", F.explode(F.sequence(F.lit(1), F.length("asset_id"))).alias("k")).join(sizes, "k").select("asset_id", F.expr("right(asset_id, k)").alias("token"))
    return tok.join(a, "token").select("id", "token", "asset_id", F.lit(0.85).alias("confidence"))


def containing(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, id, exact): every name (id, name) that contains a token, both in lower case. Names are cut into their
    parts of the lengths that tokens have, and parts meet tokens by equality, so no name meets every token."""
    t = tokens.select(F.lower("token").alias("token")).where("token <> ''").distinct()
    sizes = t.select(F.length("token").alias("k")).distinct()
    n = names.select("id", F.lower("name").alias("name")).where("id is not null and name <> ''")
    n = n.select("id", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("k")).join(sizes, "k")
    parts = n.select("id", "name", "k", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("k") + 1)).alias("i")).select("id", F.expr("substring(name, i, k)").alias("token"), (F.length("name") == F.col("k")).alias("exact"))
    return parts.join(t, "token").distinct()


def first_containing(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, id): of all names that contain a token an equal one, else the one of the smallest id."""
    return containing(tokens, names).groupBy("token").agg(F.min(F.struct((~F.col("exact")).alias("part"), "id")).alias("m")).select("token", "m.id")


def trigger_edges(triggers: DataFrame) -> DataFrame:
    """(source, target, kind, confidence): a trigger's table leads to it (.9), so does every other table that its body
    reads (.85). triggers has owner, trigger_name, table_name and trigger_body; names without a schema are of the owner's.
    A trigger without a name or table gives no edge; repeated rows count once."""
    full = lambda owner, name: F.lower(F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat_ws(".", owner, name)))
    t = triggers.where("trigger_name is not null and table_name is not null").select("owner", full(F.col("owner"), F.col("trigger_name")).alias("trigger"), full(F.col("owner"), F.col("table_name")).alias("table"), "trigger_body").distinct()
    body = procedure_lineage(t.groupBy("trigger").agg(F.first("trigger_body").alias("code")), "trigger", "code").select("trigger", "sources")
    read = t.join(body, "trigger").select("trigger", "table", "owner", F.explode("sources").alias("s")).select("trigger", "table", full(F.col("owner"), F.col("s")).alias("s")).where("s <> table")
    own = t.select(F.col("table").alias("source"), F.col("trigger").alias("target"), F.lit("on").alias("kind"), F.lit(0.9).alias("confidence"))
    return own.unionByName(read.select(F.col("s").alias("source"), F.col("trigger").alias("target"), F.lit("reads").alias("kind"), F.lit(0.85).alias("confidence"))).distinct()


#: Where an asset's own SQL may stand (fixed values).
SQL_FIELDS = ("sql_query", "view_definition", "create_statement", "ddl")
VIEW_SQL = ("analytical_sql", "operational_sql")


def asset_sql(assets: DataFrame, discovery: DataFrame) -> DataFrame:
    """(asset_id, place, sql): the SQL texts of each asset: the generated views of its scan with the largest id, and
    four fields of its technical metadata. Blank texts and documents that are not complete JSON have none."""
    d = discovery.select(loose_id("asset_id").alias("asset_id"), "id", "schema_json").where("asset_id is not null")
    d = d.groupBy("asset_id").agg(F.max(F.struct("id", "schema_json")).alias("m"))
    pick = lambda c, root, names: F.array(*(F.struct(F.lit(n).alias("place"), F.get_json_object(c, f"{root}.{n}").alias("sql")) for n in names))
    views = d.select("asset_id", F.inline(pick(document("m.schema_json"), "$.view_sql_commands", VIEW_SQL)))
    own = assets.select(loose_id("id").alias("asset_id"), F.inline(pick(document("technical_metadata"), "$", SQL_FIELDS)))
    return views.unionByName(own).where("asset_id is not null and trim(sql) <> ''")


#: SQL in the source of a workflow (formats).
EMBEDDED = (r"""(?i)["']([^"']*SELECT[^"']*)["']""", r"""(?i)sql\s*=\s*["']([^"']*)["']""", r"""(?i)query\s*=\s*["']([^"']*)["']""")


def embedded_sql(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number, sql, context): SQL texts in the lines of source files, longer than 20 characters,
    with the first 100 characters of the line."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in EMBEDDED))))
    s = lines.select(key, (F.col("i") + 1).alias("line_number"), F.explode(found).alias("sql"), F.left(F.trim("line"), F.lit(100)).alias("context")).withColumn("sql", F.trim("sql"))
    return s.where((F.length("sql") > 20) & F.upper("sql").rlike("SELECT|INSERT|CREATE"))
