"""SQL text queries, over the SQL among the documents and the edges' own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import sqltext as X
from metaloom.plans.base import sid
from metaloom.registry import Registry

R = Registry()
_SRC = "regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') = 'sql_lineage'"
_D = f"d AS (SELECT doc_id, text FROM documents WHERE {_SRC} AND text IS NOT NULL)"


def _docs(t):
    """The documents that hold SQL, whole texts."""
    return t("documents").where((F.regexp_replace(F.lower(F.trim("source")), r"[\s_-]+", "_") == "sql_lineage") & F.col("text").isNotNull()).select("doc_id", "text")


@R.add("sql_L1_L8_statements")
def statements(t):
    return X.parsed_statements(_docs(t), "doc_id", "text").withColumn("counts", F.to_json("counts"))


@R.add("sql_L5_L6_columns")
def columns(t):
    return X.parsed_columns(_docs(t), "doc_id", "text")


_N = r"(\w+(?:\.\w+)*)"


@R.add(
    "sql_L9_patterns",
    rf"""WITH {_D}, u AS (SELECT doc_id, upper(text) AS x FROM d), v AS (SELECT doc_id, x, regexp_extract(x, 'INSERT\s+(?:INTO\s+)?{_N}', 1) AS i, regexp_extract(x, 'CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+{_N}', 1) AS c FROM u)
    SELECT doc_id, CASE WHEN c <> '' THEN 'CREATE' WHEN i <> '' THEN 'INSERT' ELSE 'UNKNOWN' END AS query_type, coalesce(nullif(c, ''), nullif(i, '')) AS target,
    array_to_string(list_sort(list_distinct(regexp_extract_all(x, 'FROM\s+{_N}', 1) || regexp_extract_all(x, 'JOIN\s+{_N}', 1))), ',') AS sources, CASE WHEN c <> '' OR i <> '' THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM v""",
)
def patterns(t):
    x = _docs(t).select("doc_id", X.by_pattern(F.col("text")).alias("x"))
    return x.select("doc_id", "x.query_type", "x.target", F.array_join("x.sources", ",").alias("sources"), "x.confidence")


_CODE = r"regexp_replace(regexp_replace(text, '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
_STATIC = " || ".join(f"regexp_extract_all(c, '{p}', 1)" for p in X.STATIC)


@R.add("sql_L10_static", rf"WITH {_D}, e AS (SELECT doc_id, {_CODE} || ';' AS c FROM d), f AS (SELECT doc_id, unnest({_STATIC}) AS s FROM e), g AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM f) SELECT doc_id, md5(s) AS statement_md5, count(*) AS n FROM g WHERE length(s) > 10 GROUP BY 1, 2")
def static(t):
    s = _docs(t).select("doc_id", F.explode(X.static_statements(F.concat(X.without_comments(F.col("text")), F.lit(";")))).alias("s"))
    return s.groupBy("doc_id", F.md5("s").alias("statement_md5")).agg(F.count("*").alias("n"))


@R.add("sql_L12_calls", rf"WITH {_D}, e AS (SELECT doc_id, {_CODE} AS c FROM d) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(c, '(\w+(?:\.\w+)?)\s*\([^)]*\)', 1), lambda n: upper(n) NOT IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'FROM', 'WHERE')))), ',') AS calls FROM e")
def calls(t):
    return _docs(t).select("doc_id", F.array_join(X.called_procedures(F.col("text")), ",").alias("calls"))


_JK = r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"


@R.add(
    "sql_L13_join_keys",
    rf"""WITH {_D} SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_JK}', 1)) AS left_table, unnest(regexp_extract_all(text, '{_JK}', 2)) AS left_column, unnest(regexp_extract_all(text, '{_JK}', 3)) AS right_table,
    unnest(regexp_extract_all(text, '{_JK}', 4)) AS right_column, 0.9::DOUBLE AS confidence FROM d""",
)
def join_keys(t):
    return X.join_keys(_docs(t), "doc_id", "text")


_AB = r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)"


@R.add(
    "sql_L14_usage",
    rf"""WITH {_D}, u AS (SELECT unnest(regexp_extract_all(text, '{_AB}', 1)) AS q, unnest(regexp_extract_all(text, '{_AB}', 2)) AS c FROM d)
    SELECT q AS qualifier, string_agg(DISTINCT c, ',' ORDER BY c) AS columns, count(*) AS n, 0.85::DOUBLE AS confidence FROM u GROUP BY 1""",
)
def usage(t):
    return X.column_usage(_docs(t), "text")


@R.add("sql_L11_L15_L16_procedures")
def procedures(t):
    return X.procedure_lineage(_docs(t), "doc_id", "text")


@R.add("sql_L17_J17_resolve")
def resolve(t):
    named = t("assets").withColumn("name", F.regexp_replace(F.lower("name"), r"[ _-]?[0-9]+(\.[a-z0-9]+)?$", ""))
    return X.resolve(X.parsed_statements(_docs(t), "doc_id", "text"), named, "doc_id").withColumn("source_ids", F.array_join("source_ids", ","))


_REF = r"(?i)(?:FROM|JOIN|INTO)\s+([^\s;,()]+)"


@R.add(
    "sql_N9_J13_references",
    rf"""WITH k AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(sql_query, '{_REF}', 1))) AS token FROM lineage_relationships WHERE sql_query IS NOT NULL)
    SELECT k.id, k.token, {sid('a.id')} AS asset_id, 0.85::DOUBLE AS confidence FROM k JOIN assets a ON ends_with({sid('a.id')}, k.token) WHERE k.token <> ''""",
)
def references(t):
    return X.suffix_references(t("lineage_relationships"), t("assets"))


_TOKENS = rf"k AS (SELECT DISTINCT lower(split_part(unnest(regexp_extract_all(sql_query, '{_REF}', 1)), '.', -1)) AS token FROM lineage_relationships WHERE sql_query IS NOT NULL)"


def _tokens(t):
    """The last parts of all table names in the edges' SQL."""
    x = F.explode(F.regexp_extract_all("sql_query", F.lit(r"(?i)(?:FROM|JOIN|INTO)\s+([^\s;,()]+)")))
    return t("lineage_relationships").where("sql_query is not null").select(x.alias("x")).select(F.substring_index("x", ".", -1).alias("token"))


@R.add("sql_J13_contained", f"WITH {_TOKENS} SELECT token, a.id, lower(a.name) = token AS exact FROM k JOIN assets a ON contains(lower(a.name), token) WHERE token <> ''")
def contained(t):
    return X.containing(_tokens(t), t("assets"))


@R.add("sql_J17_first", f"WITH {_TOKENS} SELECT token, arg_min(a.id, ((lower(a.name) <> token)::INT, a.id)) AS id FROM k JOIN assets a ON contains(lower(a.name), token) WHERE token <> '' GROUP BY 1")
def first_contained(t):
    return X.first_containing(_tokens(t), t("assets"))


@R.add("sql_L18_assets", "SELECT lower(trim(id)) AS asset_id, f AS place, technical_metadata ->> ('$.' || f) AS sql FROM assets, (SELECT unnest(['sql_query', 'view_definition', 'create_statement', 'ddl']) AS f) WHERE json_valid(technical_metadata) AND trim(technical_metadata ->> ('$.' || f)) <> ''")
def asset_texts(t):
    return X.asset_sql(t("assets"), t("data_discovery"))


@R.add("sql_S20_L18_embedded", "SELECT id, 2 AS line_number, trim(sql_query) AS sql, left(trim('sql = \"' || sql_query || '\"'), 100) AS context FROM lineage_relationships WHERE sql_query IS NOT NULL AND length(trim(sql_query)) > 20")
def embedded(t):
    f = t("lineage_relationships").where("sql_query is not null").select("id", F.concat(F.lit("def task():\n    sql = \""), "sql_query", F.lit("\"\n    return sql")).alias("code"))
    return X.embedded_sql(f, "id", "code")
