"""Database dictionaries: JDBC scans, and what is made of the dictionary's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the database itself (fixed values).
SYSTEM = ("SYS", "SYSTEM", "OUTLN", "DBSNMP", "APPQOSSYS", "WMSYS", "EXFSYS", "CTXSYS", "XDB", "ANONYMOUS", "ORDSYS", "ORDDATA", "MDSYS", "LBACSYS", "DVSYS", "OLAPSYS")
#: Dictionary views by what they list (fixed values).
VIEWS = {
    "tables": "SELECT owner, table_name, num_rows, last_analyzed FROM all_tables",
    "columns": "SELECT owner, table_name, column_name, data_type, data_length, data_precision, data_scale, nullable, column_id FROM all_tab_columns",
    "views": "SELECT owner, view_name, text FROM all_views",
    "mviews": "SELECT owner, mview_name, query FROM all_mviews",
    "objects": "SELECT owner, object_name, object_type, status FROM all_objects WHERE object_type IN ('PROCEDURE', 'FUNCTION', 'PACKAGE', 'TRIGGER')",
    "source": "SELECT owner, name, type, line, text FROM all_source",
    "triggers": "SELECT owner, trigger_name, table_owner, table_name, trigger_body FROM all_triggers",
    "constraints": "SELECT owner, constraint_name, constraint_type, table_name, r_owner, r_constraint_name FROM all_constraints",
    "constraint_columns": "SELECT owner, constraint_name, table_name, column_name, position FROM all_cons_columns",
    "dependencies": "SELECT owner, name, type, referenced_owner, referenced_name, referenced_type FROM all_dependencies",
}


def scan(spark: SparkSession, url: str, what: str, **options: str) -> DataFrame:
    """A dictionary view over JDBC, without the database's own schemas; the filter runs in the database."""
    names = ", ".join(f"'{s}'" for s in SYSTEM)
    q = f"SELECT * FROM ({VIEWS[what]}) q WHERE owner NOT IN ({names})"
    return spark.read.format("jdbc").options(url=url, query=q, **options).load()


def schemas(tables: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """(owner): distinct schemas that are not the database's own, and among those asked for if any."""
    t = tables.select(F.upper("owner").alias("owner")).distinct().where(~F.col("owner").isin(*SYSTEM))
    return t.where(F.col("owner").isin(*(o.upper() for o in only))) if only else t


def sources(lines: DataFrame) -> DataFrame:
    """(owner, name, type, code): source lines joined in order; one object's code is bounded."""
    g = lines.groupBy("owner", "name", "type").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("owner", "name", "type", F.array_join(F.transform("l", lambda x: F.regexp_replace(x["text"], r"\n$", "")), "\n").alias("code"))


def foreign_keys(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """(owner, constraint_name, table_name, r_table_name, columns, r_columns): key columns paired by position."""
    c = columns.groupBy("owner", "constraint_name").agg(F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("c"), F.first("table_name").alias("t"))
    names = lambda x: F.array_join(F.transform(x, lambda y: y["column_name"]), ",")
    own = c.select("owner", "constraint_name", names(F.col("c")).alias("columns"))
    ref = c.select(F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), names(F.col("c")).alias("r_columns"), F.col("t").alias("r_table_name"))
    f = constraints.where("constraint_type = 'R'").join(own, ["owner", "constraint_name"]).join(ref, ["r_owner", "r_constraint_name"])
    return f.select("owner", "constraint_name", "table_name", "r_table_name", "columns", "r_columns")


def packages(objects: DataFrame) -> DataFrame:
    """Packages, once each though specification and body are listed."""
    return objects.where("object_type like 'PACKAGE%'").select("owner", "object_name").distinct()


def column_documents(columns: DataFrame) -> DataFrame:
    """(owner, table_name, columns): each table's columns as a JSON document in their order."""
    t = F.when(F.col("data_precision").isNotNull(), F.concat(F.col("data_type"), F.lit("("), F.col("data_precision").cast("int").cast("string"), F.lit(","), F.coalesce(F.col("data_scale").cast("int"), F.lit(0)).cast("string"), F.lit(")"))).otherwise(F.col("data_type"))
    g = columns.groupBy("owner", "table_name").agg(F.array_sort(F.collect_list(F.struct("column_id", F.col("column_name").alias("name"), t.alias("type"), (F.col("nullable") == "Y").alias("nullable")))).alias("c"))
    return g.select("owner", "table_name", F.to_json(F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable")))).alias("columns"))


#: Types in a created table (fixed values); anything else becomes VARCHAR.
TABLE_TYPES = {"string": "VARCHAR", "int32": "INTEGER", "int64": "BIGINT", "float": "REAL", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def create_table(name: str, columns: list[tuple[str, str]]) -> str:
    """CREATE TABLE IF NOT EXISTS for (name, type) in any spelling of the types."""
    from metaloom.functions.masking import quoted
    from metaloom.operators.drift import canonical_type

    def kind(t: str) -> str:
        c = canonical_type(t)
        return c.upper() if c.startswith("decimal") else TABLE_TYPES.get(c, "VARCHAR")

    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(quoted(n, chr(34)) + ' ' + kind(t) for n, t in columns)})"
