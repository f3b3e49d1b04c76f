"""Paths, locations and names: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_path(c: Column) -> Column:
    """Without slashes at the ends, lower case."""
    return F.lower(F.btrim(c, F.lit("/")))


def folder_of(c: Column) -> Column:
    """The path up to its last slash, empty where there is none."""
    return F.regexp_replace(c, r"/?[^/]*$", "")


def file_of(c: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(c, r"([^/]*)$", 1)


def format_of(c: Column) -> Column:
    """Format by extension; a path without one is sniffed for a format's name; else unknown."""
    name = F.lower(file_of(c))
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    by_ext = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "avro": "avro", "xlsx": "excel", "xls": "excel", "xml": "xml", "orc": "orc", "delta": "delta"}
    low = F.lower(c)
    sniff = F.lit("unknown")
    for f in reversed(("parquet", "csv", "json", "avro", "orc", "delta", "xml")):
        sniff = F.when(low.contains(f), f).otherwise(sniff)
    known = F.lit(None).cast("string")
    for e, f in by_ext.items():
        known = F.when(ext == e, f).otherwise(known)
    return F.coalesce(known, F.when(ext == "", sniff), F.lit("unknown"))


#: Patterns of storage addresses (formats): scheme, container, account, path.
ABFS = r"(?i)^(abfss?)://([^@]+)@([^.]+)\.dfs\.core\.windows\.net(.*)$"
BLOB = r"(?i)^(https?)://([^.]+)\.blob\.core\.windows\.net/([^/]+)(.*)$"
S3 = r"^s3://([^/]+)/?(.*)$"


def storage_location(c: Column) -> Column:
    """struct(type, account, container, path, protocol) of an address: data lake, blob, object store, or
    a bare container/path. An address of another scheme has type null."""
    c = F.trim(c)

    def part(p: str, i: int) -> Column:
        return F.regexp_extract(c, p, i)

    def slash(x: Column) -> Column:
        return F.regexp_replace(x, "^/+", "")

    def made(kind, account, container, path, protocol):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(*(lit(v).alias(k) for k, v in zip(("type", "account", "container", "path", "protocol"), (kind, account, container, path, protocol))))

    bare = c.contains("/") & ~c.rlike(r"^[a-z0-9]+://")
    return (
        F.when(c.rlike(ABFS), made("azure_datalake", part(ABFS, 3), part(ABFS, 2), slash(part(ABFS, 4)), F.lower(part(ABFS, 1))))
        .when(c.rlike(BLOB), made("azure_blob", part(BLOB, 2), part(BLOB, 3), slash(part(BLOB, 4)), "https"))
        .when(c.rlike(S3), made("aws_s3", F.lit(None).cast("string"), part(S3, 1), part(S3, 2), "s3"))
        .when(bare, made("azure_blob", "unknown", F.substring_index(c, "/", 1), F.regexp_replace(c, "^[^/]*/", ""), "https"))
        .otherwise(F.lit(None))
    )


#: Shapes of an Oracle JDBC address, tried in order (formats): host, port, service.
JDBC = (
    r"oracle:(?:thin|oci):@//([^:/]+):(\d+)/([^?#]+)",
    r"oracle:(?:thin|oci):@([^:/]+):(\d+):([^?#]+)",
    r"oracle:(?:thin|oci):@([^:/]+):(\d+)/([^?#]+)",
    r"(?is)oracle:(?:thin|oci):@\(DESCRIPTION=.*?HOST=([^\)]+).*?PORT=(\d+).*?(?:SERVICE_NAME|SID)=([^\)]+)",
    r"@/*([^:]+):(\d+)[:/]([^?&#]+)",
)


def jdbc_address(c: Column) -> Column:
    """struct(host, port int, service) of a JDBC address, null where no shape fits."""
    out = F.lit(None).cast("struct<host: string, port: int, service: string>")
    for p in reversed(JDBC):
        got = F.struct(
            F.trim(F.regexp_extract(c, p, 1)).alias("host"), F.regexp_extract(c, p, 2).cast("int").alias("port"), F.trim(F.regexp_extract(c, p, 3)).alias("service")
        )
        out = F.when(c.rlike(p), got).otherwise(out)
    return out


def dataset_urn(source: Column, catalog: Column, schema: Column, name: Column) -> Column:
    """urn:dataset:{source}:{catalog}[.{schema}].{name}, underscores of the source as hyphens."""
    return F.concat(
        F.lit("urn:dataset:"), F.replace(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")), F.lit("_"), F.lit("-")), F.lit(":"),
        F.concat_ws(".", F.nullif(catalog, F.lit("")), F.nullif(schema, F.lit("")), name),
    )


def identifier_urn(c: Column) -> Column:
    """An identifier as a URN: a URN stays, three or more dotted parts are a database object, two a file."""
    n = F.size(F.split(c, r"\."))
    kind = F.when(n >= 3, "oracle").when(n == 2, "azure-blob").otherwise("unknown")
    return F.when(c.startswith("urn:"), c).otherwise(F.concat(F.lit("urn:dataset:"), kind, F.lit(":"), c))


def urn_name(c: Column) -> Column:
    """The last dotted part of a URN's last part."""
    return F.substring_index(F.substring_index(c, ":", -1), ".", -1)


def urn_asset(c: Column) -> Column:
    """struct(catalog, name): the first dotted part and what follows the second (or the first, of two)."""
    p = F.split(F.substring_index(c, ":", -1), r"\.")
    n = F.size(p)
    name = F.when(n >= 3, F.array_join(F.slice(p, 3, n), ".")).when(n == 2, p[1]).otherwise(p[0])
    return F.struct(F.when(n >= 2, p[0]).alias("catalog"), name.alias("name"))
