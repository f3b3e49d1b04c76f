"""Duplicates, change detection, profiles, personal data and masking as queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from metaloom.functions import masking, paths, pii
from metaloom.operators import catalog as C
from metaloom.operators import dedup as D
from metaloom.operators import quality as Q
from metaloom.plans.base import COLS, SCANS, doc, sid
from metaloom.registry import Registry

R = Registry()
NOW = datetime(2025, 7, 1)
FM = doc("file_metadata")


@R.add("dedup_D1_D11_paths", "SELECT id, lower(trim(storage_path, '/')) AS norm, regexp_replace(storage_path, '/?[^/]*$', '') AS folder, regexp_extract(storage_path, '([^/]*)$', 1) AS file FROM data_discovery WHERE storage_path IS NOT NULL")
def d_paths(t):
    p = F.col("storage_path")
    return t("data_discovery").where("storage_path is not null").select("id", paths.norm_path(p).alias("norm"), paths.folder_of(p).alias("folder"), paths.file_of(p).alias("file"))


_AP = " UNION ALL ".join(
    f"SELECT id AS asset_id, lower(trim({doc(d)} ->> '{p}', '/')) AS path FROM assets"
    for d, p in (("technical_metadata", "$.location"), ("technical_metadata", "$.path"), ("technical_metadata", "$.storage_path"), ("operational_metadata", "$.path"))
)


@R.add("dedup_D2_by_path", f"WITH a AS (SELECT path, min(asset_id) AS asset_id FROM ({_AP}) WHERE path <> '' GROUP BY 1) SELECT d.id, a.path, a.asset_id FROM data_discovery d JOIN a ON a.path = lower(trim(d.storage_path, '/'))")
def d_by_path(t):
    return D.by_path(t("assets"), t("data_discovery"))


_LAG = f"""{SCANS}, x AS (SELECT id, asset_id, nullif(coalesce({FM} ->> '$.hash.value', {FM} ->> '$.file_hash'), '') AS h, nullif(schema_hash, '') AS s FROM sc WHERE asset_id IS NOT NULL),
y AS (SELECT *, lag(id) OVER w AS pid, lag(h) OVER w AS ph, lag(s) OVER w AS ps FROM x WINDOW w AS (PARTITION BY asset_id ORDER BY id))"""


@R.add("dedup_D3_decide", f"WITH {_LAG} SELECT id, pid IS NULL OR ps IS NULL OR ps IS DISTINCT FROM s AS write, pid IS NOT NULL AND (ps IS NULL OR ps IS DISTINCT FROM s) AS schema_changed FROM y")
def d_decide(t):
    return D.decide(t("data_discovery"))


@R.add("dedup_D4_D5_shake")
def d_shake(t):
    s = t("data_discovery")
    return s.select("id", D.shake128(s.sparkSession)(F.concat_ws("_", "storage_path", "discovered_at")).alias("hash"))


_SK = f"""j AS (SELECT id, updated_at, discovered_at, file_metadata, {doc('schema_json')} AS j FROM data_discovery),
k0 AS (SELECT id, updated_at, discovered_at, file_metadata, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.columns') = 'ARRAY' THEN j -> '$.columns' END AS c FROM j),
k1 AS (SELECT DISTINCT id, lower(trim(n)) AS n FROM (SELECT id, unnest(json_extract_string(c, '$[*].name')) AS n FROM k0 WHERE json_array_length(c) > 0) WHERE trim(n) <> ''),
k2 AS (SELECT id, md5(string_agg(n, chr(1) ORDER BY n COLLATE "C")) AS g FROM k1 GROUP BY 1),
k3 AS (SELECT k2.id, g, coalesce(
   CASE WHEN regexp_matches({FM} ->> '$.timestamps.last_modified', '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]|$)') THEN TRY_CAST({FM} ->> '$.timestamps.last_modified' AS TIMESTAMPTZ) END,
   CASE WHEN regexp_matches({FM} ->> '$.last_modified', '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]|$)') THEN TRY_CAST({FM} ->> '$.last_modified' AS TIMESTAMPTZ) END,
   CAST(updated_at AS TIMESTAMPTZ), CAST(discovered_at AS TIMESTAMPTZ)) AS at_ FROM k2 JOIN k0 USING (id)),
k4 AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY at_ DESC NULLS LAST, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM k3)""".replace(' COLLATE "C"', "")


@R.add("dedup_D6_D7_schema", f"WITH {_SK} SELECT id, g AS schema_group, r = 1 AS keep FROM k4 WHERE n > 1")
def d_schema(t):
    return D.schema_duplicates(t("data_discovery"))


@R.add("dedup_D8_summary", f"WITH {_SK} SELECT count(*) FILTER (r = 1 AND n > 1) AS groups_deduped, count(*) FILTER (r > 1) AS hidden, (SELECT count(*) FROM data_discovery) AS total FROM k4")
def d_summary(t):
    return D.duplicate_summary(t("data_discovery"))


_LF = """lf AS (SELECT storage_identifier AS container, folder, id, path, modified FROM (SELECT storage_identifier, regexp_replace(storage_path, '/?[^/]*$', '') AS folder, id, storage_path AS path, discovered_at AS modified,
  row_number() OVER (PARTITION BY storage_identifier, regexp_replace(storage_path, '/?[^/]*$', '') ORDER BY discovered_at DESC NULLS LAST, id) AS r FROM data_discovery WHERE {w} ends_with(lower(storage_path), '.parquet')) WHERE r = 1)"""


def _latest(d):
    f = d.select(F.col("storage_identifier").alias("container"), F.col("storage_path").alias("path"), F.col("discovered_at").alias("modified"), "id")
    return D.latest_per_folder(f, "container", "path", "modified", "id")


@R.add("dedup_D9_latest_per_folder", "WITH " + _LF.format(w="") + " SELECT container, folder, path, modified, id FROM lf")
def d_latest(t):
    return _latest(t("data_discovery"))


@R.add(
    "dedup_D10_refresh",
    "WITH " + _LF.format(w="") + ", " + _LF.format(w="discovered_at < TIMESTAMP '2025-03-01' AND").replace("lf AS", "so AS", 1)
    + """ SELECT lf.container, lf.folder, lf.path, coalesce(CASE WHEN so.modified IS NULL THEN true WHEN lf.modified IS NULL THEN false WHEN lower(trim(lf.path, '/')) = lower(trim(so.path, '/')) THEN lf.modified > so.modified
    ELSE lf.modified >= so.modified END, false) AS refresh FROM lf LEFT JOIN so ON so.container IS NOT DISTINCT FROM lf.container AND so.folder = lf.folder""",
)
def d_refresh(t):
    d = t("data_discovery")
    return D.refresh_folders(_latest(d), _latest(d.where(F.col("discovered_at") < F.lit(datetime(2025, 3, 1))))).select("container", "folder", "path", "refresh")


@R.add(
    "dedup_D12_A12_edges",
    f"""SELECT s AS source, t AS target, source_job_id, id, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY s, t, source_job_id ORDER BY coalesce(confidence_score, -1) DESC, id) AS r
    FROM (SELECT {sid('source_asset_id')} AS s, {sid('target_asset_id')} AS t, source_job_id, id, confidence_score FROM lineage_relationships)) WHERE r = 1""",
)
def d_edges(t):
    e = t("lineage_relationships").select(C.loose_id("source_asset_id").alias("source"), C.loose_id("target_asset_id").alias("target"), "source_job_id", "id", "confidence_score")
    return D.best_edges(e, ["source", "target", "source_job_id"])


@R.add("dedup_D13_seen", f"WITH {SCANS} SELECT DISTINCT asset_id, schema_hash FROM sc WHERE asset_id IS NOT NULL")
def d_seen(t):
    return C.scans(t("data_discovery")).where("asset_id is not null").select("asset_id", "schema_hash").dropDuplicates(["asset_id", "schema_hash"])


@R.add("dedup_D14_redetect", f"SELECT id FROM assets WHERE ({doc('technical_metadata')} ->> '$.pii_version') IS DISTINCT FROM '2'")
def d_redetect(t):
    return D.redetect(t("assets"), "2").select("id")


# profiles, quality


@R.add(
    "prof_I8_A10_types",
    r"""WITH v AS (SELECT event_type AS k, event_id AS o, trim(CAST(v AS VARCHAR)) AS v FROM (SELECT event_type, event_id, unnest(json_extract_string(props, '$.*')) AS v FROM events) WHERE trim(v) <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, v) AS r, count(*) OVER (PARTITION BY k) AS n FROM v),
    h AS (SELECT k, any_value(n) AS n, count(*) FILTER (regexp_matches(v, '^[+-]?[0-9]+(_[0-9]+)*$')) AS i, count(*) FILTER (regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')) AS d,
      count(*) FILTER (regexp_matches(v, '(?i)^(true|false|yes|no|0|1)$')) AS b, count(*) FILTER (regexp_matches(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}).*$')) AS t FROM f WHERE r <= 100 GROUP BY k)
    SELECT k AS event_type, n, CASE WHEN i >= n * 0.8 THEN 'int64' WHEN d >= n * 0.8 THEN 'double' WHEN b >= n * 0.8 THEN 'bool' WHEN t >= n * 0.8 THEN 'date' ELSE 'string' END AS type FROM h""",
)
def i_types(t):
    v = t("events").select("event_type", "event_id", F.explode(F.map_values(F.from_json("props", "map<string,string>"))).alias("v"))
    return Q.inferred_type(v, ["event_type"], "v", "event_id")


@R.add(
    "prof_I9_json_types",
    "SELECT DISTINCT event_type, key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'int64' WHEN 'BIGINT' THEN 'int64' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'bool' ELSE lower(json_type(props, '$.' || key)) END AS type FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)",
)
def i_json(t):
    v = t("events").select("event_type", F.try_parse_json("props").alias("v"), F.explode(F.json_object_keys("props")).alias("key"))
    return v.select("event_type", "key", Q.value_type(F.col("v"), F.col("key")).alias("type")).distinct()


_QUAL = f"""{COLS},
n AS (SELECT asset_id, c ->> '$.name' AS name, coalesce(CAST(c -> '$.nullable' AS BOOLEAN), true) AS nullable FROM cols WHERE c ->> '$.name' IS NOT NULL),
g AS (SELECT asset_id, count(*) AS n, count(*) FILTER (nullable) AS nu, count(*) FILTER (regexp_matches(lower(name), '^(id|.*_pk|pk_.*|.*_key)$')) AS k, bool_or(contains(name, '_')) AS sn, bool_or(regexp_matches(name, '[a-z][A-Z]')) AS ca FROM n GROUP BY 1),
q0 AS (SELECT a.id AS asset_id, g.n, 1 - nu / g.n AS completeness, k / g.n AS uniqueness, CASE WHEN sn AND ca THEN 0.7 ELSE 1.0 END::DOUBLE AS consistency,
  CASE WHEN discovered_at IS NULL THEN 0.5 WHEN date_diff('day', CAST(discovered_at AS DATE), DATE '2025-07-01') <= 30 THEN 1.0 ELSE greatest(0.0, 1 - date_diff('day', CAST(discovered_at AS DATE), DATE '2025-07-01') / 365) END::DOUBLE AS timeliness
  FROM assets a LEFT JOIN g ON g.asset_id = a.id),
q1 AS (SELECT *, coalesce(completeness * 0.3::DOUBLE + uniqueness * 0.2::DOUBLE + 0.2::DOUBLE + consistency * 0.15::DOUBLE + timeliness * 0.15::DOUBLE, 0) AS raw FROM q0),
q AS (SELECT asset_id, round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(consistency, 4) AS consistency, round(timeliness, 4) AS timeliness, round(raw, 4) AS score, raw,
  CASE WHEN n IS NULL THEN 'unknown' WHEN raw >= 0.8 THEN 'good' WHEN raw >= 0.6 THEN 'warning' ELSE 'poor' END AS status FROM q1)"""


@R.add("prof_I10_quality", f"WITH {_QUAL} SELECT asset_id, completeness, uniqueness, consistency, timeliness, score, status FROM q")
def i_quality(t):
    return Q.asset_quality(t("assets"), NOW)


@R.add(
    "prof_I11_impact",
    f"""WITH {_QUAL}, e AS (SELECT id, {sid('source_asset_id')} AS s, {sid('target_asset_id')} AS t, CASE transformation_type WHEN 'pass_through' THEN 0.95 WHEN 'aggregate' THEN 0.9 WHEN 'join' THEN 0.85 WHEN 'complex' THEN 0.8 ELSE 0.9 END::DOUBLE AS k FROM lineage_relationships),
    m AS (SELECT e.id, a.score * k AS ex, b.score AS ts FROM e JOIN q a ON {sid('a.asset_id')} = e.s JOIN q b ON {sid('b.asset_id')} = e.t)
    SELECT id, ex AS expected, ts - ex AS delta, CASE WHEN ts < ex * 0.9::DOUBLE THEN 'high' WHEN ts < ex THEN 'medium' ELSE 'low' END AS risk FROM m""",
)
def i_impact(t):
    return Q.quality_impact(t("lineage_relationships"), Q.asset_quality(t("assets"), NOW))


@R.add(
    "prof_I12_described",
    f"WITH {COLS} SELECT asset_id, count(*) AS n_columns, count(*) FILTER (trim(coalesce(c ->> '$.description', '')) <> '') AS n_described, round(100.0 * count(*) FILTER (trim(coalesce(c ->> '$.description', '')) <> '') / count(*), 2) AS percent, count(DISTINCT lower(c ->> '$.type')) AS n_types FROM cols WHERE c ->> '$.name' IS NOT NULL GROUP BY 1",
)
def i_described(t):
    return Q.description_share(t("assets"))


@R.add(
    "prof_I12_degree",
    f"SELECT asset_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT {sid('source_asset_id')} AS asset_id, 0 AS i, 1 AS o FROM lineage_relationships UNION ALL SELECT {sid('target_asset_id')}, 1, 0 FROM lineage_relationships) WHERE asset_id IS NOT NULL GROUP BY 1",
)
def i_degree(t):
    return Q.lineage_degree(t("lineage_relationships"))


def _f(*p):
    return "coalesce(" + ", ".join(f"nullif(trim({FM} ->> '{x}'), '')" for x in p) + ")"


@R.add(
    "prof_I13_file_facts",
    f"""WITH d AS (SELECT *, list_filter(string_split(coalesce(folder_path, ''), '/'), lambda x: x <> '') AS fo FROM data_discovery)
    SELECT id, coalesce(CAST(trunc(TRY_CAST({_f('$.basic.size_bytes', '$.size')} AS DOUBLE)) AS BIGINT), 0) AS size_bytes, lower(coalesce({_f('$.basic.format', '$.format')}, {_f('$.basic.content_type')}, 'unknown')) AS format,
    nullif(array_to_string(fo[greatest(len(fo) - 1, 1):], '/'), '') AS application_name, CASE WHEN {_f('$.lease_status')} = 'locked' THEN 'restricted' WHEN {_f('$.access_tier', '$.basic.access_tier')} = 'Archive' THEN 'archived' ELSE 'internal' END AS access_level FROM d""",
)
def i_facts(t):
    return Q.file_facts(t("data_discovery"))


# personal data

_LOW = "lower(coalesce(c ->> '$.name', ''))"
_FLAT = r"regexp_replace(low, '[_\-\s]', '', 'g') AS flat"
#: The rules by name, written out for DuckDB: low is the name in lower case, flat the same without separators (fixed values).
_TYPES_BY_NAME = """
CASE WHEN (contains(low, 'email')) OR (contains(low, 'mail') AND NOT contains(low, 'name')) OR (contains(low, 'correo')) THEN 'Email' END,
CASE WHEN (contains(low, 'phone')) OR (contains(low, 'tel')) OR (contains(low, 'mobile')) OR (contains(low, 'cell') AND NOT contains(low, 'name')) THEN 'PhoneNumber' END,
CASE WHEN (contains(low, 'ssn')) OR (contains(low, 'social') AND contains(low, 'security')) OR (contains(low, 'national') AND contains(low, 'id')) OR (contains(low, 'tin')) THEN 'SSN' END,
CASE WHEN (contains(low, 'credit') AND contains(low, 'card')) OR (contains(low, 'card') AND contains(low, 'number')) OR (contains(low, 'ccn')) OR (contains(low, 'cvv')) OR (contains(low, 'cvc')) THEN 'CreditCard' END,
CASE WHEN (contains(low, 'name')) OR (contains(low, 'reviewed') AND contains(low, 'by')) OR (contains(low, 'created') AND contains(low, 'by')) OR (contains(low, 'updated') AND contains(low, 'by')) OR (contains(low, 'owner')) OR (contains(low, 'author')) THEN 'PersonName' END,
CASE WHEN (contains(low, 'address')) OR (contains(low, 'street')) OR (contains(low, 'city')) OR (contains(low, 'zip')) OR (contains(low, 'postal')) OR (contains(low, 'state')) OR (contains(low, 'country')) OR (contains(low, 'addr')) OR (contains(low, 'province')) OR (contains(low, 'county')) THEN 'Address' END,
CASE WHEN (contains(low, 'dob')) OR (contains(low, 'birth') AND contains(low, 'date')) THEN 'DateOfBirth' END,
CASE WHEN (contains(low, 'ip')) THEN 'IPAddress' END,
CASE WHEN (contains(low, 'account') AND contains(low, 'number')) OR (contains(low, 'account') AND contains(low, 'id')) OR (contains(low, 'accountnum')) OR (contains(low, 'accnum')) OR (contains(low, 'account') AND contains(low, 'code')) OR (contains(flat, 'accountid')) THEN 'AccountNumber' END,
CASE WHEN (contains(low, 'customer') AND contains(low, 'id')) OR (contains(low, 'cust') AND contains(low, 'id')) OR (contains(flat, 'customerid')) THEN 'CustomerID' END,
CASE WHEN (contains(low, 'transaction') AND contains(low, 'id')) OR (contains(flat, 'transactionid')) OR (contains(low, 'txn_id')) OR (contains(flat, 'txnid')) THEN 'TransactionID' END,
CASE WHEN (contains(low, 'user') AND contains(low, 'id')) OR (contains(flat, 'userid')) OR (contains(low, 'person') AND contains(low, 'id') AND NOT contains(low, 'name')) THEN 'UserID' END,
CASE WHEN (contains(low, 'passport')) THEN 'PassportNumber' END,
CASE WHEN (contains(low, 'driver') AND contains(low, 'license')) OR (contains(low, 'driving') AND contains(low, 'license')) OR (contains(low, 'dl') AND length(low) < 10) OR (contains(flat, 'driverlic')) THEN 'DriverLicense' END,
CASE WHEN (contains(low, 'bank') AND contains(low, 'account')) OR (contains(low, 'routing') AND contains(low, 'number')) OR (contains(low, 'iban')) OR (contains(low, 'swift')) THEN 'BankAccount' END,
CASE WHEN (contains(low, 'medical') AND contains(low, 'record')) OR (contains(low, 'patient') AND contains(low, 'id')) OR (contains(low, 'diagnosis')) THEN 'MedicalRecord' END,
CASE WHEN (contains(low, 'license') AND contains(low, 'plate')) OR (contains(low, 'plate') AND contains(low, 'number')) OR (contains(low, 'vehicle') AND contains(low, 'registration')) THEN 'LicensePlate' END,
CASE WHEN (contains(low, 'password')) OR (contains(low, 'passwd')) OR (contains(low, 'pwd')) OR (contains(low, 'secret')) OR (contains(low, 'api') AND contains(low, 'key')) OR (contains(low, 'token')) THEN 'Password' END,
CASE WHEN (contains(low, 'gender')) OR (contains(low, 'sex')) THEN 'Gender' END,
CASE WHEN (contains(low, 'race')) OR (contains(low, 'ethnicity')) THEN 'Race' END,
CASE WHEN (contains(low, 'religion')) OR (contains(low, 'religious')) THEN 'Religion' END,
CASE WHEN (contains(low, 'fingerprint')) OR (contains(low, 'iris')) OR (contains(low, 'retina')) OR (contains(low, 'biometric')) THEN 'Biometric' END,
CASE WHEN (ends_with(low, '_id') OR ends_with(flat, 'id')) AND low NOT IN ('alert_id', 'event_id', 'log_id', 'session_id', 'request_id', 'job_id', 'task_id', 'batch_id', 'process_id', 'thread_id') AND NOT (((contains(low, 'customer') AND contains(low, 'id')) OR (contains(low, 'cust') AND contains(low, 'id')) OR (contains(flat, 'customerid'))) OR ((contains(low, 'user') AND contains(low, 'id')) OR (contains(flat, 'userid')) OR (contains(low, 'person') AND contains(low, 'id') AND NOT contains(low, 'name'))) OR ((contains(low, 'account') AND contains(low, 'number')) OR (contains(low, 'account') AND contains(low, 'id')) OR (contains(low, 'accountnum')) OR (contains(low, 'accnum')) OR (contains(low, 'account') AND contains(low, 'code')) OR (contains(flat, 'accountid'))) OR ((contains(low, 'transaction') AND contains(low, 'id')) OR (contains(flat, 'transactionid')) OR (contains(low, 'txn_id')) OR (contains(flat, 'txnid')))) THEN 'ID' END"""


@R.add("pii_I1_I2_names", f"WITH {COLS}, l AS (SELECT asset_id, pos, {_LOW} AS low, {_FLAT} FROM cols WHERE c ->> '$.name' IS NOT NULL) SELECT asset_id, pos, array_to_string(list_sort(list_filter([{_TYPES_BY_NAME}], lambda x: x IS NOT NULL)), ',') AS types FROM l")
def pii_names(t):
    return C.asset_columns(t("assets")).select("asset_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(pii.types_by_name(F.col("name")), ",").alias("types"))


def _rx(p: str) -> str:
    return "(" + " OR ".join("regexp_matches(text, '" + x.replace("'", "''") + "')" for x in p) + ")"


#: The patterns of values, written out (fixed values).
_PATTERNS = (
    ("Email", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\.[A-Z|a-z]{2,}\b",)),
    ("PhoneNumber", (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}\b", r"\b\+?\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", r"\b\d{10,15}\b", r"\b\d{4}[-.\s]?\d{3}[-.\s]?\d{3}\b",)),
    ("SSN", (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b",)),
    ("CreditCard", (r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b", r"\b\d{13,19}\b", r"\b\d{3,4}\b",)),
    ("IPAddress", (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", r"\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",)),
    ("PassportNumber", (r"\b[A-Z]{1,2}\d{6,9}\b", r"\b\d{8,9}\b",)),
    ("DriverLicense", (r"\b[A-Z]{1,2}\d{6,8}\b", r"\b\d{8,16}\b",)),
    ("BankAccount", (r"\b\d{9,17}\b", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",)),
    ("DateOfBirth", (r"\b(0?[1-9]|1[0-2])[/-](0?[1-9]|[12][0-9]|3[01])[/-](19|20)\d{2}\b", r"\b(0?[1-9]|[12][0-9]|3[01])[/-](0?[1-9]|1[0-2])[/-](19|20)\d{2}\b", r"\b(19|20)\d{2}[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12][0-9]|3[01])\b",)),
)
_VT = ", ".join(f"CASE WHEN {_rx(p)} THEN '{k}' END" for k, p in _PATTERNS)


@R.add("pii_I3_values", rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\P{{L}}a-zA-Z]', '_', 'g'), '[^\P{{Nd}}0-9]', '0', 'g'), '[^\P{{N}}0-9]', '_', 'g'), '\p{{Z}}', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_sort(list_filter([{_VT}], lambda x: x IS NOT NULL)), ',') AS types FROM d""")
def pii_values(t):
    return t("documents").where("text is not null").select("doc_id", F.array_join(pii.types_by_value(F.col("text")), ",").alias("types"))


@R.add(
    "pii_I3_samples",
    rf"""WITH v AS (SELECT c_nationkey, c_custkey, c_name || ' ' || c_mktsegment || '@mail.example.com 555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS x FROM customer),
    d AS (SELECT c_nationkey, string_agg(x, ' ' ORDER BY c_custkey) AS text FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM v) WHERE r <= 20 GROUP BY 1)
    SELECT c_nationkey, array_to_string(list_sort(list_filter([{_VT}], lambda x: x IS NOT NULL)), ',') AS types FROM d""",
)
def pii_samples(t):
    """The first twenty values of each group, by key, as the samples of a column."""
    x = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("@mail.example.com 555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")  # ranks are limited before the shuffle
    top = t("customer").select("c_nationkey", "c_custkey", x.alias("x"), F.row_number().over(w).alias("r")).where("r <= 20")
    v = top.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "x"))), lambda y: y["x"]).alias("v"))
    return v.select("c_nationkey", F.array_join(pii.types_by_value(pii.sample_text(F.col("v"))), ",").alias("types"))


@R.add(
    "pii_I6_listing",
    f"""WITH {COLS}, l AS (SELECT asset_id, regexp_matches(lower(coalesce(c ->> '$.name', '') || ' ' || coalesce(c ->> '$.description', '')), 'email|e-mail|mail|phone|mobile|cell|telephone|firstname|lastname|fullname|name|address|street|city|zip|postal|ssn|social|passport|license|id|credit|card|account|bank|birth|age|gender|race|ethnicity|location|gps|coordinate|lat|lng|password|secret|private|confidential') AS p FROM cols WHERE c ->> '$.name' IS NOT NULL)
    SELECT asset_id, count(*) FILTER (p) AS n_personal, count(*) FILTER (NOT p) AS n_safe, round(100.0 * count(*) FILTER (p) / count(*), 2) AS percent FROM l GROUP BY 1""",
)
def pii_listing(t):
    p = pii.listed_as_personal(F.col("name"), F.col("description"))
    return C.asset_columns(t("assets")).groupBy("asset_id").agg(F.count_if(p).alias("n_personal"), F.count_if(~p).alias("n_safe"), F.round(100 * F.count_if(p) / F.count("*"), 2).alias("percent"))


_LEVEL = """CASE WHEN (contains(low, 'ssn')) OR (contains(low, 'social')) THEN 5
WHEN (contains(low, 'credit')) OR (contains(low, 'card')) OR (contains(low, 'payment')) THEN 5
WHEN (contains(low, 'password')) OR (contains(low, 'secret')) OR (contains(low, 'token')) THEN 5
WHEN (contains(low, 'bank')) OR (contains(low, 'routing')) OR (contains(low, 'account')) THEN 5
WHEN (contains(low, 'date') AND contains(low, 'birth')) OR (contains(low, 'date') AND contains(low, 'dob')) THEN 4
WHEN (contains(low, 'address')) OR (contains(low, 'street')) OR (contains(low, 'zipcode')) OR (contains(low, 'postal')) THEN 4
WHEN (contains(low, 'passport')) OR (contains(low, 'license')) OR (contains(low, 'national_id')) THEN 5
WHEN (contains(low, 'email')) OR (contains(low, 'e_mail')) THEN 3
WHEN (contains(low, 'phone')) OR (contains(low, 'mobile')) OR (contains(low, 'cell')) THEN 3
WHEN (contains(low, 'name') AND contains(low, 'first')) OR (contains(low, 'name') AND contains(low, 'last')) OR (contains(low, 'name') AND contains(low, 'full')) THEN 2
WHEN (contains(low, 'id') AND contains(low, 'user')) OR (contains(low, 'id') AND contains(low, 'customer')) OR (contains(low, 'id') AND contains(low, 'person')) THEN 2 ELSE 2 END"""

_TAGS = """CASE WHEN (contains(low, 'ssn')) OR (contains(low, 'social')) THEN 'SSN,CRITICAL_PII,ENCRYPT_AT_REST,ENCRYPT_IN_TRANSIT'
WHEN (contains(low, 'credit')) OR (contains(low, 'card')) OR (contains(low, 'payment')) THEN 'FINANCIAL,PAYMENT_INFO,PCI_DSS,ENCRYPT_AT_REST,ENCRYPT_IN_TRANSIT'
WHEN (contains(low, 'password')) OR (contains(low, 'secret')) OR (contains(low, 'token')) THEN 'CREDENTIALS,AUTH_TOKEN,HASH_AT_REST,NEVER_LOG'
WHEN (contains(low, 'bank')) OR (contains(low, 'routing')) OR (contains(low, 'account')) THEN 'BANKING_INFO,FINANCIAL,ENCRYPT_AT_REST'
WHEN (contains(low, 'date') AND contains(low, 'birth')) OR (contains(low, 'date') AND contains(low, 'dob')) THEN 'DATE_OF_BIRTH,PERSONAL_INFO,ENCRYPT_AT_REST'
WHEN (contains(low, 'address')) OR (contains(low, 'street')) OR (contains(low, 'zipcode')) OR (contains(low, 'postal')) THEN 'ADDRESS,LOCATION,PERSONAL_INFO,ENCRYPT_AT_REST'
WHEN (contains(low, 'passport')) OR (contains(low, 'license')) OR (contains(low, 'national_id')) THEN 'GOVERNMENT_ID,CRITICAL_PII,ENCRYPT_AT_REST,ENCRYPT_IN_TRANSIT'
WHEN (contains(low, 'email')) OR (contains(low, 'e_mail')) THEN 'EMAIL,PERSONAL_INFO,MASK_IN_LOGS'
WHEN (contains(low, 'phone')) OR (contains(low, 'mobile')) OR (contains(low, 'cell')) THEN 'PHONE,PERSONAL_INFO,MASK_IN_LOGS'
WHEN (contains(low, 'name') AND contains(low, 'first')) OR (contains(low, 'name') AND contains(low, 'last')) OR (contains(low, 'name') AND contains(low, 'full')) THEN 'NAME,PERSONAL_INFO,MASK_IN_LOGS'
WHEN (contains(low, 'id') AND contains(low, 'user')) OR (contains(low, 'id') AND contains(low, 'customer')) OR (contains(low, 'id') AND contains(low, 'person')) THEN 'IDENTIFIER,PERSONAL_INFO' ELSE 'GENERAL_PII' END"""


@R.add(
    "pii_I7_tags",
    f"WITH {COLS}, l AS (SELECT asset_id, pos, {_LOW} AS low, {_FLAT} FROM cols WHERE c ->> '$.name' IS NOT NULL AND CAST(c -> '$.pii_detected' AS BOOLEAN)) SELECT asset_id, pos, {_LEVEL} AS level, 'PII,SENSITIVE,DATA_PRIVACY,' || {_TAGS} || ',PII_SENSITIVITY_LEVEL_' || {_LEVEL} AS tags FROM l",
)
def pii_tags(t):
    x = C.asset_columns(t("assets")).where("pii_detected").select("asset_id", F.col("pos").cast("bigint").alias("pos"), pii.recommended_tags(F.col("name")).alias("x"))
    return x.select("asset_id", "pos", "x.level", F.array_join("x.tags", ",").alias("tags"))


# masking: a table of people with the kinds of column the policies look at

PEOPLE = """people AS (SELECT c_custkey AS customer_id, c_name AS full_name, lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.example.co.uk' AS email, '+' || c_nationkey || ' (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
 CAST(1950 + c_custkey % 50 AS VARCHAR) || '-0' || (1 + c_custkey % 9) || '-1' || (c_custkey % 9) AS birth_date, '10.' || c_nationkey || '.0.' || (c_custkey % 250) AS ip_address, (c_custkey % 99) || ' Main Street, ' || c_mktsegment || ' City, S' || c_nationkey AS home_address,
 'Ann ' || c_mktsegment || ' Q' || c_custkey AS person_name, CAST(4000000000000000 + c_custkey AS VARCHAR) AS card_number FROM customer)"""


def _people(t):
    k, n, s = F.col("c_custkey"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    return t("customer").select(
        k.alias("customer_id"), F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail"), n, F.lit(".example.co.uk")).alias("email"),
        F.concat(F.lit("+"), n, F.lit(" (555) "), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
        F.concat((1950 + k % 50).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 9).cast("string")).alias("birth_date"),
        F.concat(F.lit("10."), n, F.lit(".0."), (k % 250).cast("string")).alias("ip_address"),
        F.concat((k % 99).cast("string"), F.lit(" Main Street, "), s, F.lit(" City, S"), n).alias("home_address"),
        F.concat(F.lit("Ann "), s, F.lit(" Q"), k.cast("string")).alias("person_name"), (F.lit(4000000000000000) + k).cast("string").alias("card_number"),
    )


_DIG = "regexp_replace({0}, '[^0-9]', '', 'g')"
_MAIL = "split_part(email, '@', 1) || '@***.' || split_part(email, '.', -1)"
_AGE = "CAST(floor(date_diff('day', CAST(birth_date AS DATE), DATE '2025-07-01') / 365.25) AS BIGINT)"
#: query -> [(policy, column, SQL)]
MASKS = {
    "mask_M1_M5_plain": [("redact", "email", "'***MASKED***'"), ("md5", "email", "md5(email)"), ("sha256", "email", "sha256(email)"), ("show_full", "email", "email"), ("", "phone", "phone")],
    "mask_M6_domain": [("mask_domain", "email", _MAIL), ("mask_domain", "full_name", "left(full_name, 2) || '***' || right(full_name, 2)")],
    "mask_M7_year": [("year_only", "birth_date", "left(birth_date, 4)"), ("year_only", "card_number", "CASE WHEN regexp_matches(card_number, '^[0-9]{4}') THEN CAST(year(TRY_CAST(card_number AS DATE)) AS VARCHAR) ELSE '***MASKED***' END")],
    "mask_M8_last4": [("last_4", "phone", f"'***' || right({_DIG.format('phone')}, 4)"), ("last_4", "card_number", "'***' || right(card_number, 4)")],
    "mask_M9_octet": [("ip_mask", "ip_address", "split_part(ip_address, '.', 1) || '.xxx.xxx.xxx'"), ("ip_mask", "phone", "left(phone, 3) || '***'")],
    "mask_M10_M11_part": [("partial", "full_name", "left(full_name, 2) || '***' || right(full_name, 2)"), ("first_letter", "full_name", "left(full_name, 1) || '***'")],
    "mask_M12_age": [("age_range", "birth_date", f"{_AGE} || '-' || ({_AGE} + 9) || ' years'")],
    "mask_M13_auto": [
        ("auto", "email", _MAIL), ("auto", "phone", f"'***' || right({_DIG.format('phone')}, 4)"), ("auto", "birth_date", "left(birth_date, 4)"), ("auto", "ip_address", "split_part(ip_address, '.', 1) || '.xxx.xxx.xxx'"),
        ("auto", "customer_id", "md5(CAST(customer_id AS VARCHAR))"), ("auto", "full_name", "left(full_name, 1) || '***'"), ("auto", "home_address", "left(home_address, 3) || '***' || right(home_address, 3)"),
        ("auto", "card_number", "'****-****-****-' || right(card_number, 4)"), ("auto", "person_name", "md5(person_name)"),
    ],
    "mask_M14_M15_ends": [("show_first_3", "full_name", "left(full_name, 3) || '***'"), ("last_6", "card_number", "'***' || right(card_number, 6)"), ("first_x", "full_name", "left(full_name, 2) || '***'")],
    "mask_M16_initials": [("initials", "person_name", "left(split_part(person_name, ' ', 1), 1) || '.' || left(split_part(person_name, ' ', 2), 1) || '.' || left(split_part(person_name, ' ', 3), 1) || '.'"), ("initials", "email", "left(email, 1) || '***'")],
    "mask_M17_M18_place": [("city_only", "home_address", "trim(split_part(home_address, ',', -2))"), ("state_only", "home_address", "trim(split_part(home_address, ',', -1))"), ("city_only", "phone", "left(phone, 3) || '***'")],
    "mask_M19_M20_other": [("upper(x)", "email", "md5(email)"), ("no such policy", "phone", "md5(phone)")],
}


def _mask_query(items):
    def run(t):
        return _people(t).select(F.col("customer_id").alias("key"), *(masking.mask(p, c, today=F.lit(date(2025, 7, 1))).cast("string").alias(f"m{i}_{c}") for i, (p, c, _) in enumerate(items)))

    return run


for _name, _items in MASKS.items():
    R.add(_name, f"WITH {PEOPLE} SELECT customer_id AS key, " + ", ".join(f"CAST({q} AS VARCHAR) AS m{i}_{c}" for i, (_, c, q) in enumerate(_items)) + " FROM people")(_mask_query(_items))

VIEW_COLUMNS = [
    {"name": "customer_id"},
    {"name": "email", "pii_detected": True, "masking_logic_analytical": "mask_domain", "masking_logic_operational": "show_full"},
    {"name": "phone", "pii_detected": True},
    {"name": "full_name", "pii_detected": True, "masking_logic_operational": "first_letter"},
]


@R.add("mask_M21_K11_view", f"WITH {PEOPLE} SELECT customer_id, email, {_MAIL} AS email_masked, phone, '***MASKED***' AS phone_masked, full_name, '***MASKED***' AS full_name_masked FROM people")
def mask_view(t):
    return masking.masked_view(_people(t), VIEW_COLUMNS)


@R.add(
    "mask_M22_summary",
    f"""WITH {COLS}, m AS (SELECT asset_id, pos, c ->> '$.name' AS name, coalesce(CAST(c -> '$.pii_detected' AS BOOLEAN), false) AS pii_detected, coalesce(trim(c ->> '$.masking_logic_analytical'), '') AS policy FROM cols WHERE c ->> '$.name' <> '')
    SELECT *, CASE WHEN NOT pii_detected THEN 'unmasked' WHEN policy = '' THEN 'redacted' WHEN lower(policy) IN ('show_full', 'none', 'no_mask', 'unmasked', 'original') THEN 'unmasked' ELSE 'masked' END AS effective_mode, pii_detected AS has_masked_column FROM m""",
)
def mask_summary(t):
    c = C.asset_columns(t("assets")).withColumn("pos", F.col("pos").cast("bigint"))
    return masking.masking_summary(c)


@R.add("mask_M22_M24_view_trino", f"WITH {PEOPLE} SELECT customer_id, email, phone, '***MASKED***' AS phone_masked, full_name, left(full_name, 1) || '***' AS full_name_masked FROM people")
def mask_view_trino(t):
    return masking.masked_view(_people(t), VIEW_COLUMNS, "operational", "trino")
