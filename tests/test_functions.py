import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from metaloom.functions import masking, paths, pii


def names(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n string")
    return {r.n: r.t for r in df.select("n", pii.types_by_name(F.col("n")).alias("t")).collect()}


def test_pii_by_name(spark):
    got = names(spark, ["Email_Addr", "mail_name", "rating", "description", "customer_id", "event_id", "order_id", "userId", "account-number", "dl_no", "driverlic", "api key", "creditCardNumber", "x", "", None, "cell_name", "birth_date"])
    assert got["Email_Addr"] == ["Address", "Email"]
    assert got["mail_name"] == ["PersonName"]
    assert got["rating"] == ["SSN"] and got["description"] == ["IPAddress"]
    assert got["customer_id"] == ["CustomerID"] and got["event_id"] == [] and got["order_id"] == ["ID"]
    assert got["userId"] == ["UserID"] and got["account-number"] == ["AccountNumber"]
    assert "DriverLicense" in got["dl_no"] and "DriverLicense" in got["driverlic"]
    assert got["api key"] == ["Password"] and "CreditCard" in got["creditCardNumber"]
    assert got["x"] == [] and got[""] == [] and got[None] == [] and got["cell_name"] == ["PersonName"]
    assert got["birth_date"] == ["DateOfBirth"]


def test_pii_by_value_is_what_python_finds(spark):
    texts = ["a@b.co", "call (555) 123-4567", "123-45-6789", "4111 1111 1111 1111", "ip 10.0.0.255.", "é1234é", "1234²", "１２３４", "AB1234567", "DE44X1234", "12/31/1999 x", "1999/12/31", "no", "", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "12 34 56"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", pii.types_by_value(F.col("t")).alias("x")).collect():
        want = sorted(k for k, ps in pii.VALUE_RULES if any(re.search(p, r.t) for p in ps))
        assert r.x == want, r.t


def test_tags(spark):
    df = spark.createDataFrame([("ssn",), ("first_name",), ("zz",)], "n string")
    got = {r.n: r.x for r in df.select("n", pii.recommended_tags(F.col("n")).alias("x")).collect()}
    assert got["ssn"].level == 5 and "ENCRYPT_AT_REST" in got["ssn"].tags and got["first_name"].level == 2 and got["zz"].tags[3] == "GENERAL_PII"


ROW = {"email": "jo.doe@mail.example.com", "phone": "+1 (555) 010-9999", "birth_date": "1980-07-02", "ip_address": "10.1.2.3", "home_address": "1 Main St, Big City, TX", "full_name": "Ann Bea Cee Dee", "card_no": "4000123412341234", "user_id": "77", "ssn": "123-45-6789", "misc": "value"}


@pytest.mark.parametrize(
    "policy, name, want",
    [
        ("redact", "misc", "***MASKED***"), (" HASH ", "misc", "2063c1608d6e0baf80249c42e2be5804"), ("none", "misc", "value"), ("", "misc", "value"), (None, "misc", "value"), ("email_mask", "email", "jo.doe@***.com"), ("email_mask", "misc", "va***ue"),
        ("year_only", "birth_date", "1980"), ("year_only", "misc", "***MASKED***"), ("last_4", "phone", "***9999"), ("last_4", "misc", "***alue"), ("ip_mask", "ip_address", "10.xxx.xxx.xxx"), ("ip_mask", "misc", "val***"),
        ("partial", "misc", "va***ue"), ("first_letter", "misc", "v***"), ("age_only", "birth_date", "44-53 years"), ("auto", "email", "jo.doe@***.com"), ("auto", "phone", "***9999"), ("auto", "birth_date", "1980"),
        ("auto", "ssn", "***-**-****"), ("auto", "card_no", "****-****-****-1234"), ("auto", "full_name", "A***"), ("auto", "home_address", "1 M*** TX"), ("show_first_3", "misc", "val***"), ("last_x", "misc", "***alue"),
        ("initials", "full_name", "A.B.C."), ("city_only", "home_address", "Big City"), ("state_only", "home_address", "TX"), ("upper(misc)", "misc", "2063c1608d6e0baf80249c42e2be5804"), ("what", "misc", "2063c1608d6e0baf80249c42e2be5804"),
    ],
)
def test_mask(spark, policy, name, want):
    df = spark.createDataFrame([(ROW[name],)], f"{name} string")
    assert df.select(masking.mask(policy, name, today=F.lit(date(2025, 7, 1))).cast("string")).first()[0] == want
    assert spark.createDataFrame([(None,)], f"{name} string").select(masking.mask(policy, name, today=F.lit(date(2025, 7, 1))).cast("string")).first()[0] in (None, "***MASKED***", "***-**-****")


def test_mask_encrypts_with_a_key_only(spark):
    df = spark.createDataFrame([("secret",)], "misc string")
    with pytest.raises(ValueError):
        masking.mask("encrypt", "misc")
    c = masking.mask("encrypt", "misc", key="k")
    back = F.aes_decrypt(F.unbase64(c), F.unhex(F.sha2(F.lit("k"), 256)), F.lit("ECB")).cast("string")
    assert df.select(back).first()[0] == "secret" and df.select(c).first()[0] != "secret"
    assert df.select(masking.mask("upper(misc)", "misc", allow_raw=True)).first()[0] == "SECRET"


def test_views_quote_names(spark):
    df = spark.createDataFrame([("a", "b")], "`odd name` string, `x.y` string")
    v = masking.masked_view(df, [{"name": "odd name", "pii_detected": True}, {"name": "x.y"}])
    assert v.columns == ["odd name", "odd name_masked", "x.y"] and v.first()[1] == "***MASKED***"
    assert masking.quoted('a"b', '"') == '"a""b"'


def test_paths(spark):
    rows = ["abfss://c@acct.dfs.core.windows.net/a/b.csv", "HTTPS://acct.blob.core.windows.net/c/a/b", "s3://bkt/k/x.parquet", "cont/a/b", "gs://x/y", "plain", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = {r.p: r.x for r in df.select("p", paths.storage_location(F.col("p")).alias("x")).collect()}
    assert tuple(got[rows[0]]) == ("azure_datalake", "acct", "c", "a/b.csv", "abfss")
    assert tuple(got[rows[1]]) == ("azure_blob", "acct", "c", "a/b", "https")
    assert tuple(got[rows[2]]) == ("aws_s3", None, "bkt", "k/x.parquet", "s3")
    assert tuple(got[rows[3]]) == ("azure_blob", "unknown", "cont", "a/b", "https")
    assert all(got[r] is None for r in rows[4:])
    f = {r.p: tuple(r)[1:] for r in df.select("p", paths.folder_of(F.col("p")), paths.file_of(F.col("p")), paths.norm_path(F.col("p"))).collect()}
    assert f["cont/a/b"] == ("cont/a", "b", "cont/a/b") and f["plain"] == ("", "plain", "plain") and f[None] == (None, None, None)
    u = spark.range(1).select(paths.identifier_urn(F.lit("a.b.c")), paths.identifier_urn(F.lit("a.b")), paths.identifier_urn(F.lit("a")), paths.identifier_urn(F.lit("urn:x")), paths.urn_asset(F.lit("urn:d:o:c.s.t.v")), paths.urn_asset(F.lit("urn:d:o:c.t"))).first()
    assert u[0] == "urn:dataset:oracle:a.b.c" and u[1] == "urn:dataset:azure-blob:a.b" and u[2] == "urn:dataset:unknown:a" and u[3] == "urn:x" and tuple(u[4]) == ("c", "t.v") and tuple(u[5]) == ("c", "t")
