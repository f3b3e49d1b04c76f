"""Masking policies as column expressions, chosen by policy and by keywords in the column's name."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKED = "***MASKED***"
#: Policy names by behaviour (fixed values).
POLICIES = {
    "fixed": "redact mask_all pii_redact mask hide nullify",
    "encrypt": "encrypt pii_encrypt encryption aes_encrypt",
    "md5": "hash hashing pii_hashing pii_hash md5",
    "sha256": "sha256",
    "keep": "show_full none no_mask unmasked original",
    "domain": "mask_domain email_mask hide_domain",
    "year": "show_year_only year_only mask_date hide_date",
    "last4": "show_last_4 last_4 phone_mask mask_phone",
    "octet": "show_first_octet ip_mask mask_ip first_octet",
    "partial": "partial_mask partial mask_partial",
    "letter": "show_first_letter first_letter mask_first_letter",
    "age": "show_age_range age_range age_only",
    "auto": "default auto smart intelligent",
    "initials": "show_initials initials show_initials_only",
    "city": "show_city_only city_only mask_address_keep_city",
    "state": "show_state_only state_only mask_address_keep_state",
}
BEHAVIOUR = {name: kind for kind, names in POLICIES.items() for name in names.split()}


def behaviour(policy: str | None) -> tuple[str, int | None]:
    """(behaviour, n) of a policy name; blank keeps the value, an unknown name hashes it."""
    p = (policy or "").lower().strip()
    if not p:
        return "keep", None
    if p in BEHAVIOUR:
        return BEHAVIOUR[p], None
    if m := re.fullmatch(r"(?:show_)?(first|last)_(.*)", p):
        tail = m[2].split("_")[-1]
        n = int(tail) if re.fullmatch(r"[+-]?\d+", tail) else (2 if m[1] == "first" else 4)
        return m[1], n
    if "(" in p or p in ("null", "true", "false"):
        return "raw", None
    logging.getLogger(__name__).warning("unknown masking policy %s: hashing", p)
    return "md5", None


def _any(name: str, words: str) -> bool:
    return any(w in name for w in words.split())


def mask(policy: str | None, name: str, c: Column | None = None, today: Column | None = None, key: str | None = None, allow_raw: bool = False, dialect: str = "mysql") -> Column:
    """A column under a policy. Null stays null except under fixed values.

    today is the date ages are counted to, the current date unless given. Encryption needs a key.
    A raw SQL policy is only taken with allow_raw, for it runs as written; else it is hashed."""
    raw = F.col(f"`{name}`") if c is None else c
    low = name.lower()
    s = raw.cast("string")
    digits = F.regexp_replace(s, "[^0-9]", "")
    stars = F.lit("***")
    today = F.current_date() if today is None else today
    kind, n = behaviour(policy)
    is_mail, is_phone = _any(low, "email mail"), _any(low, "phone mobile tel")

    def ends(k: int) -> Column:
        return F.concat(F.left(s, F.lit(k)), stars, F.right(s, F.lit(k)))

    def mail() -> Column:
        return F.concat(F.substring_index(s, "@", 1), F.lit("@***."), F.substring_index(F.substring_index(s, "@", -1), ".", -1))

    def years() -> Column:
        return F.floor(F.date_diff(today, raw.try_cast("date")) / F.lit(365.25))

    if kind == "auto":
        if is_mail:
            kind = "domain"
        elif is_phone:
            kind = "last4"
        elif _any(low, "birth dob"):
            return F.year(raw.try_cast("date")).cast("string")
        elif "ip" in low and "address" in low:
            kind = "octet"
        elif low.endswith("_id") or (low.endswith("id") and len(low) > 2):
            kind = "md5"
        elif "name" in low and _any(low, "first last full"):
            kind = "letter"
        elif _any(low, "address street city"):
            return ends(3)
        elif _any(low, "ssn social"):
            return F.lit("***-**-****")
        elif _any(low, "card credit"):
            return F.concat(F.lit("****-****-****-"), F.right(digits, F.lit(4)))
        else:
            kind = "md5"
    if kind == "keep":
        return raw
    if kind == "fixed":
        return F.lit(MASKED)
    if kind == "encrypt":
        if dialect == "trino":
            return F.md5(s)
        if not key:
            raise ValueError("encryption needs a key")
        return F.base64(F.aes_encrypt(s, F.unhex(F.sha2(F.lit(key), 256)), F.lit("ECB")))
    if kind == "md5":
        return F.md5(s)
    if kind == "sha256":
        return F.sha2(s, 256)
    if kind == "domain":
        return mail() if is_mail else ends(2)
    if kind == "year":
        if _any(low, "date birth dob timestamp"):
            return F.year(raw.try_cast("date")).cast("string")
        return F.when(s.rlike("^[0-9]{4}"), F.year(s.try_cast("date")).cast("string")).otherwise(F.lit(MASKED))
    if kind == "last4":
        return F.concat(stars, F.right(digits if is_phone else s, F.lit(4)))
    if kind == "octet":
        if "ip" in low and "addr" in low:
            return F.concat(F.substring_index(s, ".", 1), F.lit(".xxx.xxx.xxx"))
        return F.concat(F.left(s, F.lit(3)), stars)
    if kind == "partial":
        return ends(2)
    if kind == "letter":
        return F.concat(F.left(s, F.lit(1)), stars)
    if kind == "age":
        y = years()
        if _any(low, "birth dob age"):
            return F.concat(y.cast("string"), F.lit("-"), (y + 9).cast("string"), F.lit(" years"))
        return F.when(s.rlike("^[0-9]{4}"), F.concat(y.cast("string"), F.lit(" years"))).otherwise(F.lit(MASKED))
    if kind == "first":
        return F.concat(F.left(s, F.lit(n)), stars)
    if kind == "last":
        return F.concat(stars, F.right(s, F.lit(n)))
    if kind == "initials":
        if "name" not in low:
            return F.concat(F.left(s, F.lit(1)), stars)
        words = F.slice(F.split(s, " "), 1, 3 if dialect == "mysql" else 2)
        text = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ".")
        return F.concat(text, F.lit(".")) if dialect == "mysql" else text
    if kind == "city":
        if _any(low, "address street"):
            return F.trim(F.substring_index(F.substring_index(s, ",", -2), ",", 1))
        return F.concat(F.left(s, F.lit(3)), stars)
    if kind == "state":
        if _any(low, "address street"):
            return F.trim(F.substring_index(s, ",", -1))
        return F.concat(F.left(s, F.lit(2)), stars)
    if kind == "raw" and allow_raw:
        return F.expr(str(policy).lower().strip())
    return F.md5(s)


def quoted(name: str, mark: str = "`") -> str:
    """An identifier in quotes, quotes inside doubled."""
    return mark + name.replace(mark, mark * 2) + mark


def masked_view(df: DataFrame, columns: list[dict], audience: str = "analytical", dialect: str = "mysql", **options) -> DataFrame:
    """The table with a {name}_masked column beside every personal one.

    columns holds name, pii_detected, masking_logic_analytical and masking_logic_operational. For
    analysts a personal column without a policy is redacted; operations see one only with a policy
    (in the trino dialect it is redacted too, and left out where the policy shows everything)."""
    out: list[Column] = []
    for c in columns:
        name = c.get("name")
        if not name:
            continue
        out.append(F.col(quoted(name)))
        if not c.get("pii_detected"):
            continue
        policy = c.get(f"masking_logic_{audience}")
        if not policy and (audience == "analytical" or dialect == "trino"):
            policy = "redact"
        if policy and not (dialect == "trino" and behaviour(policy)[0] == "keep"):
            out.append(mask(policy, name, F.col(quoted(name)), dialect=dialect, **options).alias(f"{name}_masked"))
    return df.select(*out)


def masking_summary(columns: DataFrame, audience: str = "analytical") -> DataFrame:
    """(asset_id, pos, name, pii_detected, policy, effective_mode, has_masked_column) of rows of catalog columns: what a
    masked view does with each. unmasked is a column that is not personal or whose policy shows everything, redacted a
    personal one without a policy, masked any other. Columns without a name are left out."""
    policy = F.coalesce(F.trim(f"masking_logic_{audience}"), F.lit(""))
    personal = F.coalesce("pii_detected", F.lit(False))
    mode = F.when(~personal, "unmasked").when(policy == "", "redacted").when(F.lower(policy).isin(*POLICIES["keep"].split()), "unmasked").otherwise("masked")
    return columns.where("name <> ''").select("asset_id", "pos", "name", personal.alias("pii_detected"), policy.alias("policy"), mode.alias("effective_mode"), personal.alias("has_masked_column"))
