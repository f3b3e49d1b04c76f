"""Personal data by column name and by sampled values: rule tables turned into column expressions."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

class Case(NamedTuple):
    """One way for a rule to hold of a lower-cased name."""

    words: tuple[str, ...] = ()  # all must occur in the name
    without: str | None = None  # must not occur
    squeezed: str | None = None  # must occur in the name without separators
    shorter: int | None = None  # the name is shorter than that


def has(*words: str, without: str | None = None, shorter: int | None = None) -> Case:
    return Case(words, without, None, shorter)


def squeezed(word: str) -> Case:
    return Case(squeezed=word)


#: Type and its cases, one of which must hold (fixed values).
NAME_RULES = (
    ("Email", (has("email"), has("mail", without="name"), has("correo"),)),
    ("PhoneNumber", (has("phone"), has("tel"), has("mobile"), has("cell", without="name"),)),
    ("SSN", (has("ssn"), has("social", "security"), has("national", "id"), has("tin"),)),
    ("CreditCard", (has("credit", "card"), has("card", "number"), has("ccn"), has("cvv"), has("cvc"),)),
    ("PersonName", (has("name"), has("reviewed", "by"), has("created", "by"), has("updated", "by"), has("owner"), has("author"),)),
    ("Address", (has("address"), has("street"), has("city"), has("zip"), has("postal"), has("state"), has("country"), has("addr"), has("province"), has("county"),)),
    ("DateOfBirth", (has("dob"), has("birth", "date"),)),
    ("IPAddress", (has("ip"),)),
    ("AccountNumber", (has("account", "number"), has("account", "id"), has("accountnum"), has("accnum"), has("account", "code"), squeezed("accountid"),)),
    ("CustomerID", (has("customer", "id"), has("cust", "id"), squeezed("customerid"),)),
    ("TransactionID", (has("transaction", "id"), squeezed("transactionid"), has("txn_id"), squeezed("txnid"),)),
    ("UserID", (has("user", "id"), squeezed("userid"), has("person", "id", without="name"),)),
    ("PassportNumber", (has("passport"),)),
    ("DriverLicense", (has("driver", "license"), has("driving", "license"), has("dl", shorter=10), squeezed("driverlic"),)),
    ("BankAccount", (has("bank", "account"), has("routing", "number"), has("iban"), has("swift"),)),
    ("MedicalRecord", (has("medical", "record"), has("patient", "id"), has("diagnosis"),)),
    ("LicensePlate", (has("license", "plate"), has("plate", "number"), has("vehicle", "registration"),)),
    ("Password", (has("password"), has("passwd"), has("pwd"), has("secret"), has("api", "key"), has("token"),)),
    ("Gender", (has("gender"), has("sex"),)),
    ("Race", (has("race"), has("ethnicity"),)),
    ("Religion", (has("religion"), has("religious"),)),
    ("Biometric", (has("fingerprint"), has("iris"), has("retina"), has("biometric"),)),
)
#: Ids of things, not of people, and the types that make the generic one needless (fixed values).
NOT_PERSONAL = ("alert_id", "event_id", "log_id", "session_id", "request_id", "job_id", "task_id", "batch_id", "process_id", "thread_id")
SPECIFIC_IDS = ("CustomerID", "UserID", "AccountNumber", "TransactionID")

#: Type and patterns of values (fixed values).
VALUE_RULES = (
    ("Email", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\.[A-Z|a-z]{2,}\b")),
    ("PhoneNumber", (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}\b", r"\b\+?\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", r"\b\d{10,15}\b", r"\b\d{4}[-.\s]?\d{3}[-.\s]?\d{3}\b")),
    ("SSN", (r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b")),
    ("CreditCard", (r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b", r"\b\d{13,19}\b", r"\b\d{3,4}\b")),
    ("IPAddress", (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", r"\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b")),
    ("PassportNumber", (r"\b[A-Z]{1,2}\d{6,9}\b", r"\b\d{8,9}\b")),
    ("DriverLicense", (r"\b[A-Z]{1,2}\d{6,8}\b", r"\b\d{8,16}\b")),
    ("BankAccount", (r"\b\d{9,17}\b", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b")),
    ("DateOfBirth", (r"\b(0?[1-9]|1[0-2])[/-](0?[1-9]|[12][0-9]|3[01])[/-](19|20)\d{2}\b", r"\b(0?[1-9]|[12][0-9]|3[01])[/-](0?[1-9]|1[0-2])[/-](19|20)\d{2}\b", r"\b(19|20)\d{2}[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12][0-9]|3[01])\b")),
)
#: The patterns among them that most numbers meet.
LOOSEST = (VALUE_RULES[1][1][2], VALUE_RULES[3][1][2], VALUE_RULES[8][1][2])
#: Substrings that mark a column as personal in listings (fixed values).
LISTING_WORDS = (
    "email e-mail mail phone mobile cell telephone firstname lastname fullname name address street city zip postal ssn social passport license id "
    "credit card account bank birth age gender race ethnicity location gps coordinate lat lng password secret private confidential"
)
#: Rule, sensitivity and tags of a personal column; the first rule that holds counts (fixed values).
TAG_RULES = (
    ((has("ssn"), has("social"),), 5, "SSN CRITICAL_PII ENCRYPT_AT_REST ENCRYPT_IN_TRANSIT"),
    ((has("credit"), has("card"), has("payment"),), 5, "FINANCIAL PAYMENT_INFO PCI_DSS ENCRYPT_AT_REST ENCRYPT_IN_TRANSIT"),
    ((has("password"), has("secret"), has("token"),), 5, "CREDENTIALS AUTH_TOKEN HASH_AT_REST NEVER_LOG"),
    ((has("bank"), has("routing"), has("account"),), 5, "BANKING_INFO FINANCIAL ENCRYPT_AT_REST"),
    ((has("date", "birth"), has("date", "dob"),), 4, "DATE_OF_BIRTH PERSONAL_INFO ENCRYPT_AT_REST"),
    ((has("address"), has("street"), has("zipcode"), has("postal"),), 4, "ADDRESS LOCATION PERSONAL_INFO ENCRYPT_AT_REST"),
    ((has("passport"), has("license"), has("national_id"),), 5, "GOVERNMENT_ID CRITICAL_PII ENCRYPT_AT_REST ENCRYPT_IN_TRANSIT"),
    ((has("email"), has("e_mail"),), 3, "EMAIL PERSONAL_INFO MASK_IN_LOGS"),
    ((has("phone"), has("mobile"), has("cell"),), 3, "PHONE PERSONAL_INFO MASK_IN_LOGS"),
    ((has("name", "first"), has("name", "last"), has("name", "full"),), 2, "NAME PERSONAL_INFO MASK_IN_LOGS"),
    ((has("id", "user"), has("id", "customer"), has("id", "person"),), 2, "IDENTIFIER PERSONAL_INFO"),
)


def holds(cases: tuple[Case, ...], name: Column) -> Column:
    """Whether one of the cases holds, as an expression over a lower-cased name."""
    clean = F.regexp_replace(name, r"[_\-\s]", "")

    def one(c: Case) -> Column:
        parts = [name.contains(w) for w in c.words]
        if c.without is not None:
            parts.append(~name.contains(c.without))
        if c.squeezed is not None:
            parts.append(clean.contains(c.squeezed))
        if c.shorter is not None:
            parts.append(F.length(name) < c.shorter)
        return reduce(Column.__and__, parts)

    return reduce(Column.__or__, map(one, cases))


def types_by_name(name: Column) -> Column:
    """Sorted array of the types that a column's name suggests; empty for null and blank names."""
    low = F.lower(F.coalesce(name, F.lit("")))
    clean = F.regexp_replace(low, r"[_\-\s]", "")
    rules = dict(NAME_RULES)
    specific = reduce(Column.__or__, (holds(rules[t], low) for t in SPECIFIC_IDS))
    generic = (low.endswith("_id") | clean.endswith("id")) & ~low.isin(*NOT_PERSONAL) & ~specific
    found = [F.when(holds(r, low), F.lit(t)) for t, r in NAME_RULES] + [F.when(generic, F.lit("ID"))]
    return F.array_sort(F.array_compact(F.array(*found)))


def any_script(pattern: str) -> str:
    """The pattern with digits and blanks of every script."""
    return pattern.replace(r"[-.\s]", r"[-.\s\p{Z}]").replace(r"\s?", r"[\s\p{Z}]?").replace(r"\s\d", r"[\s\p{Z}]\d").replace(r"\d", r"\p{Nd}")


def types_by_value(text: Column) -> Column:
    """Sorted array of the types whose patterns occur in a text.

    Numbers that are no digits count as letters of a word and accents as none, so that word borders fall
    where they do in every script; both are replaced first by characters that no pattern names, in texts
    that are not plain ASCII. What a pattern cannot do without (an @, a digit, eight digits in a row) is looked for
    first, so few texts meet the dear patterns."""
    other = F.regexp_replace(F.regexp_replace(text, r"[\p{Nl}\p{No}]", "\u0436"), r"\p{Mn}", "\u00b7")
    text = F.when(F.octet_length(text) == F.length(text), text).otherwise(other)
    digit, six, row = text.rlike(r"\p{Nd}"), text.rlike(r"\p{Nd}{6}"), text.rlike(r"\p{Nd}{8}")

    def found_by(p: str) -> Column:
        first = re.match(r"\\b\\d\{(\d+)", p)
        need = text.contains("@") if "@" in p else text.contains(":") if ":)" in p else row if first and int(first[1]) >= 8 else six if r"\d{6," in p else digit
        return need & text.rlike(any_script(p))

    # a rule's loosest pattern comes first: most texts with a number meet it and are spared the others
    each = ((t, sorted(patterns, key=lambda p: p not in LOOSEST)) for t, patterns in VALUE_RULES)
    found = [F.when(reduce(Column.__or__, map(found_by, patterns)), F.lit(t)) for t, patterns in each]
    return F.array_sort(F.array_compact(F.array(*found)))


def sample_text(values: Column, at_most: int = 20) -> Column:
    """The first values of an ordered array as one text for types_by_value."""
    return F.concat_ws(" ", F.slice(values, 1, at_most))


def listed_as_personal(name: Column, about: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(about, F.lit(""))))
    return text.rlike("|".join(LISTING_WORDS.split()))


def recommended_tags(name: Column) -> Column:
    """struct(tags, level) for a personal column."""
    low = F.lower(name)

    def made(level: int, words: str) -> Column:
        tags = ["PII", "SENSITIVE", "DATA_PRIVACY", *words.split(), f"PII_SENSITIVITY_LEVEL_{level}"]
        return F.struct(F.array(*map(F.lit, tags)).alias("tags"), F.lit(level).alias("level"))

    out = made(2, "GENERAL_PII")
    for rule, level, words in reversed(TAG_RULES):
        out = F.when(holds(rule, low), made(level, words)).otherwise(out)
    return out
