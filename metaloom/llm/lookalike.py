"""Visually identical text with different characters, brought to one form.

The normal form is the named one: compatibility normalisation composed, full case folding, mapped blanks,
removal of default-ignorable characters, and letters of the same shape from other scripts made plain. It
finds the candidates: texts of one normal form. It also makes equal what a reader can tell apart (case,
raised and ringed digits), so an exact check decides among the candidates: the visible form keeps all that
a reader can see and nothing else. Texts with one visible form always have one normal form, so no pair is
lost, and the check is made only for texts that share their normal form with another text.

Only digests leave a task, one normalisation for each distinct text of a batch and one check for each
distinct candidate. Copies are aggregated to one row per text before anything is joined, so copies never
meet each other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.util import arrow_map, cut

#: Default-ignorable code points (fixed values of the character database).
IGNORABLE = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
#: Kinds of blank, of hyphen and of line end (fixed values).
BLANK = "0009 00A0 1680 2000-200A 202F 205F 3000"
HYPHEN = "2010 2011 2043 FE63 FF0D"
LINE_END = "0085 2028"
#: Letters of the same shape, as pairs of a letter and its plain form (fixed values).
SAME_SHAPE = (
    "аa еe оo рp сc хx уy іi јj ѕs ԁd һh ԛq ԝw ӏl ԍg ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ԌG ԚQ ԜW ҮY "
    "ⲀA ⲂB ⲌZ ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX ⲭx ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ᎠD ᎡR ᎢT ᎩY ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏒR ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB "
    "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC ͿJ օo սu հh ոn ՕO ՍU ɑa ɡg"
)
#: Forms that a font, a width or a place in the line gives to a letter; other tags are visible.
PLAIN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")
#: Compatibility characters that a reader can tell from their plain text (fixed values).
VISIBLE = "017F 1E9B 03D0-03D6 03F0-03F5 2100-2101 2105-2106 2116 2121 213B 2474-24B5 1F100-1F12F 3200-33FF A69C-A69D"


def _points(ranges: str):
    for part in ranges.split():
        a, _, b = part.partition("-")
        yield from range(int(a, 16), int(b or a, 16) + 1)


@lru_cache(1)
def tables() -> tuple[dict, dict]:
    """(first pass: single characters, second pass: base letters after decomposition)."""
    first: dict[int, str | None] = {}
    visible = set(_points(VISIBLE))
    for i in range(0xA0, 0x30000):
        tag = unicodedata.decomposition(chr(i)).partition(" ")[0]
        if tag in PLAIN_TAGS and i not in visible:
            plain = unicodedata.normalize("NFKC", chr(i))
            if not plain.startswith(" ") or len(plain) == 1:
                first[i] = plain
    first |= {i: " " for i in _points(BLANK)} | {i: "-" for i in _points(HYPHEN)} | {i: "\n" for i in _points(LINE_END)} | {i: None for i in _points(IGNORABLE)}
    shape = {ord(p[0]): p[1] for p in SAME_SHAPE.split()}
    return {i: c for i, c in first.items() if i not in shape}, shape


def visible_form(text: str) -> str:
    """Equal for texts that look the same, different where a reader can tell them apart."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text.replace("\t", " ")
    first, shape = tables()
    text = unicodedata.normalize("NFD", text.translate(first)).translate(shape)
    return unicodedata.normalize("NFC", text)


@lru_cache(1)
def _folding() -> dict:
    """Blanks, hyphens, line ends, ignorable characters and base letters, after decomposition."""
    first, shape = tables()
    return {i: c for i, c in first.items() if c is None or c in (" ", "-", "\n")} | shape


@lru_cache(1)
def _early() -> re.Pattern:
    """Letters of a plain shape that decomposition would turn into others."""
    return re.compile("[" + "".join(chr(i) for i in tables()[1] if unicodedata.normalize("NFKD", chr(i)) != unicodedata.normalize("NFD", chr(i))) + "]")


def normal_form(text: str) -> str:
    """Compatibility normalisation, composed, full case folding, one kind of blank and hyphen, nothing
    ignorable. It never tells apart what the visible form makes equal."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text.replace("\t", " ").lower()
    if _early().search(text):
        text = text.translate(tables()[1])
    apart = unicodedata.normalize("NFKD", text)
    t = apart.translate(_folding())
    if len(t) != len(apart):  # marks that an ignorable character kept apart come into order
        t = unicodedata.normalize("NFKD", t)
    return unicodedata.normalize("NFKC", t.casefold())


def digest(t: str) -> bytes:
    return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look_text, norm_text) of every text; null and blank texts have no row."""
    return _mapped(docs, key, text, (visible_form, normal_form), lambda t: t, ("look_text", "norm_text"), "string")


def _digests(docs: DataFrame, key: str, text: str, form, name: str) -> DataFrame:
    """(key, text_id, name): 16-byte digests of the text and of one of its forms. Null texts and texts whose
    form is blank have no row."""
    return _mapped(docs, key, text, (form, lambda t: t), digest, (name, "text_id"), "binary")


def _mapped(docs: DataFrame, key: str, text: str, make, out, names: tuple[str, str], kind: str) -> DataFrame:
    """Whole texts of any length; a batch's repeated texts are normalised once."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, {names[0]} {kind}, {names[1]} {kind}"
    arrow = pa.string() if kind == "string" else pa.binary()

    def one(t):
        first = make[0](t) if t else ""
        return (out(first), out(make[1](t))) if first.strip() else None

    def run(batches):
        for b in batches:
            d = b.column(1).dictionary_encode()
            made = [one(t) for t in d.dictionary.to_pylist()]
            codes = d.indices.to_pylist()
            take = [i for i, c in enumerate(codes) if c is not None and made[c] is not None]
            cols = list(zip(*(made[codes[i]] for i in take))) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, arrow) for c in cols)], names=[key, *names])

    return arrow_map(docs.select(key, text), run, schema)


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: key, norm_id, text_id), (distinct texts: norm_id, text_id, rep, n), (candidates, which are the
    texts that share their normal form with another text: the same and look_id)."""
    d = cut(_digests(docs, key, text, normal_form, "norm_id").where(F.col(key).isNotNull()), "norms")
    t = d.groupBy("norm_id", "text_id").agg(F.min(key).alias("rep"), F.count("*").alias("n"))
    several = t.groupBy("norm_id").agg(F.count("*").alias("k")).where("k > 1").select("norm_id")
    c = cut(t.join(several, "norm_id", "left_semi"), "candidates")
    one = docs.select(key, text).join(c.select(F.col("rep").alias(key)), key, "left_semi")
    look = _digests(one, key, text, visible_form, "look_id").withColumnRenamed(key, "rep").distinct()
    return d, t, cut(c.join(look, ["rep", "text_id"]), "looks")


def same_look_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), key_a < key_b: documents that look the same and differ in code points.

    Pairs are made between the distinct texts of one normal form whose visible form is equal too, and
    only then widened to the documents that hold these texts. Documents without a key are left out; the
    same pair of rows comes once for each of its repeated rows."""
    d, _, c = _classes(docs, key, text)
    t = c.select("norm_id", "look_id", "text_id")
    a, b = t.withColumnRenamed("text_id", "a"), t.withColumnRenamed("text_id", "b")
    pairs = a.join(b, ["norm_id", "look_id"]).where("a < b").select("a", "b")
    m = d.join(t.select("text_id"), "text_id", "left_semi")
    left = m.select(F.col("text_id").alias("a"), F.col(key).alias("x"))
    right = m.select(F.col("text_id").alias("b"), F.col(key).alias("y"))
    p = pairs.join(left, "a").join(right, "b")
    return p.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_texts, n_links), one row per document with a text: class_id is the smallest key
    that looks the same, n_texts the number of different texts in the class, n_links the number of
    documents that look the same with another text. Linear in the documents, whatever the classes."""
    d, t, c = _classes(docs, key, text)
    g = c.groupBy("norm_id", "look_id").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_docs"))
    s = c.join(g, ["norm_id", "look_id"]).select("text_id", "class_id", "n_texts", (F.col("n_docs") - F.col("n")).alias("n_links"))
    u = t.select("text_id", "rep").join(s, "text_id", "left")
    u = u.select("text_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return d.join(u, "text_id").select(key, "class_id", "n_texts", "n_links")


def look_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: n_documents with a text, n_texts that differ, n_candidates among them, n_candidate_pairs of one
    normal form, n_same_look of them that look the same, n_rejected by the check. Pairs of texts are counted,
    not made."""
    d, t, c = _classes(docs, key, text)
    both = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("bigint")
    per = c.groupBy("norm_id", "look_id").agg(F.count("*").alias("n"))
    norm = per.groupBy("norm_id").agg(F.sum("n").alias("n"), both(F.col("n")).alias("same"))
    r = norm.agg(F.sum("n").alias("n_candidates"), both(F.col("n")).alias("n_candidate_pairs"), F.sum("same").alias("n_same_look"))
    parts = d.agg(F.count("*").alias("n_documents")).unionByName(t.agg(F.count("*").alias("n_texts")), True).unionByName(r, True)
    out = parts.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts.columns))
    return out.withColumn("n_rejected", F.col("n_candidate_pairs") - F.col("n_same_look"))
