import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metaloom.llm import lookalike as L

SAME = [
    ("café", "café"), ("ＡＢ１", "AB1"), ("a​b­c⁠", "abc"), ("a b c d　e", "a b c d e"), ("a‐b‑c－d", "a-b-c-d"),
    ("сор", "cop"), ("ΟΑ", "OA"), ("ⅽⅾⅿⅠ", "cdmI"), ("K", "K"), ("Ω", "Ω"), ("ﬁn", "fin"), ("\U0001d400\U0001d41b", "Ab"), ("ｶﾞ", "ガ"),
    ("가", "가"), ("e‍́", "é"), ("й", "й"), ("a\r\nb", "a\nb"), ("օ", "o"), ("µ", "μ"),
    ("ꓢꓳꓐ", "SOB"), ("Ꭺ", "A"), ("ⲟⲣ", "op"), ("e\u200d\u0301\u0323", "\u1eb9\u0301"),
]
DIFFERENT = [("x²", "x2"), ("①", "1"), ("café", "cafe"), ("A", "a"), ("straße", "strasse"), ("O", "0"), ("l", "1"), ("a b", "ab"), ("a\nb", "a b"), ("ſ", "s"), ("™", "TM"), ("½", "1/2"), ("–", "-"), ("Ⓐ", "A"), ("ª", "a")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert L.visible_form(a) == L.visible_form(b)
    assert L.normal_form(a) == L.normal_form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert L.visible_form(a) != L.visible_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_stable_and_nested(t):
    v = L.visible_form(t)
    assert L.visible_form(v) == v
    assert unicodedata.is_normalized("NFC", v)
    assert L.normal_form(t) == L.normal_form(v)


def test_pairs_against_brute_force(spark):
    texts = [x for p in SAME + DIFFERENT for x in p] + ["copy", "copy", "coрy", "coрy", "сopy", None, "", "  ", "​", "y" * 70_000, "y" * 69_999 + "у", "abc", "abc"]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, look_id string, n int".replace("n int", "n string"))
    form = {i: L.visible_form(t) for i, t in enumerate(texts) if t and L.visible_form(t).strip()}
    want = sorted((a, b) for a in form for b in form if a < b and form[a] == form[b] and texts[a] != texts[b])
    assert sorted(map(tuple, L.same_look_pairs(df).collect())) == want
    report = L.look_report(df).collect()[0]
    texts_of = {texts[i] for i in form}
    pairs = [(a, b) for a in texts_of for b in texts_of if a < b and L.normal_form(a) == L.normal_form(b)]
    same = [p for p in pairs if L.visible_form(p[0]) == L.visible_form(p[1])]
    assert (report.n_documents, report.n_texts, report.n_candidate_pairs, report.n_same_look, report.n_rejected) == (len(form), len(texts_of), len(pairs), len(same), len(pairs) - len(same))
    assert report.n_candidates == len({t for p in pairs for t in p}) and len(same) < len(pairs)
    classes = {r.doc_id: r for r in L.look_classes(df).collect()}
    assert set(classes) == set(form)
    for i in form:
        assert classes[i].class_id == min(j for j in form if form[j] == form[i])
        assert classes[i].n_links == sum(i in p for p in want)
        assert classes[i].n_texts == len({texts[j] for j in form if form[j] == form[i]})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.same_look_pairs(df).count() == 0 and L.look_classes(df).count() == 0
