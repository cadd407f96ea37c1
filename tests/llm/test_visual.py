import pytest

from samewise.llm.visual import canonical, fold, form, look, same_look_pairs


@pytest.mark.parametrize("a, b", [("Ｃａｆé", "Café"), ("a b", " a  b"), ("Al​pha", "Аlрha"), ("oﬃce", "office"), ("x　y", "x y"), ("ВЕСТ", "BECT")])
def test_same_look(a, b):
    assert look(a) == look(b) and form(a) == form(b) and fold(a) == fold(b)


@pytest.mark.parametrize("a, b", [("Cafe", "Café"), ("ACME", "Acme"), ("a b", "ab"), ("a-b", "a b"), ("x²", "x2"), ("Бар", "Bap")])
def test_other_look(a, b):
    assert look(a) != look(b)


def test_forms():
    assert look(None) is form(None) is fold(None) is None and look("") == form("​ ") == ""
    assert form("Брум ЕООД") == "Брум ЕООД" and form("Аlрha") == "Alpha" and fold("STRAẞE") == fold("strasse")
    long = "Ａ​" * 50_000
    assert look(long) == "A" * 50_000


ROWS = "entity_id string, business_name string, look string, value string"


def test_pairs_against_brute_force(spark):
    names = ["Acme", "Аcme", "Ac​me", "ACME", None, "", "​", "Golden", "Golden", "Golden"]
    data = [(f"{i:03d}", n, "clash", "clash") for i, n in enumerate(names)] + [("000", "Acme", "clash", "clash")]
    want = {(a, b) for a, n, *_ in data for b, m, *_ in data if a < b and n is not None and m is not None and n != m and look(n) == look(m)}
    df = spark.createDataFrame(data, ROWS)
    assert {tuple(r) for r in same_look_pairs(df, "entity_id", "business_name").collect()} == want and len(want) == 4
    out = canonical(df, "business_name").collect()
    assert len(out) == len(data) and [r["business_name_form"] for r in out if r["business_name"] is None] == [None]
    assert same_look_pairs(spark.createDataFrame([], ROWS), "entity_id", "business_name").collect() == []


@pytest.mark.parametrize("a, b", [("ριns".replace("ι", "i"), "pins"), ("оԝl", "owl"), ("հօսո", "houn"), ("ᎪᏟᎬ", "ACE"), ("𝐀cme", "Acme"), ("ɡo", "go"), ("ѵan", "van")])
def test_look_alikes_of_many_scripts(a, b):
    assert look(a) == look(b) and fold(a) == fold(b)


def test_tables_are_pairs_of_single_letters():
    from samewise.llm import visual as V

    assert all(len(a) == len(b) == 1 and a != b for t in (V.CYRILLIC, V.GREEK, V.ARMENIAN, V.CHEROKEE, V.OTHERS) for a, b in t.items())


def test_fold_of_ascii_in_the_jvm(spark):
    from pyspark.sql import functions as F

    texts = ["Acme  Co", " a\tb\nc ", "A\x0bB\x1cC", "\x00x\x1fy", "", " ", "Straße", "ＡＢ", "a\x85b", "\x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", __import__("samewise.llm.visual", fromlist=["folded"]).folded(F.col("v")).alias("f")).collect()
    assert all(r["f"] == fold(r["v"]) for r in got), [(r["v"], r["f"], fold(r["v"])) for r in got if r["f"] != fold(r["v"])]
