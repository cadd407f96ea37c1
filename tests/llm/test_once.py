"""Addresses and names are parsed once, not again for each pair."""

from samewise.llm import address as A
from samewise.llm import names as M
from samewise.llm import variants as V


def test_an_address_comes_back_from_its_packed_form(spark):
    raw = ["12345 Oak Ave, Salem 97301", "14-16 Putajo Road, Kluvompur 429015", "7bis rue de l'Église", "No. 5", "Salem", "303A Fojupo Cross Road, Kledrunnagar", "", "१२ Zemelpur Straße 4"]
    for r in raw:
        assert A._unpacked(A._packed(A.parse(r))) == A.parse(r)
    for r in A.parts(spark.createDataFrame([(x,) for x in raw], "addr string")).collect():
        assert A._unpacked(r["place"]) == A.parse(r["addr"])


def test_a_name_comes_with_all_that_is_compared(spark):
    raw = ["Takogavika Electricals Pvt Ltd", "www.takogavika.com", "तिमाझुमिके", "B. Brown & Co", "!!"]
    got = V.parsed(spark.createDataFrame([(x,) for x in raw], "name string")).collect()
    assert [(tuple(r["tokens"]), frozenset(r["legal"]), r["indic"], r["web"]) for r in got] == [tuple(M.parse(r["name"])[:4]) for r in got] and len(got) == 5
