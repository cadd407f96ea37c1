"""Addresses of two postcodes never meet, wherever their house number and grams are frequent."""

from samewise.llm import address as A


def test_two_postcodes_are_part_of_the_key_and_none_meets_all(spark, monkeypatch):
    seen = {}
    plain = A.staged
    monkeypatch.setattr(A, "staged", lambda df, name, **o: seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(df, name, **o))
    rows = [("a", "12 Putajo Road, Kluvompur 429011"), ("b", "12, Putajo Rd, Kluvompur 429011"), ("c", "12 Putajo Road, Kluvompur 429012"), ("d", "12 Putajo Road, Kluvompur"), ("e", "No. 12 Putajo Rd Kluvompur"), ("f", "13 Putajo Road, Kluvompur 429011")]
    df = A.building_pairs(spark.createDataFrame(rows, "i string, a string"), "i", "a")
    got = {tuple(r) for r in df.collect()}
    assert got == {("a", "b"), ("a", "d"), ("a", "e"), ("b", "d"), ("b", "e"), ("c", "d"), ("c", "e"), ("d", "e")}
    joins = [line for line in seen["placed_pairs"].splitlines() if "Join" in line]
    assert joins and all("p#" in line for line in joins)
