import pytest
from pyspark.sql import functions as F

from samewise import session
from samewise.operators import models as M
from samewise.operators import retrieval as R
from samewise.plans import flow


def test_what_was_shuffled_for_a_stage_is_freed(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    df = session.staged(spark.range(1000).repartition(4, "id").groupBy("id").count(), "freed")
    assert tracker.shuffleStatuses().size() <= before and df.count() == 1000


def test_what_is_staged_on_the_way_is_deleted(spark):
    way = []

    def make():
        way.append(session.staged(spark.range(5), "way"))
        return way[0].where("id > 1")

    out = session.staged_alone(make, "result")
    assert out.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(way[0].inputFiles()[0]).count()


def test_context_is_made_without_the_features(spark, monkeypatch):
    """Sorting and joining all pairs by s1 and m with all features took most of the disk."""
    seen = []
    plain = M.score_context
    monkeypatch.setattr(M, "score_context", lambda df, p="p1": seen.append(df.columns) or plain(df, p))
    rows = [(f"s{i}", f"m{i}-{j}", float(j == 0), float(i % 3), int(j == 0)) for i in range(60) for j in range(3)]
    f = spark.createDataFrame(rows, "s1 string, m string, f1 double, f2 double, y int")
    got = M.two_stage(f, ["f1", "f2"], others=f.drop("y")).collect()
    assert {(r["s1"], r["m"]) for r in got} == {(r[0], r[1]) for r in rows} and len(got) == len(rows)
    assert all(r["p"] > 0.5 for r in got if r["m"].endswith("-0")) and seen == [["_i", "s1", "m", "p1"]] * 2


def test_candidates_of_labelled_rows_are_those_of_the_whole_run(spark, rows):
    x = [(s, f"{own}{s}-{i}", f"{own}X", n, a, n, a) for own in ("", "known:") for s in (1, 2) for i, (n, a) in enumerate((("acme works", "12 putajo road"), ("zebra tea", "7 mokisu lane"), ("acme tea", "")))]
    df = spark.createDataFrame(x, "side int, id string, country string, raw string, addr string, n string, a string")
    every = [r for r in rows(flow.routes(df)) if r[0].startswith("known:")]
    assert every and rows(flow.routes(df.where(F.col("id").startswith("known:")))) == every


def test_cosine_keeps_a_pair_one_row(spark):
    text = lambda *x: spark.createDataFrame([*x], "id string, tokens array<string>")
    pairs = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("none", "x")], "q string, c string")
    df = R.idf_cosine(pairs, text(("a", ["t", "u", "t"]), ("b", [])), text(("x", ["t", "u"]), ("y", ["v"])))
    assert sorted((r["q"], r["c"], round(r["cosine"], 9)) for r in df.collect()) == [("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0), ("none", "x", 0.0)]
