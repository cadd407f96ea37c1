import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from samewise.operators import decode as D
from samewise.operators import rules as U
from samewise.operators import windows as W

PAIRS = "s1 string, m string, p double"


def test_ordered_against_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, float(rng.randint(0, 5))) for i in range(400)]
    got = W.ordered(spark.createDataFrame(data, "g string, i int, v double"), ["g"], [F.desc("v"), F.asc("i")], "rank", {"cum": "v"}).collect()
    for g in {r[0] for r in data}:
        want, total = [], 0.0
        for k, r in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            total += r[2]
            want.append((r[1], k, total))
        assert sorted((r["i"], r["rank"], r["cum"]) for r in got if r["g"] == g) == sorted(want)
    assert W.ordered(spark.createDataFrame([], "g string, i int"), ["g"], [F.asc("i")]).collect() == []


def test_second_best(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.5), ("b", 4, 0.4)], "g string, i int, p double")
    assert {r["i"]: round(r["x"], 6) for r in W.second_best(df, "p", "g", "x").collect()} == {1: 0.0, 2: 0.0, 3: -0.4, 4: 0.4}


def test_metric(spark):
    s = lambda xs: spark.createDataFrame(xs, "s1 string, m string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    f = {r["s1"]: r["f"] for r in D.macro_fbeta(s([("a", "47"), ("a", "193"), ("a", "812"), ("c", "1")]), s([("a", "47"), ("a", "812")]), ids).collect()}
    assert round(f["a"], 3) == 0.714 and f["b"] == 1.0 and f["c"] == 0.0


def test_expected_f_against_brute_force(spark):
    rng = random.Random(3)
    data = [(f"s{i}", f"m{i}-{j}", round(rng.random(), 3)) for i in range(30) for j in range(rng.randint(1, 6))]
    got = D.decode_expected_f(spark.createDataFrame(data, PAIRS), floor=0.0).collect()
    for i in range(30):
        ps = sorted((p for s, _, p in data if s == f"s{i}"), reverse=True)
        e = [1.25 * sum(ps[:k]) / (k + 0.25 * sum(ps)) for k in range(1, len(ps) + 1)]
        k = e.index(max(e)) + 1 if max(e) > math.prod(max(1e-6, 1 - p) for p in ps) else 0
        assert sum(r["s1"] == f"s{i}" for r in got) == k


def test_exclusive_keeps_ties_unless_strict(spark):
    df = spark.createDataFrame([("a", "m", 0.5), ("b", "m", 0.5), ("c", "m", 0.4)], PAIRS)
    assert D.exclusive(df).count() == 2 and [r["s1"] for r in D.best_per_record(df).collect()] == ["a"]


def test_blend_and_ensemble(spark):
    df = spark.createDataFrame([("a", "m", 0.8, None), ("a", "n", 0.5, 0.5), ("b", "o", 0.0, 1.0)], "s1 string, m string, p double, q double")
    got = {r["m"]: r["x"] for r in df.select("m", D.blend(F.col("p"), F.col("q"), 0.5).alias("x")).collect()}
    assert got["m"] == 0.8 and abs(got["n"] - 0.5) < 1e-9 and abs(got["o"] - 0.5) < 1e-6


def test_empty_pairs(spark):
    e = spark.createDataFrame([], PAIRS)
    assert D.decode(e, 0.5).collect() == [] and D.decode_expected_f(e).collect() == [] and D.merge_routes(e.select("s1", "m"), [e]).collect() == []


def record(i, raw, addr, country="X"):
    return (i, country, raw, addr)


def keyed(spark, rs):
    from samewise.functions import text as N

    df = spark.createDataFrame(rs, "id string, country string, raw string, addr string")
    return U.keyed(df.withColumn("n", N.clean(F.col("raw"))).withColumn("a", N.clean(F.col("addr"))))


def test_rules(spark, rows):
    a = keyed(spark, [record("a1", "Acme Tools Ltd", "12 rue Lilas, Lyon"), record("a2", "Best Brick Oven", "40 rue Rose, Lyon"), record("a3", "Zed Works LLC", "7 rue Bois, Nice"), record("a4", "Zed Works", "9 rue Mer, Nice")])
    b = keyed(spark, [record("m1", "Acme Tools Group", "12 rue Lilas, Lyon"), record("m2", "BBO", "40 rue Rose, Lyon"), record("m3", "Acme Tools", "300 rue Lilas, Lyon"), record("m4", "Zed Works LLC", ""), record("m5", "Acme Pans", "12 rue Lilas, Lyon"), record("m6", "Acme Tools Group", "12 rue Lilas, Lyon")])
    p = spark.createDataFrame([("a1", "m1", 0.5), ("a1", "m3", 0.6), ("a1", "m5", 0.95)], PAIRS)
    x, none = U.compared(p, a, b), spark.createDataFrame([], "s1 string, m string")
    claimed = spark.createDataFrame([("a1", "m5"), ("a1", "m3")], "s1 string, m string")
    assert rows(U.suffix_adds(x, none, ["group"])) == [("a1", "m1")] and rows(U.suffix_adds(x, none, ["group"], ["front"])) == []
    assert rows(U.changed_number_drops(x, claimed)) == [("a1", "m3")]
    assert rows(U.swap_drops(x, claimed, ["pans"])) == [("a1", "m5")]
    assert rows(U.shifted_number_adds(x, none)) == [("a1", "m3")]
    assert rows(U.renamed_adds(a, b, none).select("s1", "m")) == [("a2", "m2")]
    assert rows(U.legal_tie(a, b, none).select("s1", "m")) == [("a3", "m4")]
    assert rows(U.outside_adds(a, b, p, ["group"]).select("s1", "m")) == [("a1", "m6")]
