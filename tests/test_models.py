import random

from pyspark.sql import functions as F

from samewise.operators import models as M
from samewise.streaming.link import SCHEMA, link_stream, match_batch


def pairs(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((f"s{i % 60}", f"m{i}", y, y + rng.gauss(0, 0.4), rng.random() if i % 9 else None))
    return spark.createDataFrame(rows, "s1 string, m string, y int, a double, b double")


def test_folds_are_apart_and_scores_useful(spark):
    out = M.out_of_fold(pairs(spark), ["a", "b"]).collect()
    assert len(out) == 300 and len({(r["s1"], r["fold"]) for r in out}) == 60
    good = [r["p"] for r in out if r["y"] == 1]
    bad = [r["p"] for r in out if r["y"] == 0]
    assert sum(good) / len(good) > sum(bad) / len(bad) + 0.3


def test_calibration_is_monotone(spark):
    df = spark.createDataFrame([(i / 50, int(i % 3 == 0) if i < 25 else 1) for i in range(50)], "p double, y int")
    c = [r["calibrated"] for r in M.calibrate(df).orderBy("p").collect()]
    assert c == sorted(c) and c[-1] == 1.0


def test_scorer_sees_only_the_uncertain_band(spark):
    df = spark.createDataFrame([("a", "1", 0.5, "x", "xy"), ("a", "2", 0.999, "x", "x"), ("b", "3", 0.01, "", "")], "s1 string, m string, p double, ta string, tb string")
    out = {r["m"]: r["ce"] for r in M.with_scorer(df, ("ta", "tb"), lambda a, b: [float(len(x) + len(y)) for x, y in zip(a, b)], "ce").collect()}
    assert out == {"1": 3.0, "2": None, "3": None}


def test_domain_weights(spark):
    x = pairs(spark)
    w = [r["w"] for r in M.domain_weights(x.where("a < 0.7"), x.where("a > 0.3"), ["a", "b"]).collect()]
    assert abs(sum(w) / len(w) - 1) < 1e-6 and min(w) < max(w)


def test_dictionary(spark):
    rows = [("ट्रेडर्स मात्रा", "Traders Matra")] * 4 + [("मात्रा", "Matra Ltd")] * 3
    got = {r["native"]: r["latin"] for r in M.learn_dictionary(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {"ट्रेडर्स": "traders", "मात्रा": "matra"}


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


CLEAN = [("S1-1", "Acme Tools", "12 rue Lilas", "X"), ("S1-2", "Zed Works", "9 rue Mer", "X"), *[(f"S1-{i}", f"Other{i} Firm{i}", f"{i} road{i}", "X") for i in range(10, 60)]]


def test_stream_gives_the_matches_of_one_batch(spark, tmp_path):
    clean = records(spark, CLEAN)
    arriving = [("S2-1", "Acme Tools", "12 Lilas", "X"), ("S2-2", "Zed Works", None, "X"), ("S2-3", None, None, None)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    records(spark, arriving).repartition(1).write.parquet(folder)
    for _ in range(2):  # a second start finds nothing new
        link_stream(spark, clean, folder, out, str(tmp_path / "offsets")).awaitTermination()
    got = spark.read.schema("s1 string, m string, p double").parquet(f"{out}/batch=*")
    assert {(r["s1"], r["m"]) for r in got.collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-2")}
    assert {(r["s1"], r["m"]) for r in match_batch(clean, records(spark, arriving)).collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-2")}
    assert match_batch(clean, records(spark, [])).collect() == []
