import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from samewise.functions import similarity as S
from samewise.functions import text as N
from samewise.operators import decode as D
from samewise.operators import retrieval as R
from samewise.operators import rules as U
from samewise.operators.windows import best_two, second_best
from samewise.sources.files import read_json, write_json


def weights(spark, n, seed, hot):
    rng = random.Random(seed)
    rows = [(f"{seed}-{i}", "X", t, rng.choice([0.1, 0.3, 0.5, 0.8])) for i in range(n) for t in {f"w{rng.randint(0, 60)}" for _ in range(4)}]
    rows += [(f"{seed}-{i}", "X", "hot", 0.02) for i in range(n) if hot(i)]
    return spark.createDataFrame(rows, "id string, country string, token string, w double")


@pytest.mark.parametrize("k, least", [(1, 0.01), (3, 0.01), (3, 0.25), (50, 0.1)])
def test_both_plans_of_the_similarity_join_agree(spark, rows, k, least):
    q, d = weights(spark, 80, 1, lambda i: True), weights(spark, 120, 2, lambda i: True)
    assert rows(R.similarity_join(q, d, k, least)) == rows(R.similarity_join(q, d, k, least, plain=0))
    none = q.limit(0)
    assert rows(R.similarity_join(none, d, k, least, plain=-1)) == [] and rows(R.similarity_join(q, none, k, least, plain=-1)) == []


def test_a_common_token_opens_no_candidates(spark):
    q, d = weights(spark, 300, 3, lambda i: True), weights(spark, 300, 4, lambda i: True)
    of_d = d.groupBy("country", "token").agg(F.max("w").alias("top"))
    reach = q.join(of_d, ["country", "token"]).withColumn("most", F.col("w") * F.col("top"))
    assert reach.where("token = 'hot'").agg(F.max("most")).first()[0] < 0.01  # alone it can't reach the least score: its 90,000 meetings are never made


def test_second_best_of_a_large_group(spark, rows):
    big = spark.range(200_000).select(F.lit("hot").alias("m"), (F.col("id") % 1000 / 1000).alias("p"))
    x = big.unionByName(spark.createDataFrame([("one", 0.4), ("two", 0.9), ("two", 0.3), ("tie", 0.5), ("tie", 0.5)], "m string, p double"))
    assert rows(best_two(x, "p", "m")) == [("hot", 0.999, 0.999), ("one", 0.4, None), ("tie", 0.5, 0.5), ("two", 0.9, 0.3)]
    got = {r["m"]: round(r["d"], 6) for r in second_best(x, "p", "m", "d").groupBy("m").agg(F.max("d").alias("d")).collect()}
    assert got == {"hot": 0.0, "one": 0.4, "two": 0.6, "tie": 0.0}
    assert "collect" not in second_best(x, "p", "m", "d")._jdf.queryExecution().executedPlan().toString()


def test_partial_ratio_against_all_stretches():
    def brute(a, b):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 100.0 if not b else 0.0
        parts = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))} - {""}
        return max(S.ratio(a, p) for p in parts)

    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in "ab")
        assert abs(S.partial_ratio(a, b) - brute(a, b)) < 1e-9, (a, b)


def test_each_distinct_pair_is_scored_once(spark, rows):
    df = spark.createDataFrame([("x", "ab", "ac"), ("y", "ab", "ac"), ("z", None, "q"), ("e", "", "")], "id string, a string, b string")
    assert rows(S.scored_once(df, "a", "b", {"r": S.ratio}).select("id", "r")) == [("e", 100.0), ("x", 50.0), ("y", 50.0), ("z", None)]


RECORD = "id string, country string, raw string, addr string, n string, a string"


def keyed(spark, data):
    df = spark.createDataFrame([(i, "X", raw, addr) for i, raw, addr in data], "id string, country string, raw string, addr string")
    return U.keyed(df.withColumn("n", N.clean(F.col("raw"))).withColumn("a", N.clean(F.col("addr"))))


def test_rules_that_the_tables_give_no_row_for(spark, rows):
    a = keyed(spark, [("1", "Blue Harbor Foods LLC", "12 Oak Road, Salem"), ("2", "Quiet Pine Stores LLC", "14 Elm Road, Salem"), ("3", "Grand Old Mill Inc", "14 Elm Road, Salem"), ("4", "Golden Corner", "20 Fig Road, Salem, Unit 3"), ("5", "Silver Corner", "20 Fig Road, Salem, Unit 4"), ("6", "Twin Pines LLC", "1 Low Road, Salem"), ("7", "Twin Pines Inc", "2 Low Road, Salem")])
    b = keyed(spark, [("w", "blueharborfoodsllc.com", "12 Oak Road, Salem"), ("i", "Zumbera LLC", "12 Oak Road, Salem"), ("s", "GOM", "14 Elm Road, Salem"), ("c", "GOM", "14 Elmm Street, Salem"), ("u", "Anything", "20 Fig Road, Salem, Unit 4"), ("f", "Zorbalo", "12 Oakk Road, Salem"), ("t", "Twin Pines Inc", ""), ("ta", "Twin Pines LLC", "1 Low Road, Salem")])
    none = spark.createDataFrame([], "s1 string, m string")
    assert rows(U.handle_adds(a, b, none)) == [("1", "w")]
    assert rows(U.invented_with_legal_adds(a, b, none)) == [("1", "i")]
    assert rows(U.shared_place_adds(a, b, none).select("s1", "m")) == [("3", "s")]
    assert rows(U.initials_in_city_adds(a, b, none).where("m in ('c', 's')")) == [("3", "c"), ("3", "s")]
    assert rows(U.unit_adds(a, b, none)) == [("5", "u")]
    assert ("1", "f") in rows(U.fuzzy_street_adds(a, b, none, 60))
    assert rows(U.legal_tie(a, b, none)) == [("7", "t")] and rows(U.legal_tie(a, b, none, addressed=True)) == [("6", "ta")]
    low = spark.createDataFrame([("6", "ta", 0.2)], "s1 string, m string, p double")
    assert rows(U.legal_tie(a, b, none, addressed=True, scored=low)) == []
    taken = spark.createDataFrame([("9", x) for x in ("w", "i", "s", "c", "u", "f", "t", "ta")], "s1 string, m string")
    assert all(rows(f(a, b, taken)) == [] for f in (U.handle_adds, U.invented_with_legal_adds, U.shared_place_adds, U.initials_in_city_adds, U.unit_adds, U.fuzzy_street_adds, U.legal_tie))


def test_words_as_a_table_or_a_list(spark, rows):
    x = spark.createDataFrame([("1", "a", 1.0, 0, 1, "inn", True), ("2", "b", 1.0, 0, 1, "pub", True)], "s1 string, m string, p double, nd int, na int, aw string, same_hn boolean")
    none = spark.createDataFrame([], "s1 string, m string")
    table_ = spark.createDataFrame([("inn",), ("inn",), (None,)], "word string")
    assert rows(U.suffix_adds(x, none, ["inn"])) == rows(U.suffix_adds(x, none, table_)) == [("1", "a")]
    assert rows(U.not_among(x, "aw", table_).select("s1")) == rows(U.not_among(x, "aw", ["inn"]).select("s1")) == [("2",)]


def test_the_dictionary_comes_before_the_rules(spark):
    d = spark.createDataFrame([("ट्रेडर्स", "traders")], "native string, latin string")
    df = spark.createDataFrame([("राम ट्रेडर्स, पटना",), ("plain",), (None,)], "raw string")
    got = {r["raw"]: r["put"] for r in N.with_dictionary(df, "raw", d, "put").collect()}
    assert got == {"राम ट्रेडर्स, पटना": "राम traders, पटना", "plain": "plain", None: None}


def test_gate_needs_a_gain_on_the_other_fold(spark):
    pairs = [(f"s{i}", f"m{i}", 0.6 if i % 2 else 0.9) for i in range(40)]
    df = spark.createDataFrame(pairs, "s1 string, m string, p double")
    ids, every = df.select("s1"), df.select("s1", "m")
    assert all(r["passed"] and r["gain"] > 0 for r in D.tuned_gate(df, 0.8, [0.5, 0.7], every, ids, 0.001).collect())
    assert not any(r["passed"] for r in D.tuned_gate(df, 0.8, [0.5, 0.7], every.where("s1 = 's0'"), ids, 0.001).collect())


def test_json_in_the_shared_store(spark, tmp_path):
    path = "file://" + str(tmp_path / "a.json")
    write_json(spark, {"b": 1, "a": "é"}, path)
    write_json(spark, {"b": 2, "a": "é"}, path)
    assert read_json(spark, path) == {"b": 2, "a": "é"}


def test_the_core_stands_without_the_libraries_of_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tiktoken'] = None; sys.modules['regex'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; assert len(e.queries()) > 120 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code, str(root)], capture_output=True, timeout=120).returncode == 0
