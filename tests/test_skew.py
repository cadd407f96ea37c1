import random
from itertools import groupby

from samewise.operators.skew import heavy_keys, number_rows, per_key

SCHEMA = "id string, country string, name string, value string, key string, _key string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute(data, keys):
    at = {"id": 0, "country": 1, "name": 2, "value": 3}
    out = {}
    for r in sorted(data, key=lambda r: r[0]):
        out.setdefault(tuple(r[at[k]] for k in keys), []).append(r)
    return {k: (len(v), sum(r[3] is not None for r in v), v[0][0], v[-1][0], len([0 for _ in groupby(r[3] for r in v)])) for k, v in out.items()}


def sample(n, seed=1):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    return [(f"{i:05d}", pick(["A", "A", "A", "B", None]), pick(["hot"] * 9 + ["x", "", None, "a,b"]), pick(["u", "v", None]), "clash", "clash") for i in range(n)]


def test_per_key_against_brute_force(spark):
    data = sample(700)
    for chunk in (1, 7, 64, None):
        got = {(r["country"], r["name"]): tuple(r)[2:] for r in per_key(frame(spark, data).repartition(5), ["country", "name"], "value", "id", chunk, order_by="id").collect()}
        assert got == brute(data, ["country", "name"])


def test_numbers_are_dense_and_keys_adjacent(spark):
    rows, total = number_rows(frame(spark, sample(300)).select("id", "name"), ["name"])
    got = sorted((r["_pos"], r["_key"]) for r in rows.collect())
    assert total == 300 and [p for p, _ in got] == list(range(300))
    assert len([k for k, _ in groupby(k for _, k in got)]) == len({k for _, k in got})


def test_codes_of_keys_do_not_collide(spark):
    data = [("1", "a", "bc", None, "", ""), ("2", "ab", "c", None, "", ""), ("3", None, "n", None, "", ""), ("4", "n", None, None, "", "")]
    assert per_key(frame(spark, data), ["country", "name"], "value", "id").count() == 4


def test_empty_table(spark):
    empty = frame(spark, [])
    assert per_key(empty, ["country", "name"], "value", "id").collect() == []
    assert heavy_keys(empty, ["country", "name"], "value", "id", 0.04).collect() == []


def test_heavy_keys_count_rows_with_null_keys(spark):
    data = [(str(i), "A", "hot", None, "", "") for i in range(4)] + [(str(i), None, None, None, "", "") for i in range(4, 96)]
    assert [tuple(r) for r in heavy_keys(frame(spark, data), ["country", "name"], "value", "id", 0.04).collect()] == [("A", "hot")]
    assert heavy_keys(frame(spark, data + [("x", None, None, None, "", "")] * 9), ["country", "name"], "value", "id", 0.04).count() == 0
