import random

from samewise.llm.topn import catalog, cluster_by_group, top_n

SCHEMA = "s1 string, m string, p double, g string, rank string"


def brute(data, n):
    best = {}
    for s, m, p, *_ in data:
        if s is not None and m is not None and p is not None and p == p:
            best[s, m] = max(p, best.get((s, m), p))
    out = []
    for s in {s for s, _ in best}:
        items = sorted(((p, m) for (t, m), p in best.items() if t == s), key=lambda x: (-x[0], x[1]))[:n]
        out += [(s, m, p, i) for i, (p, m) in enumerate(items, 1)]
    return sorted(out)


def sample(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice([f"m{rng.randint(0, 60)}", None] if rng.random() < 0.1 else [f"m{rng.randint(0, 400)}"]), rng.choice([rng.randint(0, 20) / 20, None, float("nan"), 1.0]), "clash", "clash") for _ in range(n)]


def test_against_brute_force_with_small_row_groups(spark):
    for seed, size in ((1, 1), (2, 2000), (3, 1 << 22)):
        data = sample(6000, seed)
        df = spark.createDataFrame(data, SCHEMA)
        assert sorted(tuple(r) for r in top_n(df, "s1", "m", "p", 5, size).collect()) == brute(data, 5)


def test_ties_repeats_and_one_hot_group(spark):
    data = [("hot", f"m{i % 3}", 0.5, "", "") for i in range(3000)] + [("hot", "m9", 0.1, "", ""), ("one", "x", 0.0, "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(tuple(r) for r in top_n(df, "s1", "m", "p", 5, 1).collect()) == brute(data, 5)


def test_row_groups_are_skipped(spark):
    data = [("hot", f"m{i:06d}", i / 20000, "", "") for i in range(20000)]
    df = spark.createDataFrame(data, SCHEMA)
    groups = catalog(spark, cluster_by_group(df, "s1", "m", "p", 1)).collect()
    assert len(groups) > 8 and all(g["known"] for g in groups)
    fifth = brute(data, 5)[-1][2]
    assert sum(g["p_hi"] >= fifth for g in groups) == 1  # all others lie strictly below the fifth score


def test_empty_and_all_null(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "s1", "m", "p", 5).collect() == []
    assert top_n(spark.createDataFrame([("a", "m", None, "", ""), (None, "m", 1.0, "", "")], SCHEMA), "s1", "m", "p", 5).collect() == []


def test_row_groups_below_the_nth_score_are_not_read(spark):
    data = [("hot", f"m{i:06d}", i / 20000, "", "") for i in range(20000)] + [("flat", f"m{i:06d}", 0.5, "", "") for i in range(20000)] + [(f"g{i}", "x", 0.1, "", "") for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    taken = []
    assert sorted(tuple(r) for r in top_n(df, "s1", "m", "p", 5, 1, taken).collect()) == brute(data, 5)
    read = {(r["file"], r["rg"]) for t in taken for r in t.collect()}
    groups = catalog(spark, cluster_by_group(df, "s1", "m", "p", 1)).collect()
    hot = [g for g in groups if g["g_lo"] == g["g_hi"] == "hot"]
    assert len(hot) > 3 and len(read) <= len(groups) - (len(hot) - 2)  # of the hot group one row group, perhaps one beside it; ties of the other are all read
