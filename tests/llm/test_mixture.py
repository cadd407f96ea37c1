import numpy as np
from collections import Counter

from samewise.llm.encode import TOKENIZERS, encoding
from samewise.llm.mixture import draw, mix, pack, permute, quotas


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (1, 2**40):
            assert sorted(permute(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert list(permute(np.arange(100), np.full(100, 100), np.full(100, 1))) != list(permute(np.arange(100), np.full(100, 100), np.full(100, 2)))


def test_draw_adds_up():
    due = {"a": 1000, "b": 37, "c": 1}
    got = draw(due, 64, 5)
    assert {s: sum(r[2] for r in got if r[1] == s) for s in due} == due
    assert all(sum(r[2] for r in got if r[0] == k) == 64 for k in range(len(got) and got[-1][0])) and draw({}, 8, 1) == []


def test_quotas():
    q = quotas({"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 4, "c": 9})
    assert abs(q["b"] / q["a"] - 0.8) < 1e-9 and abs(q["b"] - 40) < 1e-9 and "c" not in q
    full = quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, total=110)
    assert full["b"] == 20 and abs(full["a"] - 90) < 1e-9 and quotas({}, {"a": 1.0}, {"a": 1}) == {}


def test_pack_keeps_every_token(spark):
    data = [("hot", str(i), list(range(i % 7))) for i in range(60)] + [("x", "1", [5] * 40), ("x", "1", [5] * 40), ("y", "2", [])]
    got = pack(spark.createDataFrame(data, "source string, doc string, ids array<int>"), 8).collect()
    for s in ("hot", "x"):
        blocks = sorted((r["block"], list(r["ids"])) for r in got if r["source"] == s)
        assert [b for b, _ in blocks] == list(range(len(blocks))) and all(len(x) == 8 for _, x in blocks[:-1])
        assert Counter(t for _, x in blocks for t in x) == Counter(t for q, _, x in data if q == s for t in x)
    assert not [r for r in got if r["source"] == "y"]


def test_mix(spark):
    docs = [(i, f"some words of post {i} " * 12, "big") for i in range(40)] + [(100 + i, f"rare post {i} " * 9, "small") for i in range(4)] + [(200, "no one asked", "other"), (201, None, "small"), (202, "", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixture, report = mix(d, t, "doc_id", "text", "source", length=16, shard_slots=8)
    rows, rep = mixture.collect(), {r["source"]: r for r in report.collect()}
    assert rep["gone"]["tokens"] == 0 and abs(rep["small"]["actual_share"] - 4 / 9) < 0.05 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    most = Counter((r["source"], r["block"]) for r in rows)
    assert all(n <= {"big": 1, "small": 3}[s] for (s, _), n in most.items())
    assert {s: sum(len(r["ids"]) for r in rows if r["source"] == s) for s in ("big", "small")} == {s: rep[s]["tokens"] for s in ("big", "small")}
    enc = encoding(TOKENIZERS, "byte_bpe_50k")
    assert rep["big"]["available_tokens"] == sum(len(enc.encode_ordinary(x)) for _, x, s in docs if s == "big")
    again, _ = mix(d, t, "doc_id", "text", "source", length=16, shard_slots=8)
    assert sorted(map(tuple, again.drop("ids").collect())) == sorted(map(tuple, mixture.drop("ids").collect()))


def test_no_documents(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(d, t, "doc_id", "text", "source")
    assert mixture.collect() == [] and report.first()["actual_share"] == 0.0


def test_any_range_of_shards_is_drawn_by_itself():
    due = {"a": 1000, "b": 37, "c": 1, "d": 0}
    every = draw(due, 16, 5)
    assert [r for lo in range(0, 80, 7) for r in draw(due, 16, 5, lo, lo + 7)] == every
    given = {}
    for shard, s, k, g, before, m in every:
        assert g == given.get(s, 0)
        given[s] = g + k
    assert draw(due, 16, 6) != every


def test_splits_too_large_for_one_draw():
    from samewise.llm.mixture import split

    due = np.array([9 * 10**12, 10**12, 5, 0])
    total = int(due.sum())
    got = split(due, total // 4, total - total // 4, np.random.default_rng(1))
    assert got.sum() == total // 4 and (got <= due).all() and abs(got[0] / due[0] - 0.25) < 1e-4


def test_small_sources_repeat_up_to_their_cap_under_a_wanted_size(spark):
    docs = spark.createDataFrame([(i, "some words of the large source and more of them " * 8, "large") for i in range(40)] + [(100 + i, "few words here " * 9, "small") for i in range(3)] + [(200, None, "small"), (201, "", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("large", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix(docs, targets, "doc_id", "text", "source", 16, 32, 1, 2000)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["times"] <= 3.0001 and got["small"]["times"] > 2.5 and got["large"]["times"] <= 1.0001 and got["none"]["tokens"] == 0
    rows = mixture.collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert max(Counter((r["source"], r["block"]) for r in rows if r["source"] == "small").values()) == 3
