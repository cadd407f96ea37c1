"""A mixture of sources with target shares of all tokens.

The tokens of each source are packed, document after document, into blocks of equal length. How many slots of each output shard go
to each source is drawn from the multinomial distribution of what is due, by a tree of splits, so the counts vary by shard and add
up exactly.
A slot's number among its source's slots is mapped through a pseudorandom permutation of the source's blocks, a new one for each
time round, and the blocks are joined by their index. No block is used more often than its source allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.llm.encode import encode
from samewise.session import staged, table, width


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each k in the permutation of 0 … n-1 that key names: a Feistel network over the next even power of two, walked
    until it lands below n. A bijection for each (n, key)."""
    with np.errstate(over="ignore"):
        n, key = n.astype(np.uint64), _mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n).astype(float) + 0.5)) + 1) // 2).astype(np.uint64)
        mask, out = (np.uint64(1) << half) - np.uint64(1), k.astype(np.uint64).copy()
        todo = np.arange(len(out))
        while len(todo):
            x, h, m = out[todo], half[todo], mask[todo]
            left, right = x >> h, x & m
            for r in range(4):
                left, right = right, left ^ (_mix(right + key[todo] + np.uint64(r) * np.uint64(0xD1B54A32D192ED03)) & m)
            out[todo] = left << h | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(k: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(k.to_numpy(), n.to_numpy(), key.to_numpy()))


def pack(tokens: DataFrame, length: int) -> DataFrame:
    """source, block (0, 1, … for each source) and ids of length tokens (the last of a source may be shorter), from rows of
    (source, doc, ids). Where a document starts in its source is a prefix sum, over ranges of documents and then inside each."""
    n = width(tokens.sparkSession)
    # A long document is a row like any other; a source with a third of the rows spans many ranges.
    order = tokens.withColumn("h", F.xxhash64("doc")).withColumn("n", F.size("ids").cast("long")).where("n > 0")
    ranged = staged(order.repartitionByRange(n, "source", "h", "doc").withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("source", "range").agg(F.sum("n").alias("s"))  # at most ranges + sources rows
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "range", F.coalesce(F.sum("s").over(so_far), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bases), ["source", "range"])
    placed = placed.withColumn("start", F.col("base") + F.col("before"))
    size = F.lit(length).cast("long")
    blocks = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))
    parts = placed.select("source", "start", "n", "ids", F.explode(blocks).alias("block"))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("start"))
    last = F.least(F.col("n"), (F.col("block") + 1) * size - F.col("start"))
    parts = parts.select("source", "block", (F.col("start") + first).alias("at"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    return parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))


def quotas(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens of each source in the mixture. Without total, as many as keep every share at its target (of the sources that have
    tokens at all; the others' shares are spread in proportion). With total, each source gives its share as far as its repeats
    reach, and what is missing is spread over the rest in proportion."""
    live = {s: share[s] for s in share if have.get(s, 0) > 0 and share[s] > 0 and repeats[s] > 0}
    if not live:
        return {}
    scale, most = sum(live.values()), {s: have[s] * repeats[s] for s in live}
    if total is None:
        total = min(most[s] * scale / live[s] for s in live)
        return {s: total * live[s] / scale for s in live}
    out: dict[str, float] = {}
    left = min(float(total), float(sum(most.values())))
    open_ = dict(live)
    while open_:
        rate = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * rate >= most[s]]
        if not full:
            return out | {s: x * rate for s, x in open_.items()}
        for s in full:
            out[s] = float(most[s])
            left -= out[s]
            del open_[s]
    return out


def split(due: np.ndarray, left: int, right: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's due slots fall into the first left of left + right slots: the multinomial draw with what is due as its
    limit. Where it is too large to be drawn at once, each source is drawn and what the sum is off by is drawn again."""
    if not left or not right:
        return due if left else np.zeros_like(due)
    if left + right < 10**9:
        return rng.multivariate_hypergeometric(due, left)
    got = rng.binomial(due, left / (left + right))
    while off := left - int(got.sum()):
        room = due - got if off > 0 else got
        step = np.minimum(rng.multinomial(abs(off), room / room.sum()), room)
        got = got + step if off > 0 else got - step
    return got


def shares_of(due: np.ndarray, shards: int, shard_slots: int, seed: int, first: int = 0, last: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts, slots of each source in earlier shards) of the shards first to last - 1. The shards are the leaves of a tree; each
    inner node splits what is due among its halves by a draw seeded with the node, so a leaf is found from the root without its
    neighbours: any range of shards can be drawn by itself, on any machine, and always comes out the same."""
    total, last = int(due.sum()), shards if last is None else last
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def walk(lo: int, hi: int, mine: np.ndarray, before: np.ndarray) -> None:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            out.append((lo, mine, before))
            return
        mid = (lo + hi) // 2
        slots = lambda i: min(total, i * shard_slots)
        rng = np.random.default_rng([seed, lo, hi])
        here = split(mine, slots(mid) - slots(lo), slots(hi) - slots(mid), rng)
        walk(lo, mid, here, before)
        walk(mid, hi, mine - here, before + here)

    if shards:
        walk(0, shards, due.astype(np.int64), np.zeros(len(due), dtype=np.int64))
    return out


#: Shards that one row of the plan draws.
RANGE = 64


def draw(due: dict[str, int], shard_slots: int, seed: int, first: int = 0, last: int | None = None) -> list[tuple[int, str, int, int, int, int]]:
    """(shard, source, count, slots of the source in earlier shards, slots of earlier sources in the shard, slots of the shard) of the
    shards first to last - 1, or of all."""
    names = sorted(due)
    shards = -(-sum(due.values()) // shard_slots)
    out = []
    for shard, counts, given in shares_of(np.array([due[s] for s in names], dtype=np.int64), shards, shard_slots, seed, first, last):
        before, m = 0, int(counts.sum())
        for s, k, g in zip(names, counts.tolist(), given.tolist()):
            if k:
                out.append((shard, s, k, g, before, m))
                before += k
    return out


def drawn(spark: SparkSession, due: dict[str, int], shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, count, given, before, slots) of all shards, drawn in the executors by ranges of shards."""
    ranges = -(-(-(-sum(due.values()) // shard_slots)) // RANGE)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame(draw(due, shard_slots, seed, int(i) * RANGE, (int(i) + 1) * RANGE), columns=["shard", "source", "count", "given", "before", "slots"])

    numbers = spark.range(ranges).repartition(max(1, min(width(spark), ranges)))
    return numbers.mapInPandas(some, "shard long, source string, count long, given long, before long, slots long")


def mix(docs: DataFrame, targets: DataFrame, ident: str, text: str, source: str, length: int = 128, shard_slots: int = 4096, seed: int = 17, total: int | None = None, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """The mixture (shard, slot, source, block, round, ids) and its report (source, target_share, actual_share, tokens,
    available_tokens, times, max_repeats), one row for each source of targets.

    docs of sources not in targets, or with a null source, take no part; empty and null texts have no tokens; a source without
    tokens gets none and a share of 0. targets: source, target_share, max_repeats; it is configuration and read to the driver, at
    most 10,000 rows. Block and token counts by source are all else that comes to the driver; the
    shards' counts are drawn in the executors. Repeated doc ids are packed next to
    each other. max_repeats bounds how often any token of a source occurs.
    """
    spark = docs.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 sources")
    share = {r["source"]: float(r["target_share"] or 0) for r in wanted if r["source"] is not None}
    repeats = {r["source"]: int(r["max_repeats"] or 0) for r in wanted if r["source"] is not None}
    names = list(share)
    mine = docs.where(F.col(f"`{source}`").isin(names)).select(F.struct(F.col(f"`{source}`").alias("source"), F.col(f"`{ident}`").cast("string").alias("doc")).alias("key"), F.col(f"`{text}`").alias("text"))
    tokens = encode(mine, "key", "text", **tokenizer).select("key.source", "key.doc", "ids")
    blocks = staged(pack(tokens, length), "blocks")
    counts = {r["source"]: (r["blocks"], r["tokens"]) for r in blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("ids")).alias("tokens")).collect()}
    goal = quotas({s: t for s, (_, t) in counts.items()}, share, repeats, total)
    due = {s: min(repeats[s] * counts[s][0], max(0, round(q * counts[s][0] / counts[s][1]))) for s, q in goal.items()}
    numbers = spark.createDataFrame([(s, counts[s][0], names.index(s)) for s in due] or [], "source string, blocks long, number int")  # one row a source
    slots = drawn(spark, {s: k for s, k in due.items() if k}, shard_slots, seed).join(F.broadcast(numbers), "source")
    slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("j"))
    g = F.col("given") + F.col("j")
    slots = slots.withColumn("round", F.floor(g / F.col("blocks")).cast("int"))
    key = F.xxhash64(F.lit(seed), F.lit("block"), "number", "round")
    slots = slots.withColumn("block", _permuted(g % F.col("blocks"), F.col("blocks"), key))
    slots = slots.withColumn("slot", _permuted(F.col("before") + F.col("j"), F.col("slots"), F.xxhash64(F.lit(seed), F.lit("slot"), "shard")))
    mixture = slots.select("shard", "slot", "source", "block", "round").join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "round", "ids")
    sizes = slots.select("source", "block").join(blocks.select("source", "block", F.size("ids").cast("long").alias("n")), ["source", "block"])
    got = sizes.groupBy("source").agg(F.sum("n").alias("tokens"))
    have = spark.createDataFrame([(s, share[s], repeats[s], counts.get(s, (0, 0))[1]) for s in names], "source string, target_share double, max_repeats int, available_tokens long")
    report = have.join(F.broadcast(got), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # one row for each source
    times = F.when(F.col("available_tokens") > 0, F.col("tokens") / F.col("available_tokens")).otherwise(0.0)
    actual = F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0)
    return mixture, report.select("source", "target_share", actual.alias("actual_share"), "tokens", "available_tokens", times.alias("times"), "max_repeats")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[1]


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
