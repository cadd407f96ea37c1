"""Ranks, running sums and competition features within groups.

`ordered` numbers the rows of each group without bringing a group to one task: rows are range-partitioned by group and order, each
range is numbered by itself, and the few groups that span ranges carry on from the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.session import staged, width


def ordered(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", sums: dict[str, str] | None = None) -> DataFrame:
    """df with rank (1, 2, … within the rows of equal keys, in order) and, for each new column of sums, the running sum of an old one
    up to and with the row. order must be total for the result to be stable. Null keys are a group; an empty df gives an empty one."""
    sums = sums or {}
    ranged = staged(df.repartitionByRange(width(df.sparkSession), *keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn(rank, F.count(F.lit(1)).over(inside)).withColumns({new: F.sum(old).over(inside) for new, old in sums.items()})
    totals = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(old).alias(f"_s{i}") for i, old in enumerate(sums.values())])
    of, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_k", F.count(F.lit(1)).over(of)).where("_k > 1")  # at most two rows for each boundary between ranges
    carry = carry.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.sum("_n").over(before).alias("_bn"), *[F.sum(f"_s{i}").over(before).alias(f"_b{i}") for i in range(len(sums))])
    on = (F.col("_range") == F.col("_r")) & F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    out = out.join(F.broadcast(carry), on, "left")
    out = out.withColumn(rank, (F.col(rank) + F.coalesce("_bn", F.lit(0))).cast("long"))
    out = out.withColumns({new: F.col(new) + F.coalesce(f"_b{i}", F.lit(0)) for i, new in enumerate(sums)})
    return out.select(*df.columns, rank, *sums)


def with_group(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """df with aggregates over the rows of equal key: partial sums are combined before the shuffle, and a hot key's rows can be split
    by the join. Null keys get nulls."""
    return df.join(df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()]), key, "left")


def gap_and_rank(df: DataFrame, score: str, key: str, tie: str, suffix: str) -> DataFrame:
    """`{score}_gap_{suffix}` (to the group's best) and `{score}_rank_{suffix}` (1 is best; equal scores by tie)."""
    out = with_group(df, key, _best=F.max(score)).withColumn(f"{score}_gap_{suffix}", F.col(score) - F.col("_best")).drop("_best")
    return ordered(out, [key], [F.desc(score), F.asc(tie)], f"{score}_rank_{suffix}")


def best_two(df: DataFrame, score: str, key: str) -> DataFrame:
    """(key, _m1, _m2): the two highest values of each group, equal ones counted apart; _m2 is null in a group of one. Both are maxima,
    which each task combines before the shuffle: no group is ever gathered."""
    top = df.groupBy(key).agg(F.max(score).alias("_m1"))
    rest = df.join(top, key).groupBy(key).agg(F.first("_m1").alias("_m1"), F.count_if(F.col(score) == F.col("_m1")).alias("_n"), F.max(F.when(F.col(score) < F.col("_m1"), F.col(score))).alias("_r"))
    return rest.select(key, "_m1", F.when(F.col("_n") > 1, F.col("_m1")).otherwise(F.col("_r")).alias("_m2"))


def second_best(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """name: the margin of score over the best other value of its group: positive for the single best row, 0 where several share the
    best, negative below it. A group of one row is held against 0."""
    best = best_two(df, score, key).na.fill(0.0, ["_m2"])
    margin = F.when(F.col(score) >= F.col("_m1"), F.col(score) - F.col("_m2")).otherwise(F.col(score) - F.col("_m1"))
    return df.join(best, key, "left").withColumn(name, margin).drop("_m1", "_m2")


def average_rank_quantile(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """name: the average rank of score among its group's values, divided by their number."""
    counts = df.groupBy(key, score).agg(F.count(F.lit(1)).alias("_c"))
    low = ordered(counts, [key], [F.asc(score)], "_i", {"_upto": "_c"})
    total = counts.groupBy(key).agg(F.sum("_c").alias("_all"))
    rank = low.join(total, key).select(key, score, ((F.col("_upto") - F.col("_c") + F.col("_upto") + 1) / 2 / F.col("_all")).alias(name))
    return df.join(rank, [key, score], "left")


def twins(df: DataFrame, score: str, key: str, least: float, name: str) -> DataFrame:
    """name: how many rows of the group have a score of least or more."""
    return with_group(df, key, **{name: F.count_if(F.col(score) >= least)})


def global_context(df: DataFrame, score: str, twin: float) -> DataFrame:
    """df (s1, m, score, …) with ranks and gaps of score within its m (c) and its s1 (q), twins_c and twins_q (rows with twin or more), and
    margins over the best other value of each."""
    x = gap_and_rank(gap_and_rank(df, score, "s1", "m", "q"), score, "m", "s1", "c")
    x = twins(twins(x, score, "m", twin, "twins_c"), score, "s1", twin, "twins_q")
    return second_best(second_best(x, score, "m", f"{score}_margin_c"), score, "s1", f"{score}_margin_q")


def triangle(pairs: DataFrame, texts: DataFrame, scorer, name: str) -> DataFrame:
    """pairs (s1, m, p) with name: the likeness by scorer of m's text to that of the anchor, the most likely other record of its s1; -1
    without one. texts: (m, text), one for each record."""
    from samewise.functions.similarity import scored_once

    k = ordered(pairs.select("s1", "m", "p"), ["s1"], [F.desc("p"), F.asc("m")], "_k")
    first, second = (k.where(F.col("_k") == i).select("s1", F.col("m").alias(f"_m{i}")) for i in (1, 2))
    x = k.join(first, "s1", "left").join(second, "s1", "left").withColumn("_anchor", F.when(F.col("_k") == 1, F.col("_m2")).otherwise(F.col("_m1")))
    t = lambda i, c: texts.select(F.col("m").alias(i), F.col("text").alias(c))
    x = x.join(t("m", "_own"), "m", "left").join(t("_anchor", "_other"), "_anchor", "left").withColumn("_own", F.coalesce("_own", F.lit("")))
    x = x.withColumn("_other", F.when(F.col("_anchor").isNotNull(), F.coalesce("_other", F.lit(""))))
    return scored_once(x, "_other", "_own", {name: scorer}).withColumn(name, F.coalesce(name, F.lit(-1.0))).select("s1", "m", "p", name)
