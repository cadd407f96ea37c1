"""Per-key results when a few keys hold most rows.

Rows are numbered as a stable counting sort would place them: the rows of each key are counted for each input partition, the
counts' prefix sums in key order are the offsets, and a row's number is its offset plus its place among the rows of its key in
its partition. Equal ranges of numbers are the chunks: each is the work of one task, whatever the keys' sizes. A key that spans
chunks gets one state for each; the states are merged in the order of the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.session import cut, width


def _code(keys: list[str]) -> Column:
    """One string for the values of keys, equal just when all are equal, nulls included, and never null."""
    part = [F.coalesce(F.concat(F.lit("v"), F.length(F.col(f"`{k}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{k}`").cast("string")), F.lit("n")) for k in keys]
    return F.concat(*part)


def number_rows(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """df with `_key` (the code of the keys) and `_pos` (0, 1, 2, … over all rows, those of a key adjacent and in input order), and
    the number of rows. No row limit, no sampling; nulls are keys like any other."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = cut(df)  # df is read twice below, and after a shuffle its partitions could differ between the two
    src = df.withColumn("_key", _code(keys)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id())
    n = width(df.sparkSession)
    counts = src.groupBy("_key", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each key and input partition, split evenly by range: the prefix sums need no task that sees all of them.
    ranged = cut(counts.repartitionByRange(n, "_key", "_pid").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))  # one row for each range: n rows
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy("_key", "_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.join(F.broadcast(before), "_range").select("_key", "_pid", (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_key", "_pid").orderBy("_at")) - 1
    rows = src.withColumn("_place", place).join(offsets, ["_key", "_pid"]).withColumn("_pos", F.col("_offset") + F.col("_place"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    return rows.drop("_pid", "_at", "_offset", "_place"), total


def per_key(df: DataFrame, keys: list[str], value: str, ident: str, chunk_rows: int | None = None, order_by: str | None = None) -> DataFrame:
    """One row for each combination of keys: keys, n_rows, n_values (not null), min_id, max_id, n_runs (maximal stretches of equal
    value among its rows, in input order or, if given, in that of order_by).

    chunk_rows: rows of a chunk; by default a quarter of what each shuffle partition would hold, so that every task gets
    several. Null keys form groups of their own; null values are equal to each other; an empty table gives no row; other columns of
    df are not read.
    """
    cols = list(dict.fromkeys([*keys, value, ident, *([order_by] if order_by else [])]))
    src = df.select(*[F.col(f"`{c}`") for c in cols])
    src = src.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = {c: f"c{i}" for i, c in enumerate(cols)}
    if order_by:
        src = src.repartitionByRange(width(df.sparkSession), at[order_by]).sortWithinPartitions(at[order_by])
        src = cut(src)
    rows, total = number_rows(src, [at[k] for k in keys])
    size = chunk_rows or max(1, min(1 << 20, total // (4 * width(df.sparkSession)) or 1))
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(size)).cast("long"))
    in_chunk = Window.partitionBy("_chunk").orderBy("_pos")
    v, ident_, key_cols = at[value], at[ident], [at[k] for k in keys]
    new = (F.lag("_key").over(in_chunk).eqNullSafe(F.col("_key")) & F.lag(v).over(in_chunk).eqNullSafe(F.col(v))).cast("int")
    states = (
        rows.withColumn("_new", 1 - new)
        .groupBy("_chunk", "_key", *key_cols)
        .agg(
            F.count(F.lit(1)).alias("n"), F.count(v).alias("nv"), F.min(ident_).alias("lo"), F.max(ident_).alias("hi"), F.sum("_new").alias("runs"),
            F.min_by(F.struct(F.col(v).alias("v")), "_pos").alias("first"), F.max_by(F.struct(F.col(v).alias("v")), "_pos").alias("last"),
        )
    )
    along = Window.partitionBy("_key").orderBy("_chunk")  # of a key, one row for each chunk it reaches into
    joined = F.lag("last").over(along).isNotNull() & F.lag("last").over(along)["v"].eqNullSafe(F.col("first")["v"])
    merged = states.withColumn("joined", joined.cast("int")).groupBy("_key", *key_cols).agg(
        F.sum("n").alias("n_rows"), F.sum("nv").alias("n_values"), F.min("lo").alias("min_id"), F.max("hi").alias("max_id"), (F.sum("runs") - F.sum("joined")).alias("n_runs")
    )
    return merged.select(*[F.col(at[k]).alias(k) for k in keys], "n_rows", "n_values", "min_id", "max_id", "n_runs")


def heavy_keys(df: DataFrame, keys: list[str], value: str, ident: str, least_share: float, chunk_rows: int | None = None) -> DataFrame:
    """The combinations of keys, all not null, that hold at least least_share of all rows of df (rows with null keys count as rows)."""
    stats = cut(per_key(df, keys, value, ident, chunk_rows))
    total = stats.agg(F.sum("n_rows").alias("all_rows"))
    known = stats
    for k in keys:
        known = known.where(F.col(f"`{k}`").isNotNull())
    # one row: the total
    return known.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= F.lit(least_share) * F.col("all_rows")).select(*keys)
