"""The N highest-scoring items of every group, read from files clustered by group with the help of their row groups' statistics.

The table is written once, sorted by group, falling score and item: a hot group spans many files, and their row groups hold ever
lower scores. The footers' statistics then tell which row groups lie wholly in one group and the highest score in each. Row groups
that hold the start of a group are read at once, those wholly inside a group in the order of falling maximum score, as long as
their maximum isn't strictly below the group's current N-th score. The rest are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.session import cut, staged_path, table, width

_COLS = "g string, m string, p double"
_CATALOG = "file string, rg int, n_rows long, g_lo string, g_hi string, p_hi double, known boolean"


def _open(uri: str) -> pq.ParquetFile:
    if urlparse(uri).scheme in ("", "file"):
        return pq.ParquetFile(unquote(urlparse(uri).path))
    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


def cluster_by_group(df: DataFrame, group: str, item: str, score: str, row_group_bytes: int) -> str:
    """Writes (g, m, p), sorted by g, falling p and m over all files, and gives the path. Rows whose group, item or score is null, or
    whose score is NaN, are no candidates. Range boundaries may fall inside a group, so a hot group is shared by many tasks."""
    p = F.col(f"`{score}`").cast("double")
    t = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{item}`").cast("string").alias("m"), p.alias("p"))
    t = t.where(F.col("g").isNotNull() & F.col("m").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))
    order = [F.col("g").asc(), F.col("p").desc(), F.col("m").asc()]
    path = staged_path(df.sparkSession, "clustered")
    t.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order).write.option("parquet.block.size", str(row_group_bytes)).parquet(path)
    return path


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row group of the files in path, from their footers; known: whether it has all statistics."""
    files = spark.read.schema(_COLS).parquet(path).inputFiles()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for uri in pdf["file"]:
                meta = _open(uri).metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for k in range(meta.num_row_groups):
                    rg = meta.row_group(k)
                    g, p = rg.column(at["g"]).statistics, rg.column(at["p"]).statistics
                    ok = bool(g is not None and g.has_min_max and p is not None and p.has_min_max)
                    out.append((uri, k, rg.num_rows, g.min if ok else None, g.max if ok else None, float(p.max) if ok else None, ok))
            yield pd.DataFrame(out, columns=["file", "rg", "n_rows", "g_lo", "g_hi", "p_hi", "known"])

    if not files:
        return spark.createDataFrame([], _CATALOG)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 4 * width(spark)))
    return cut(listed.mapInPandas(read, _CATALOG))


def _read_groups(todo: DataFrame, n: int) -> DataFrame:
    """The n best distinct items of each group within each of the listed row groups. Their rows are sorted by g and falling p."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, part in pdf.groupby("file"):
                f = _open(uri)
                for k in part["rg"]:
                    rows = f.read_row_group(int(k), columns=["g", "m", "p"], use_threads=False).to_pandas()
                    rows = rows.drop_duplicates(["g", "m"])
                    yield rows[rows.groupby("g").cumcount() < n]

    return todo.select("file", "rg").repartition(4 * width(todo.sparkSession), "file", "rg").mapInPandas(read, _COLS)


def _best(rows: DataFrame, n: int) -> DataFrame:
    once = rows.groupBy("g", "m").agg(F.max("p").alias("p"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), F.asc("m")))).where(F.col("rank") <= n)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = 4 << 20, taken: list[DataFrame] | None = None) -> DataFrame:
    """group, item, score and rank (1 to n) of the n distinct items with the highest score in each group.

    A repeated item counts once, with its highest score; of equal scores the smaller item (as a string) comes first; a group with
    fewer items gives all it has. Rows with a null group, item or score or a NaN score don't count; an empty table gives none;
    further columns, whatever their names, are not read. row_group_bytes: size of the row groups that are read or skipped. taken: a
    list that gets the tables (file, rg) of the row groups read, for those who want to know what was skipped.
    """
    spark = df.sparkSession
    groups = catalog(spark, cluster_by_group(df, group, item, score, row_group_bytes))
    inside = F.col("known") & (F.col("g_lo") == F.col("g_hi"))
    # Of the row groups wholly inside a group, the first has its highest scores, and those after it are in order.
    falling = Window.partitionBy("g_lo").orderBy(F.desc("p_hi"), "file", "rg")
    ranked = cut(groups.where(inside).withColumn("turn", F.row_number().over(falling)))
    start = groups.where(~inside).select("file", "rg").unionByName(ranked.where("turn = 1").select("file", "rg"))
    taken = [] if taken is None else taken
    taken.append(start)
    best = _best(_read_groups(start, n), n)
    last = ranked.agg(F.max("turn")).first()[0] or 1
    if last > 1:
        best = cut(best)
        low, high = 2, 2
        while low <= last:
            nth = best.groupBy("g").agg(F.when(F.count(F.lit(1)) >= n, F.min("p")).alias("nth"))
            due = ranked.where(F.col("turn") >= low).join(nth, ranked["g_lo"] == nth["g"], "left").where(F.col("nth").isNull() | (F.col("p_hi") >= F.col("nth")))
            due = cut(due.select("file", "rg", "g_lo", "turn"))
            if due.isEmpty():
                break
            taken.append(due.where(F.col("turn") <= high).select("file", "rg"))
            more = _read_groups(taken[-1], n)
            best = cut(_best(best.drop("rank").unionByName(more), n))
            low, high = high + 1, 2 * high + 1
    return best.select(F.col("g").alias(group), F.col("m").alias(item), F.col("p").alias(score), F.col("rank").cast("int").alias("rank"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "candidate_pairs"), "s1", "m", "p", 5).select("s1", "m")


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "candidate_pairs"), "s1", "m", "p", 5)


QUERIES = {"p2_found": p2_found, "p2_ranked": p2_ranked}
_RANKED = """SELECT s1, m, p, rank FROM (SELECT s1, m, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m)::INTEGER AS rank
    FROM (SELECT s1, m, max(p) AS p FROM candidate_pairs WHERE p IS NOT NULL AND NOT isnan(p) AND s1 IS NOT NULL AND m IS NOT NULL GROUP BY s1, m)) WHERE rank <= 5"""
ORACLES = {"p2_found": f"SELECT s1, m FROM ({_RANKED})", "p2_ranked": _RANKED}
