"""Queries of problem 1: results for every country and name, although a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators.skew import heavy_keys, per_key
from samewise.session import cut, table

KEYS = ["country", "business_name"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "test_source1"), KEYS, "business_address", "entity_id", 0.04)


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every (country, business_name) and, merged from those, for every country."""
    names = cut(per_key(table(spark, sf_dir, "test_source1"), KEYS, "business_address", "entity_id"))
    sums = [F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id")]
    countries = names.groupBy("country").agg(*sums).select(F.lit("country").alias("level"), "country", F.lit(None).cast("string").alias("business_name"), "n_rows", "n_values", "min_id", "max_id")
    return names.select(F.lit("name").alias("level"), *KEYS, "n_rows", "n_values", "min_id", "max_id").unionByName(countries)


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every name, the stretches of rows, in the order of entity_id, with the same country: the states at chunk ends decide."""
    return per_key(table(spark, sf_dir, "test_source1"), ["business_name"], "country", "entity_id", order_by="entity_id")


QUERIES = {"p1_found": p1_found, "p1_stats": p1_stats, "p1_runs": p1_runs}

_STATS = "count(*)::BIGINT AS n_rows, count(business_address)::BIGINT AS n_values, min(entity_id) AS min_id, max(entity_id) AS max_id"
ORACLES = {
    "p1_found": """SELECT country, business_name FROM test_source1 WHERE country IS NOT NULL AND business_name IS NOT NULL
        GROUP BY country, business_name HAVING count(*) >= 0.04 * (SELECT count(*) FROM test_source1)""",
    "p1_stats": f"""SELECT 'name' AS level, country, business_name, {_STATS} FROM test_source1 GROUP BY country, business_name
        UNION ALL SELECT 'country' AS level, country, NULL::VARCHAR AS business_name, {_STATS} FROM test_source1 GROUP BY country""",
    "p1_runs": """SELECT business_name, count(*)::BIGINT AS n_rows, count(country)::BIGINT AS n_values, min(entity_id) AS min_id, max(entity_id) AS max_id,
        sum(CASE WHEN rn > 1 AND country IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END)::BIGINT AS n_runs
        FROM (SELECT *, row_number() OVER w AS rn, lag(country) OVER w AS prev FROM test_source1 WINDOW w AS (PARTITION BY business_name ORDER BY entity_id))
        GROUP BY business_name""",
}
