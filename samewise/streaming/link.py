"""Linking of records as they arrive: an extension, for the operators themselves work on whole tables.

The clean source's weights are made and written once, before the stream starts, from the clean source alone. Each micro-batch of noisy
records is held against them, so a record's match doesn't depend on the batch it came in, and its matches are appended to a table. A
batch that is run again after a failure replaces its own folder, so no match is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samewise.functions import text as N
from samewise.operators import retrieval as R
from samewise.operators.decode import best_per_record
from samewise.session import staged

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def _documents(df: DataFrame) -> DataFrame:
    """(id, country, tokens); of rows with one id the least by name, address and country."""
    one = df.groupBy("entity_id").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")])).alias("r"))
    return one.select(F.col("entity_id").alias("id"), "r.country", F.concat(*[N.tokens(N.clean(F.col(f"r.{c}"))) for c in ("business_name", "business_address")]).alias("tokens"))


def prepare(clean: DataFrame, max_df: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The written weights of the clean source and its inverse document frequencies."""
    weights, idf = R.fitted(_documents(clean), max_df)
    return staged(weights, "clean"), staged(idf, "idf")


def match_batch(clean: DataFrame | tuple[DataFrame, DataFrame], batch: DataFrame, least: float = 0.3) -> DataFrame:
    """s1, m, p: the best clean row of each record by the inner product of TF-IDF words of name and address, if p reaches least. clean: the
    clean source, or what prepare made of it."""
    weights, idf = clean if isinstance(clean, tuple) else prepare(clean)
    s = R.similarity_join(R.weighed(_documents(batch), idf), weights, 1, least).select(F.col("c").alias("s1"), F.col("q").alias("m"), F.col("score").alias("p"))
    return best_per_record(s)


def link_stream(spark: SparkSession, clean: DataFrame, folder: str, out: str, checkpoint: str, files_per_batch: int = 1, least: float = 0.3) -> StreamingQuery:
    """Starts the stream of parquet files that appear in folder; matches lie in out/batch=N."""
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    prepared = prepare(clean)

    def write(batch: DataFrame, number: int) -> None:
        match_batch(prepared, batch, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
