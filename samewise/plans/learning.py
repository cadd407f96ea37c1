"""Queries of the models, on the labelled tables, and of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import text as N
from samewise.functions.similarity import token_set_ratio
from samewise.operators import features as X
from samewise.operators import models as M
from samewise.operators import retrieval as R
from samewise.operators.decode import best_per_record, exclusive, macro_fbeta
from samewise.plans.base import train
from samewise.plans.texts import _BIZ, _TOK
from samewise.session import staged, staged_path, table
from samewise.streaming.link import link_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """The ten nearest records of each labelled row with features and label, the features' names, the known matches and the rows."""
    a, b, t = train(spark, d)
    side = lambda df: df.groupBy("entity_id").agg(F.min(F.struct("business_name", "business_address", "country")).alias("r")).select(F.col("entity_id").alias("id"), F.col("r.country").alias("country"), F.col("r.business_name").alias("raw"), F.col("r.business_address").alias("addr")).withColumn("n", N.clean(F.col("raw"))).withColumn("a", N.clean(F.col("addr")))
    a, b = staged(side(a), "left"), staged(side(b), "right")
    doc = lambda df: df.select("id", F.lit("").alias("country"), F.concat(N.tokens(F.col("n")), N.tokens(F.col("a"))).alias("tokens"))
    q, c = R.tfidf(doc(a), doc(b), max_df=0.05)
    near = R.similarity_join(q, c, 10).select("q", "c", F.col("score").alias("tok_score"), F.col("rank").cast("double").alias("tok_rank"))
    x = X.fuzzy_features(X.plain_features(X.joined(near, a, b)))
    names = X.feature_columns(x)
    y = t.withColumn("y", F.lit(1)).withColumnRenamed("s1", "q").withColumnRenamed("m", "c")
    x = x.join(y, ["q", "c"], "left").withColumn("y", F.coalesce("y", F.lit(0))).withColumn("s1", F.col("q")).withColumn("m", F.col("c"))
    return staged(x.select("s1", "m", "q", "c", "y", "n_a", "n_b", *names), "features"), names, t, a


@query
def ml_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Held-out pairs of the two-stage model with their macro F at one threshold."""
    x, names, t, a = _pairs(spark, d)
    p = staged(M.two_stage(x, names), "scores")
    ids = x.withColumn("b", M.bucket(F.col("s1"), "slice", 10)).where("b = 9").select("s1").distinct()
    f = macro_fbeta(exclusive(p).where("p >= 0.5"), t.join(ids, "s1", "left_semi"), ids)
    return p.crossJoin(F.broadcast(f.agg(F.round(F.avg("f"), 4).alias("macro_f"))))  # one row


@query
def ml_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    x, names, *_ = _pairs(spark, d)
    return M.out_of_fold(x, names)


@query
def ml_calibrated(spark: SparkSession, d: str) -> DataFrame:
    x, names, *_ = _pairs(spark, d)
    return M.calibrate(staged(M.out_of_fold(x, names), "oof")).select("s1", "m", "y", "p", "calibrated")


@query
def ml_domain_weights(spark: SparkSession, d: str) -> DataFrame:
    x, names, *_ = _pairs(spark, d)
    x = x.withColumn("half", M.bucket(F.col("s1"), "domain", 2))
    return M.domain_weights(x.where("half = 0"), x.where("half = 1"), names).select("s1", "m", "y", "w")


@query
def ml_self_training(spark: SparkSession, d: str) -> DataFrame:
    x, names, *_ = _pairs(spark, d)
    x = x.withColumn("part", M.bucket(F.col("s1"), "self", 3))
    model = M.self_train(x.where("part = 0"), x.where("part = 1"), names)
    return M.predict(model, x.where("part = 2"), names).select("s1", "m", "y", "p")


def _token_set(a: list[str], b: list[str]) -> list[float]:
    """A stand-in for a text-pair model."""
    return [token_set_ratio(x, y) / 100 for x, y in zip(a, b)]


@query
def ml_scorer(spark: SparkSession, d: str) -> DataFrame:
    x, *_ = _pairs(spark, d)
    return M.with_scorer(x.withColumn("p", F.col("tok_score")), ("n_a", "n_b"), _token_set, "ce").select("s1", "m", "p", "ce")


@query
def ml_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The importance of each feature in a model whose rounds were stopped on a tenth of the rows."""
    x, names, *_ = _pairs(spark, d)
    model = M.fit_trees(x.withColumn("held", M.bucket(F.col("s1"), "held", 10) == 0), names, rounds=60, held="held")
    n = model.stages[-1].getNumTrees
    return spark.createDataFrame([(k, round(v, 6), n) for k, v in M.importances(model, names).items()], "feature string, gain double, rounds int")  # as many rows as features


@query
def ml_pair_file(spark: SparkSession, d: str) -> DataFrame:
    """Examples for a pair model from the labelled tables."""
    x, *_ = _pairs(spark, d)
    return M.pair_file(x.withColumn("p", F.col("tok_score")), "n_a", "n_b")


@query
def ml_feature_dump(spark: SparkSession, d: str) -> DataFrame:
    """Features written by fold of their s1, for comparison elsewhere, and read back."""
    x, names, *_ = _pairs(spark, d)
    path = staged_path(spark, "dump")
    x.withColumn("fold", M.bucket(F.col("s1"), "fold", 2)).select("s1", "m", "y", "fold", *names).write.partitionBy("fold").parquet(path)
    return spark.read.parquet(path).select("s1", "m", "y", "fold", "tok_score", "n_tset", "a_tset")


@query
def ml_route_scorer(spark: SparkSession, d: str) -> DataFrame:
    """New pairs of two routes, scored by the mean of two fold models of the labelled tables on the features of routes, the best row of
    each record that isn't claimed yet."""
    from samewise.operators.features import route_features
    from samewise.plans.base import labelled, scored
    from samewise.plans.flow import FEATURES
    from samewise.plans.texts import _texts_of, biz, bl_new_pairs

    def sides(known: bool) -> list[DataFrame]:
        one = biz(spark, d, known).groupBy("side", "id").agg(F.min(F.struct("raw", "n", "a")).alias("r")).select("side", "id", "r.*")
        return [one.where(f"side = {i}").drop("side") for i in (1, 2)]

    names = [f for f in FEATURES if f not in ("cosine", "n_routes")]
    x = route_features(labelled(spark, d).select("s1", "m", "y"), *sides(True))
    new = bl_new_pairs(spark, d).groupBy(F.col("q").alias("s1"), F.col("c").alias("m")).agg(F.max("cosine").alias("cosine"), F.count(F.lit(1)).alias("n_routes"))
    p = M.mean_of_folds(staged(x, "known"), names, staged(route_features(new, *sides(False)), "new"))
    claimed = exclusive(scored(spark, d).select("s1", "m", "p")).where("p >= 0.9").select("m")
    best = best_per_record(p.select("s1", "m", "p", "cosine", "n_routes"))
    return best.where("p >= 0.5").join(claimed, "m", "left_anti").select("s1", "m", F.round("p", 6).alias("p"), "cosine", "n_routes")


@query
def ml_native(spark: SparkSession, d: str) -> DataFrame:
    """Records in an Indic script: the two nearest spaces give candidates, the mean of two fold models, learnt on the labelled tables' own
    names in such scripts, scores them, with the gap to the record's best; the best row of each that no route has and none claimed."""
    from samewise.operators.features import route_features
    from samewise.operators.windows import gap_and_rank, with_group
    from samewise.plans.base import scored
    from samewise.plans.flow import FEATURES
    from samewise.plans.texts import biz

    names = [f for f in FEATURES if f not in ("cosine", "n_routes")] + ["score", "score_gap_c", "s1_top1"]

    def pairs(known: bool) -> DataFrame:
        x = biz(spark, d, known).withColumn("n", N.base_clean(F.col("raw")))
        one = staged(x.groupBy("side", "id", "country").agg(F.min(F.struct("raw", "n", "a")).alias("r")).select("side", "id", "country", "r.*"), "native")
        docs = one.select("side", "id", "country", "raw", N.tokens(F.col("n")).alias("nt"), N.tokens(F.col("a")).alias("at"))
        q, c = R.two_spaces(docs.where("side = 2").where(N.has_indic(F.col("raw"))), docs.where("side = 1"), "nt", "at")
        near = R.similarity_join(q, c, 5, 0.05).select(F.col("c").alias("s1"), F.col("q").alias("m"), "score", "rank")
        near = gap_and_rank(near, "score", "m", "s1", "c").withColumn("_one", (F.col("rank") == 1).cast("int"))
        near = with_group(near, "s1", s1_top1=F.sum("_one").cast("double")).drop("_one")
        return route_features(near, *[one.where(f"side = {i}") for i in (1, 2)])

    t = train(spark, d)[2].distinct().withColumn("y", F.lit(1))
    known = pairs(True).join(t, ["s1", "m"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    p = M.mean_of_folds(staged(known, "known"), names, staged(pairs(False), "new"))
    best = best_per_record(p.select("s1", "m", "p")).where("p >= 0.5")
    claimed = exclusive(scored(spark, d).select("s1", "m", "p")).where("p >= 0.9").select("m")
    return best.join(claimed, "m", "left_anti").join(table(spark, d, "candidate_pairs").select("s1", "m"), ["s1", "m"], "left_anti").select("s1", "m", F.round("p", 6).alias("p"))


@query
def nm_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Names in Indic scripts, their words replaced by the learned dictionary where it has them, the rest transcribed by rule."""
    from samewise.plans.texts import biz

    x = biz(spark, d).where(N.has_indic(F.col("raw"))).select("id", "raw")
    return N.with_dictionary(x, "raw", ml_dictionary(spark, d), "put").select("id", N.base_clean(F.col("put")).alias("name"), N.base_clean(F.col("raw")).alias("by_rule"))


@query
def ml_dictionary(spark: SparkSession, d: str) -> DataFrame:
    a, b, t = train(spark, d)
    p = t.join(a.select(F.col("entity_id").alias("s1"), F.col("business_name").alias("a")), "s1").join(b.select(F.col("entity_id").alias("m"), F.col("business_name").alias("b")), "m")
    return M.learn_dictionary(p, least=2)


@query
def st_link(spark: SparkSession, d: str) -> DataFrame:
    """The records of both noisy sources linked as a stream, matches of all micro-batches."""
    cols = ("entity_id", "business_name", "business_address", "country")
    clean = table(spark, d, "test_source1").select(*cols)
    files, out = staged_path(spark, "arriving"), staged_path(spark, "matches")
    noisy = table(spark, d, "test_source2").select(*cols).unionByName(table(spark, d, "test_source3").select(*cols))
    noisy.repartition(2).write.parquet(files)
    link_stream(spark, clean, files, out, staged_path(spark, "offsets")).awaitTermination()
    found = spark.read.schema("s1 string, m string, p double").parquet(f"{out}/batch=*")
    return best_per_record(found.distinct()).select("s1", "m", F.round("p", 6).alias("p")).distinct()


_DOCS = f"dc AS (SELECT side, id, country, list_concat({_TOK.format('n')}, {_TOK.format('a')}) AS l FROM (SELECT side, id, r.n AS n, r.a AS a, r.country AS country FROM (SELECT side, id, min(struct_pack(raw := raw, addr := addr, country := country, n := n, a := a)) AS r FROM cl GROUP BY side, id)))"
ORACLES["st_link"] = f"""WITH {_BIZ}, {_DOCS}, n AS (SELECT country, count(*) AS n FROM dc WHERE side = 1 GROUP BY country), t AS (SELECT side, id, country, t, count(*) AS tf FROM (SELECT side, id, country, unnest(l) AS t FROM dc) WHERE t <> '' GROUP BY ALL), df AS (SELECT country, t, count(*) AS df FROM t WHERE side = 1 GROUP BY country, t),
    w AS (SELECT side, id, t.country, t.t, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM t JOIN df USING (country, t) JOIN n USING (country) WHERE df <= greatest(0.05 * n, 1.0)), u AS (SELECT side, id, country, t, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w),
    s AS (SELECT a.id AS m, b.id AS s1, round(sum(a.w * b.w), 6) AS p FROM u a JOIN u b ON a.country = b.country AND a.t = b.t AND a.side = 2 AND b.side = 1 GROUP BY 1, 2) SELECT s1, m, p FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS k FROM s WHERE p >= 0.3) WHERE k = 1"""
