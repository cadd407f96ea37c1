"""Classifiers of pairs on Spark ML: one and two stages, out of fold, importance weights, self-training, calibration, pluggable scorers
and a learned transliteration dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.similarity import udf_jaro_winkler
from samewise.functions.text import has_indic, nfkd
from samewise.operators.decode import bucket
from samewise.operators.windows import gap_and_rank, second_best, with_group
from samewise.session import staged, staged_alone


def fit_trees(train: DataFrame, features: list[str], label: str = "y", weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 7, held: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Boosted trees on numeric features; missing values are -1. held: a boolean column whose rows aren't learnt from but stop the rounds
    once they no longer gain by tolerance."""
    gbt = GBTClassifier(featuresCol="x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, cacheNodeIds=False)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if held:
        gbt = gbt.setValidationIndicatorCol(held)
        gbt.set(gbt.validationTol, tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), gbt]).fit(train.na.fill(-1.0, features).withColumn(label, F.col(label).cast("double")))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    filled = df.na.fill(-1.0, features)
    return model.transform(filled).withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(sorted(zip(features, map(float, model.stages[-1].featureImportances)), key=lambda t: -t[1]))


def score_context(df: DataFrame, p: str = "p1") -> DataFrame:
    """df (s1, m, p1, …) with the ranks, gaps, sums, counts and margins of p1 within its s1 and its m."""
    x = gap_and_rank(gap_and_rank(df, p, "s1", "m", "q"), p, "m", "s1", "c")
    first = x.columns
    x = with_group(x, "s1", **{f"{p}_sum_q": F.sum(p), f"{p}_n50_q": F.count_if(F.col(p) > 0.5)})
    x = second_best(x, p, "s1", f"{p}_margin_q")  # all of one key, then all of the other: rows move once for each
    x = with_group(x, "m", **{f"{p}_sum_c": F.sum(p), f"{p}_n30_c": F.count_if(F.col(p) > 0.3)})
    x = second_best(x, p, "m", f"{p}_margin_c").select(*first, *[f"{p}_{c}" for c in ("sum_q", "n50_q", "sum_c", "n30_c", "margin_q", "margin_c")])
    ints = [c for c, t in x.dtypes if t == "bigint" and c.startswith(f"{p}_")]
    return x.withColumns({c: F.col(c).cast("double") for c in ints})


def two_stage(pairs: DataFrame, features: list[str], slices: int = 10, swap: bool = False, top: int = 15, least: float = 0.005, others: DataFrame | None = None) -> DataFrame:
    """s1, m, y, p of the held-out tenth of s1, or of others (s1, m, features), all of whose pairs come back. Stage one learns on one half
    of the rest and scores all pairs; their context and the score join the features of stage two, which learns on the other half, on
    pairs within the top ranks and above least. A pair outside of these keeps the score of stage one."""
    x = pairs.withColumn("_b", bucket(F.col("s1"), "slice", slices))
    half = slices // 2
    a, b = (F.col("_b") < half), (F.col("_b") >= half) & (F.col("_b") < slices - 1)
    first, second = (b, a) if swap else (a, b)
    one = fit_trees(x.where(first), features)
    within = (F.col("p1_rank_q") <= top) & (F.col("p1") >= least)

    def stage(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs of df within with all columns, and the context of all: made of ids and scores, without the features."""
        scored = staged(predict(one, df, features, "p1").withColumn("_i", F.monotonically_increasing_id()), "first")
        context = staged_alone(lambda: score_context(scored.select("_i", "s1", "m", "p1")), "context")
        return scored.drop("p1").join(context.where(within).drop("s1", "m"), "_i").drop("_i"), context.drop("_i")

    scored, context = stage(x)
    more = features + [c for c in context.columns if c.startswith("p1")]
    two = fit_trees(scored.where(second), more)
    if others is None:
        return predict(two, scored.where(F.col("_b") == slices - 1), more).select("s1", "m", "y", "p")
    given, context = stage(others)
    rest = context.where(~within).select("s1", "m", F.lit(None).cast("int").alias("y"), F.col("p1").alias("p"))
    return predict(two, given, more).select("s1", "m", F.lit(None).cast("int").alias("y"), "p").unionByName(rest)


def mean_of_folds(pairs: DataFrame, features: list[str], others: DataFrame, folds: int = 2) -> DataFrame:
    """others with p: the mean over models that each leave out one fold of the s1 of pairs."""
    x = pairs.withColumn("_fold", bucket(F.col("s1"), "fold", folds))
    out = others
    for f in range(folds):
        out = predict(fit_trees(x.where(F.col("_fold") != f), features), out, features, f"_p{f}")
    return out.withColumn("p", sum(F.col(f"_p{f}") for f in range(folds)) / folds).drop(*[f"_p{f}" for f in range(folds)])


def pair_file(pairs: DataFrame, text_a: str, text_b: str, near: int = 5, far: int = 10, share: int = 35) -> DataFrame:
    """s1, m, text_a, text_b, y, part: examples for a pair model: all matches, the others within the near best ranks, and share percent
    of those up to far, by a stable bucket; part: val for a twentieth of the s1, test for another, else train. pairs: with p and y."""
    from samewise.operators.windows import ordered

    k = ordered(pairs.select("s1", "m", "p", "y", text_a, text_b), ["s1"], [F.desc("p"), F.asc("m")], "_k")
    some = F.col("_k").between(near + 1, far) & (bucket(F.concat("s1", "m"), "pair", 100) < share)
    b = bucket(F.col("s1"), "band", 20)
    part = F.when(b == 0, "val").when(b == 1, "test").otherwise("train")
    return k.where((F.col("y") == 1) | (F.col("_k") <= near) | some).select("s1", "m", F.col(text_a).alias("text_a"), F.col(text_b).alias("text_b"), "y", part.alias("part"))


def out_of_fold(pairs: DataFrame, features: list[str], folds: int = 2) -> DataFrame:
    """s1, m, y, fold, p: each fold's rows scored by a model of the others; an s1 is in one fold only."""
    x = pairs.withColumn("fold", bucket(F.col("s1"), "fold", folds))
    out = None
    for f in range(folds):
        part = predict(fit_trees(x.where(F.col("fold") != f), features), x.where(F.col("fold") == f), features).select("s1", "m", "y", "fold", "p")
        out = part if out is None else out.unionByName(part)
    return out


def domain_weights(source: DataFrame, target: DataFrame, features: list[str], low: float = 0.2, high: float = 5.0) -> DataFrame:
    """source with w: the odds that a row comes from target, within low and high, then with mean 1."""
    both = source.select(*features).withColumn("_d", F.lit(0.0)).unionByName(target.select(*features).withColumn("_d", F.lit(1.0))).na.fill(-1.0)
    lr = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), LogisticRegression(featuresCol="x", labelCol="_d", maxIter=20, regParam=0.01)]).fit(both)
    x = predict(lr, source, features, "_p")
    ratio = target.count() / max(1, source.count())
    x = x.withColumn("w", F.least(F.lit(high), F.greatest(F.lit(low), F.col("_p") / (1 - F.col("_p") + 1e-9) / ratio))).drop("_p")
    return x.crossJoin(F.broadcast(x.agg(F.avg("w").alias("_m")))).withColumn("w", F.col("w") / F.col("_m")).drop("_m")  # one row


def self_train(labelled: DataFrame, other: DataFrame, features: list[str], high: float = 0.95, low: float = 0.05) -> PipelineModel:
    """A model of labelled and of those rows of other that a first model is sure of."""
    p = predict(fit_trees(labelled, features), other, features, "_p").where((F.col("_p") >= high) | (F.col("_p") <= low))
    pseudo = p.withColumn("y", (F.col("_p") >= high).cast("int")).select("y", *features)
    return fit_trees(labelled.select("y", *features).unionByName(pseudo), features)


def calibrate(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """scored with `calibrated`: the isotonic fit of y on p."""
    x = scored.withColumn(y, F.col(y).cast("double"))
    return IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(x).transform(x)


def with_scorer(pairs: DataFrame, texts: tuple[str, str], score: Callable[[list[str], list[str]], list[float]], name: str, low: float = 0.02, high: float = 0.998, batch: int = 512) -> DataFrame:
    """pairs with name: a scorer's value for the pairs whose p lies between low and high, else null. score takes two lists of texts;
    it gets batches of texts of like length. A model it needs is loaded by itself, once a worker."""
    a, b = texts
    band = pairs.where((F.col("p") >= low) & (F.col("p") < high))
    near = band.withColumn("_n", F.length(a) + F.length(b)).sortWithinPartitions("_n").select("s1", "m", a, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"s1": part["s1"], "m": part["m"], name: score(part[a].tolist(), part[b].tolist())})

    return pairs.join(near.mapInPandas(run, f"s1 string, m string, {name} double"), ["s1", "m"], "left")


def learn_dictionary(pairs: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """(native, latin, n): for each word in an Indic script the Latin word of matched names (a, b) that stands opposite to it most often,
    weighed by its likeness to the word's transliteration, if often enough."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[\\s,.&/()-]+"), lambda t: t != ""))
    both = pairs.select(words("a").alias("x"), words("b").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    w = both.select(F.explode("x").alias("native"), "y").where(has_indic(F.col("native")))
    n = w.groupBy("native").agg(F.count(F.lit(1)).alias("seen"))
    c = w.select("native", F.explode("y").alias("latin")).where(~has_indic(F.col("latin"))).groupBy("native", "latin").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("native").orderBy(F.desc("n"), "latin"))).where("k <= 15")
    c = c.join(n, "native").where((F.col("n") >= least) & (F.col("n") >= share * F.col("seen")))
    c = c.withColumn("score", F.col("n") * (0.5 + udf_jaro_winkler(nfkd("native"), F.col("latin"))))
    best = Window.partitionBy("native").orderBy(F.desc("score"), "latin")
    return c.withColumn("r", F.row_number().over(best)).where("r = 1").select("native", "latin", "n")
