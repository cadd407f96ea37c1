"""From scored pairs (s1, m, p) to matches: exclusivity, thresholds, expected F, blends and the metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.windows import ordered, with_group

#: Lower edges of the probability bands, and the upper end of the last.
BAND_EDGES = (0.5, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 1.01)


def exclusive(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """The rows whose p is the highest of their m. Ties stay; strict keeps the smallest s1 of them."""
    best = pairs.join(pairs.groupBy("m").agg(F.max("p").alias("_p")), "m").where("p = _p").drop("_p").select(*pairs.columns)
    if not strict:
        return best
    return best.join(best.groupBy("m").agg(F.min("s1").alias("s1")), ["s1", "m"]).select(*pairs.columns)


def decode(pairs: DataFrame, threshold: float, excl: bool = True) -> DataFrame:
    return (exclusive(pairs) if excl else pairs).where(F.col("p") >= threshold).select("s1", "m")


def decode_by_partition(pairs: DataFrame, thresholds: dict[str, float], default: float = 0.9, partition: str = "country") -> DataFrame:
    """The threshold of each partition's label; unknown labels and null get the default."""
    t = F.lit(default)
    for label, x in thresholds.items():
        t = F.when(F.col(partition) == label, F.lit(x)).otherwise(t)
    return exclusive(pairs).where(F.col("p") >= t).select("s1", "m")


def decode_expected_f(pairs: DataFrame, beta: float = 0.5, floor: float = 0.02, excl: bool = True) -> DataFrame:
    """Of each s1 the k best pairs with the highest expected F-beta, or none if no match at all is likelier to score."""
    b2 = beta * beta
    d = (exclusive(pairs) if excl else pairs).where(F.col("p") >= floor)
    d = with_group(d, "s1", _s=F.sum("p"), _p0=F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), 1 - F.col("p")))))))
    d = ordered(d, ["s1"], [F.desc("p"), F.asc("m")], "_k", {"_cum": "p"})
    d = d.withColumn("_e", F.round((1 + b2) * F.col("_cum") / (F.col("_k") + b2 * F.col("_s")), 9))
    best = d.groupBy("s1").agg(F.max(F.struct(F.col("_e"), (-F.col("_k")).alias("_nk"))).alias("_b")).select("s1", F.col("_b._e").alias("_emax"), (-F.col("_b._nk")).alias("_kb"))
    return d.join(best, "s1").where((F.col("_k") <= F.col("_kb")) & (F.col("_emax") > F.col("_p0"))).select("s1", "m")


def band(p: Column) -> Column:
    """The lower edge of the band p lies in, or null."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(BAND_EDGES[:-1], BAND_EDGES[1:]):
        out = F.when((p >= lo) & (p < hi), F.lit(lo)).otherwise(out)
    return out


def prior_thresholds(valid: DataFrame, test: DataFrame, least_precision: float = 0.78) -> DataFrame:
    """country, threshold: the lowest band edge above which every band's estimated precision on test reaches least_precision, else
    0.99. valid: (s1, country, y, p); test: (s1, country, p). A band's expected matches per s1 come from valid (from the mean of the
    labelled countries where there is none), its pairs per s1 from test; bands that valid lacks everywhere are skipped."""
    low = BAND_EDGES[0]
    nv = valid.groupBy("country").agg(F.countDistinct("s1").alias("n"))
    vt = valid.where(F.col("p") >= low).withColumn("band", band(F.col("p"))).groupBy("country", "band").agg(F.sum("y").alias("tp"))
    vt = vt.join(nv, "country").select("country", "band", (F.col("tp") / F.col("n")).alias("tp_per"))
    mean = vt.groupBy("band").agg(F.avg("tp_per").alias("tp_mean"))
    nt = test.groupBy("country").agg(F.countDistinct("s1").alias("n"))
    tt = test.where(F.col("p") >= low).withColumn("band", band(F.col("p"))).groupBy("country", "band").agg(F.count(F.lit(1)).alias("pairs"))
    tt = tt.join(nt, "country").select("country", "band", (F.col("pairs") / F.col("n")).alias("per"))
    est = tt.join(vt, ["country", "band"], "left").join(mean, "band").withColumn("prec", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("tp_per", "tp_mean") / F.col("per"))), 9))
    # ten rows for each country at most
    down = Window.partitionBy("country").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, 0)
    est = est.withColumn("ok", F.min((F.col("prec") >= least_precision).cast("int")).over(down))
    return est.groupBy("country").agg(F.coalesce(F.min(F.when(F.col("ok") == 1, F.col("band"))), F.lit(0.99)).alias("threshold"))


def macro_fbeta(pred: DataFrame, truth: DataFrame, ids: DataFrame, beta: float = 0.5) -> DataFrame:
    """s1, n_pred, n_true, tp, f of every row of ids. Nothing expected and nothing given is 1, no hit else is 0."""
    b2 = beta * beta
    p, t = pred.select("s1", "m").distinct().withColumn("_p", F.lit(1)), truth.select("s1", "m").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, ["s1", "m"], "full").groupBy("s1").agg(F.sum(F.coalesce("_p", F.lit(0))).alias("n_pred"), F.sum(F.coalesce("_t", F.lit(0))).alias("n_true"), F.sum(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("tp"))
    out = ids.select("s1").distinct().join(both, "s1", "left").na.fill(0, ["n_pred", "n_true", "tp"])
    f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + b2) * F.col("tp") / (b2 * F.col("n_true") + F.col("n_pred")))
    return out.withColumn("f", f)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blend(p: Column, other: Column, weight: float) -> Column:
    """The weighted logit mean of p and other; p where other is null."""
    return F.when(other.isNull(), p).otherwise(sigmoid(weight * logit(p) + (1 - weight) * logit(other)))


def ensemble(runs: list[tuple[DataFrame, float]]) -> DataFrame:
    """s1, m, p: the weighted logit mean over the runs that have the pair."""
    parts = [df.select("s1", "m", (w * logit(F.col("p"))).alias("l"), F.lit(float(w)).alias("w")) for df, w in runs]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("s1", "m").agg(sigmoid(F.sum("l") / F.sum("w")).alias("p"))


def mean_runs(runs: list[DataFrame]) -> DataFrame:
    """s1, m, p: the mean over the runs that have a value."""
    every = runs[0].select("s1", "m", "p")
    for x in runs[1:]:
        every = every.unionByName(x.select("s1", "m", "p"))
    return every.groupBy("s1", "m").agg(F.avg("p").alias("p"))


def override(scores: DataFrame, better: DataFrame, partition: str, labels: list[str]) -> DataFrame:
    """scores with the rows of the labelled partitions taken from better."""
    return scores.where(~F.coalesce(F.col(partition).isin(labels), F.lit(False))).unionByName(better.where(F.col(partition).isin(labels)).select(*scores.columns))


def grid(pairs: DataFrame, truth: DataFrame, ids: DataFrame, thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """excl, threshold, f: the macro F of each decoder, all thresholds in one pass over the pairs."""
    spark = pairs.sparkSession
    b2 = beta * beta
    cells = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")  # a list of parameters
    t = truth.select("s1", "m").distinct().withColumn("y", F.lit(1))
    n_true = t.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    out = None
    pairs = pairs.select("s1", "m", "p")
    for excl, d in ((True, exclusive(pairs)), (False, pairs)):
        got = d.join(t, ["s1", "m"], "left").crossJoin(F.broadcast(cells)).where("p >= threshold").groupBy("s1", "threshold").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
        full = ids.select("s1").distinct().crossJoin(F.broadcast(cells)).join(n_true, "s1", "left").join(got, ["s1", "threshold"], "left").na.fill(0)
        f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + b2) * F.col("tp") / (b2 * F.col("n_true") + F.col("n_pred")))
        one = full.groupBy("threshold").agg(F.avg(f).alias("f")).withColumn("excl", F.lit(excl))
        out = one if out is None else out.unionByName(one)
    return out


def blend_search(pairs: DataFrame, other: str, truth: DataFrame, ids: DataFrame, weights: list[float], thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """weight, threshold, f: the macro F of exclusive decoding after a blend of p with the column other, for each weight and threshold."""
    spark = pairs.sparkSession
    w = spark.createDataFrame([(float(x),) for x in weights], "weight double")  # lists of parameters, these two
    x = pairs.select("s1", "m", "p", other).crossJoin(F.broadcast(w)).withColumn("p", F.round(blend(F.col("p"), F.col(other), F.col("weight")), 6))
    x = x.join(x.groupBy("weight", "m").agg(F.max("p").alias("_p")), ["weight", "m"]).where("p = _p").select("weight", "s1", "m", "p")
    out = None
    for t in thresholds:
        got = x.where(F.col("p") >= t).join(truth.select("s1", "m").distinct().withColumn("y", F.lit(1)), ["s1", "m"], "left")
        got = got.groupBy("weight", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
        one = _mean_f(ids.select("s1").distinct().crossJoin(F.broadcast(w)), got, truth, ["weight"], beta).withColumn("threshold", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def _f(beta: float) -> Column:
    b2 = beta * beta
    return F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + b2) * F.col("tp") / (b2 * F.col("n_true") + F.col("n_pred")))


def _mean_f(cells: DataFrame, got: DataFrame, truth: DataFrame, by: list[str], beta: float = 0.5) -> DataFrame:
    """by, f and f_single (of rows without matches), over cells (s1, by)."""
    n_true = truth.select("s1", "m").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    full = cells.join(n_true, "s1", "left").join(got, ["s1", *[c for c in by if c in got.columns]], "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return full.groupBy(*by).agg(F.avg(_f(beta)).alias("f"), F.avg(F.when(F.col("n_true") == 0, _f(beta))).alias("f_single"))


def tuned_gate(pairs: DataFrame, strict: float, thresholds: list[float], truth: DataFrame, ids: DataFrame, gain: float, beta: float = 0.5) -> DataFrame:
    """tuned_on, threshold, gain, passed: for each of two folds of s1 the threshold that serves it best for adds to the strict result,
    what it gains on the other fold, and whether that is gain or more without harm to rows that have no match."""
    spark = pairs.sparkSession
    none = 2.0  # above every p: the strict result itself
    t = spark.createDataFrame([(float(x),) for x in [*thresholds, none]], "threshold double")  # a list of parameters
    y = truth.select("s1", "m").distinct().withColumn("y", F.lit(1))
    got = exclusive(pairs.select("s1", "m", "p")).join(y, ["s1", "m"], "left").crossJoin(F.broadcast(t)).where((F.col("p") >= strict) | (F.col("p") >= F.col("threshold")))
    got = got.groupBy("s1", "threshold").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
    cells = ids.select("s1").distinct().withColumn("fold", bucket(F.col("s1"), "fold", 2)).crossJoin(F.broadcast(t))
    f = _mean_f(cells, got, truth, ["fold", "threshold"], beta).withColumn("f", F.round("f", 9)).withColumn("f_single", F.round("f_single", 9))
    base = f.where(F.col("threshold") == none).select(F.col("fold").alias("on"), F.col("f").alias("bf"), F.col("f_single").alias("bs"))
    best = f.where(F.col("threshold") < none).groupBy("fold").agg(F.max_by("threshold", F.struct("f", "threshold")).alias("threshold"))
    check = f.select(F.col("fold").alias("on"), "threshold", F.col("f").alias("cf"), F.col("f_single").alias("cs"))
    x = best.withColumn("on", 1 - F.col("fold")).join(check, ["on", "threshold"]).join(base, "on")
    better = F.col("cf") - F.col("bf")
    return x.select(F.col("fold").alias("tuned_on"), "threshold", F.round(better, 6).alias("gain"), ((better >= gain) & (F.coalesce("cs", F.lit(0.0)) >= F.coalesce("bs", F.lit(0.0)))).alias("passed"))


def breaches(pairs: DataFrame, pred: DataFrame, strict: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """what, n: how often a result breaks what must hold of it."""
    from samewise.sources.files import id_lists

    twice = lambda df: df.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    lists = id_lists(ids, pred)
    items = lists.where("matched_entity_ids <> ''").select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("m"))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    rows = ids.agg(F.countDistinct("s1").alias("a")).crossJoin(lists.agg(F.count(F.lit(1)).alias("b"))).select(F.lit("rows without a list or with two").alias("what"), (F.col("a") - F.col("b")).alias("n"))  # one row each
    out = count(twice(strict), "two rows of a record, strict").unionByName(count(twice(pred), "two rows of a record"))
    out = out.unionByName(count(pred.join(candidates.select("s1", "m"), ["s1", "m"], "left_anti"), "no candidate")).unionByName(rows)
    return out.unionByName(count(items.groupBy("source1_entity_id", "m").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "ids twice in a list"))


def first_match(pairs: DataFrame, pred: DataFrame, floors: dict[str, float], partition: str = "country") -> DataFrame:
    """(s1, m): for each s1 without a match, its best record that no one has claimed and whose best s1 it is, where p reaches the floor
    of its partition. One record for an s1, one s1 for a record; labels without a floor give none."""
    t = F.lit(1.1)
    for label, x in floors.items():
        t = F.when(F.col(partition) == label, F.lit(x)).otherwise(t)
    ex = exclusive(pairs, strict=True).join(pred.select("s1").distinct(), "s1", "left_anti").join(pred.select("m").distinct(), "m", "left_anti")
    one = ex.groupBy("s1").agg(F.max_by(F.struct("m", "p", partition), F.struct(F.col("p"), _reverse(F.col("m")))).alias("x")).select("s1", "x.*")
    return one.where(F.col("p") >= t).select("s1", "m")


def _reverse(c: Column) -> Column:
    """Sorts strings of digits and letters the other way round: of equal scores the smallest id wins a maximum."""
    return F.translate(c, "0123456789", "9876543210")


def merge_routes(pred: DataFrame, routes: list[DataFrame]) -> DataFrame:
    """(s1, m) of the routes that pred hasn't claimed; of one record proposed twice the earlier route's, then the smallest s1."""
    every = None
    for i, r in enumerate(routes):
        x = r.select("s1", "m").withColumn("_pri", F.lit(i))
        every = x if every is None else every.unionByName(x)
    one = every.groupBy("m").agg(F.min(F.struct("_pri", "s1")).alias("x")).select(F.col("x.s1").alias("s1"), "m")
    return one.join(pred.select("m").distinct(), "m", "left_anti").select("s1", "m")


def best_per_record(pairs: DataFrame) -> DataFrame:
    """The pair with the highest p of each m; of equal ones the smallest s1."""
    return exclusive(pairs, strict=True)


def bucket(ident: Column, salt: str, n: int) -> Column:
    """A stable bucket (0 … n-1) of an id: the first 32 bits of the md5 of salt and id."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), ident)), 1, 8), 16, 10).cast("long"), F.lit(n))
