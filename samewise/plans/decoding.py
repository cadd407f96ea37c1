"""Queries of windows, decoders, blends and the metric on scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.operators import decode as D
from samewise.operators import windows as W
from samewise.plans.base import EXCL, LABELLED, S1, S23, SCORED, labelled, s1, s23, scored, sql_bucket, train, truth
from samewise.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


# --- competition windows ---------------------------------------------------------------------------------------------------------
@query(f"WITH {SCORED} SELECT s1, m, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m)::BIGINT AS p_rank_q, round(p - max(p) OVER (PARTITION BY s1), 6) AS p_gap_q FROM scored")
def wn_gap_and_rank(spark: SparkSession, d: str) -> DataFrame:
    return W.gap_and_rank(scored(spark, d), "p", "s1", "m", "q").select("s1", "m", "p_rank_q", r("p_gap_q"))


@query(f"""WITH {SCORED}, c AS (SELECT s1, m, p, coalesce(cos, 0) AS cos FROM scored) SELECT s1, m, count(*) OVER (PARTITION BY s1)::BIGINT AS n_cand_q, count(*) OVER (PARTITION BY m)::BIGINT AS n_cand_c,
    row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, m)::BIGINT AS cos_rank_q, row_number() OVER (PARTITION BY m ORDER BY cos DESC, s1)::BIGINT AS cos_rank_c,
    round(cos - max(cos) OVER (PARTITION BY s1), 6) AS cos_gap_q, round(cos - max(cos) OVER (PARTITION BY m), 6) AS cos_gap_c FROM c""")
def wn_context(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).select("s1", "m", F.coalesce("cos", F.lit(0.0)).alias("cos"))
    x = W.with_group(W.with_group(x, "s1", n_cand_q=F.count(F.lit(1))), "m", n_cand_c=F.count(F.lit(1)))
    x = W.gap_and_rank(W.gap_and_rank(x, "cos", "s1", "m", "q"), "cos", "m", "s1", "c")
    return x.select("s1", "m", "n_cand_q", "n_cand_c", "cos_rank_q", "cos_rank_c", r("cos_gap_q"), r("cos_gap_c"))


@query(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS rn FROM scored),
    w AS (SELECT *, max(p) OVER (PARTITION BY m) AS m1, coalesce(max(CASE WHEN rn = 2 THEN p END) OVER (PARTITION BY m), 0) AS m2 FROM n)
    SELECT s1, m, round(CASE WHEN p >= m1 THEN p - m2 ELSE p - m1 END, 6) AS margin FROM w""")
def wn_second_best(spark: SparkSession, d: str) -> DataFrame:
    return W.second_best(scored(spark, d), "p", "m", "margin").select("s1", "m", r("margin"))


@query(f"""WITH {SCORED} SELECT s1, m, round(sum(p) OVER (PARTITION BY s1), 6) AS p1_sum_q, round(sum(p) OVER (PARTITION BY m), 6) AS p1_sum_c,
    count(*) FILTER (WHERE p > 0.5) OVER (PARTITION BY s1)::BIGINT AS p1_n50_q, count(*) FILTER (WHERE p > 0.3) OVER (PARTITION BY m)::BIGINT AS p1_n30_c FROM scored""")
def wn_score_context(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).select("s1", "m", "p")
    x = W.with_group(x, "s1", p1_sum_q=F.sum("p"), p1_n50_q=F.count_if(F.col("p") > 0.5))
    x = W.with_group(x, "m", p1_sum_c=F.sum("p"), p1_n30_c=F.count_if(F.col("p") > 0.3))
    return x.select("s1", "m", r("p1_sum_q"), r("p1_sum_c"), "p1_n50_q", "p1_n30_c")


@query(f"""WITH {SCORED}, c AS (SELECT s1, m, coalesce(cos, 0) AS cos, (coalesce(cos, 0) + least(greatest(p, 0), 1)) / 2 AS mix FROM scored) SELECT s1, m, count(*) FILTER (WHERE cos >= 0.8) OVER (PARTITION BY m)::BIGINT AS twins_c, count(*) FILTER (WHERE cos >= 0.8) OVER (PARTITION BY s1)::BIGINT AS twins_q,
    row_number() OVER (PARTITION BY m ORDER BY round(mix, 9) DESC, s1)::BIGINT AS mix_rank_c FROM c""")
def wn_twins(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of a record and of a row look just like it, and the rank of the mean of both scores."""
    x = scored(spark, d).select("s1", "m", F.coalesce("cos", F.lit(0.0)).alias("cos"), "p").withColumn("mix", F.round((F.col("cos") + F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))) / 2, 9))
    x = W.twins(W.twins(x, "cos", "m", 0.8, "twins_c"), "cos", "s1", 0.8, "twins_q")
    return W.ordered(x, ["m"], [F.desc("mix"), F.asc("s1")], "mix_rank_c").select("s1", "m", "twins_c", "twins_q", "mix_rank_c")


@query(f"""WITH {SCORED} SELECT s1, m, round((rank() OVER (PARTITION BY country ORDER BY p) + (count(*) OVER (PARTITION BY country, p) - 1) / 2.0) / count(*) OVER (PARTITION BY country), 6) AS quantile FROM scored""")
def wn_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return W.average_rank_quantile(scored(spark, d), "p", "country", "quantile").select("s1", "m", r("quantile"))


@query(f"""WITH {SCORED}, k AS (SELECT s1, m, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS k FROM scored)
    SELECT a.s1, a.m, CASE WHEN a.k = 1 THEN c.m ELSE b.m END AS anchor, round(coalesce(CASE WHEN a.k = 1 THEN c.p ELSE b.p END, -1), 6) AS anchor_p
    FROM k a LEFT JOIN k b ON b.s1 = a.s1 AND b.k = 1 LEFT JOIN k c ON c.s1 = a.s1 AND c.k = 2""")
def wn_triangle_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Each pair with its s1's most likely other record."""
    k = W.ordered(scored(spark, d).select("s1", "m", "p"), ["s1"], [F.desc("p"), F.asc("m")], "k")
    b = k.where("k = 1").select("s1", F.col("m").alias("b"), F.col("p").alias("bp"))
    c = k.where("k = 2").select("s1", F.col("m").alias("c"), F.col("p").alias("cp"))
    x = k.join(b, "s1", "left").join(c, "s1", "left")
    first = F.col("k") == 1
    return x.select("s1", "m", F.when(first, F.col("c")).otherwise(F.col("b")).alias("anchor"), F.round(F.coalesce(F.when(first, F.col("cp")).otherwise(F.col("bp")), F.lit(-1.0)), 6).alias("anchor_p"))


@query(f"""WITH {SCORED} SELECT s1, m, row_number() OVER w::BIGINT AS k, round(sum(p) OVER w, 6) AS cum FROM scored WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, m ROWS UNBOUNDED PRECEDING)""")
def wn_running(spark: SparkSession, d: str) -> DataFrame:
    return W.ordered(scored(spark, d).select("s1", "m", "p"), ["s1"], [F.desc("p"), F.asc("m")], "k", {"cum": "p"}).select("s1", "m", "k", r("cum"))


@query(f"WITH {SCORED} SELECT s1, round(exp(sum(ln(greatest(1 - p, 1e-6)))), 6) AS none FROM scored GROUP BY s1")
def wn_product(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("s1").agg(F.round(F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6))))), 6).alias("none"))


# --- decoders --------------------------------------------------------------------------------------------------------------------
@query(f"WITH {SCORED}, {EXCL} SELECT s1, m FROM excl WHERE p >= 0.6")
def dc_decode(spark: SparkSession, d: str) -> DataFrame:
    return D.decode(scored(spark, d), 0.6)


@query(f"WITH {SCORED} SELECT s1, m FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS rn FROM scored) WHERE rn = 1")
def dc_best_per_record(spark: SparkSession, d: str) -> DataFrame:
    return D.best_per_record(scored(spark, d)).select("s1", "m")


@query(f"""WITH {SCORED}, {EXCL}, f AS (SELECT s1, m, sum(p) OVER o AS cum, row_number() OVER o AS k, sum(p) OVER (PARTITION BY s1) AS s,
    exp(sum(ln(greatest(1e-6, least(1.0, 1 - p)))) OVER (PARTITION BY s1)) AS p0 FROM excl WHERE p >= 0.02 WINDOW o AS (PARTITION BY s1 ORDER BY p DESC, m ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, round(1.25 * cum / (k + 0.25 * s), 9) AS e FROM f), x AS (SELECT *, max(e) OVER (PARTITION BY s1) AS em FROM e),
    b AS (SELECT *, min(CASE WHEN e = em THEN k END) OVER (PARTITION BY s1) AS kb FROM x) SELECT s1, m FROM b WHERE k <= kb AND em > p0""")
def dc_expected_f(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_expected_f(scored(spark, d))


@query(f"WITH {SCORED}, {EXCL} SELECT s1, m FROM excl WHERE p >= CASE country WHEN 'India' THEN 0.8 WHEN 'US' THEN 0.7 WHEN 'France' THEN 0.87 ELSE 0.9 END")
def dc_by_partition(spark: SparkSession, d: str) -> DataFrame:
    return D.decode_by_partition(scored(spark, d), {"India": 0.8, "US": 0.7, "France": 0.87})


_BAND = "CASE " + " ".join(f"WHEN p >= {lo} AND p < {hi} THEN {lo}::DOUBLE" for lo, hi in zip(D.BAND_EDGES[:-1], D.BAND_EDGES[1:])) + " END"


@query(f"""WITH {LABELLED}, va AS (SELECT *, {_BAND} AS band FROM scored WHERE {sql_bucket('s1', 'val', 2)} = 0 AND country <> 'France'), te AS (SELECT *, {_BAND} AS band FROM scored WHERE {sql_bucket('s1', 'val', 2)} = 1),
    nv AS (SELECT country, count(DISTINCT s1) AS n FROM va GROUP BY country), nt AS (SELECT country, count(DISTINCT s1) AS n FROM te GROUP BY country),
    vt AS (SELECT v.country, band, sum(y)::DOUBLE / any_value(n) AS tp FROM va v JOIN nv USING (country) WHERE p >= 0.5 GROUP BY v.country, band), av AS (SELECT band, avg(tp) AS tpa FROM vt GROUP BY band),
    tt AS (SELECT t.country, band, count(*)::DOUBLE / any_value(n) AS per FROM te t JOIN nt USING (country) WHERE p >= 0.5 GROUP BY t.country, band),
    est AS (SELECT tt.country, tt.band, round(least(1.0, greatest(0.0, coalesce(vt.tp, av.tpa) / tt.per)), 9) AS prec FROM tt LEFT JOIN vt ON vt.country = tt.country AND vt.band = tt.band JOIN av ON av.band = tt.band),
    ok AS (SELECT *, min(CASE WHEN prec >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY country ORDER BY band DESC ROWS UNBOUNDED PRECEDING) AS ok FROM est)
    SELECT country, coalesce(min(CASE WHEN ok = 1 THEN band END), 0.99)::DOUBLE AS threshold FROM ok GROUP BY country""")
def dc_prior_thresholds(spark: SparkSession, d: str) -> DataFrame:
    x = labelled(spark, d).withColumn("half", D.bucket(F.col("s1"), "val", 2))
    return D.prior_thresholds(x.where("half = 0 and country <> 'France'"), x.where("half = 1"), 0.3)


_F = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END"


@query(f"""WITH {LABELLED}, {EXCL}, pred AS (SELECT DISTINCT s1, m FROM excl WHERE p >= 0.6), tr AS (SELECT s1, m FROM truth),
    j AS (SELECT coalesce(a.s1, b.s1) AS s1, CASE WHEN a.m IS NOT NULL THEN 1 ELSE 0 END AS ip, CASE WHEN b.m IS NOT NULL THEN 1 ELSE 0 END AS it FROM pred a FULL JOIN tr b ON a.s1 = b.s1 AND a.m = b.m),
    g AS (SELECT s1, sum(ip) AS n_pred, sum(it) AS n_true, sum(ip * it) AS tp FROM j GROUP BY s1),
    f AS (SELECT t.country, {_F} AS f, n_true FROM (SELECT t.entity_id, t.country, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM s1t t LEFT JOIN g ON g.s1 = t.entity_id) t)
    SELECT country, round(avg(f), 6) AS f, round(avg(CASE WHEN n_true = 0 THEN f END), 6) AS f_single, round(avg(CASE WHEN n_true > 0 THEN f END), 6) AS f_matched, count(*)::BIGINT AS n FROM f GROUP BY country""")
def dc_macro_f(spark: SparkSession, d: str) -> DataFrame:
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"), "country")
    f = D.macro_fbeta(D.decode(labelled(spark, d), 0.6), truth(spark, d), ids).join(ids, "s1")
    return f.groupBy("country").agg(F.round(F.avg("f"), 6).alias("f"), F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f"))), 6).alias("f_single"), F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 6).alias("f_matched"), F.count(F.lit(1)).alias("n"))


_GRID = ", ".join(f"({t})" for t in (0.3, 0.5, 0.7, 0.9))


@query(f"""WITH {LABELLED}, {EXCL}, g AS (SELECT t::DOUBLE AS threshold FROM (VALUES {_GRID}) v(t)), x AS (SELECT s1, m, p, y, TRUE AS excl FROM excl UNION ALL SELECT s1, m, p, y, FALSE AS excl FROM scored),
    got AS (SELECT excl, threshold, s1, count(*) AS n_pred, sum(y) AS tp FROM x JOIN g ON p >= threshold GROUP BY ALL), nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1),
    a AS (SELECT e.excl, g.threshold, t.entity_id AS s1, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1t t CROSS JOIN g CROSS JOIN (VALUES (TRUE), (FALSE)) e(excl)
    LEFT JOIN nt ON nt.s1 = t.entity_id LEFT JOIN got ON got.s1 = t.entity_id AND got.threshold = g.threshold AND got.excl = e.excl) SELECT excl, threshold, round(avg({_F}), 6) AS f FROM a GROUP BY excl, threshold""")
def dc_grid(spark: SparkSession, d: str) -> DataFrame:
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"))
    return D.grid(labelled(spark, d), truth(spark, d), ids, [0.3, 0.5, 0.7, 0.9]).select("excl", "threshold", r("f"))


_LG = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"


@query(f"WITH {SCORED} SELECT s1, m, round(CASE WHEN cos IS NULL THEN p ELSE 1 / (1 + exp(-(0.6 * {_LG.format('p')} + 0.4 * {_LG.format('cos')}))) END, 6) AS p FROM scored")
def dc_blend(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("s1", "m", F.round(D.blend(F.col("p"), F.col("cos"), 0.6), 6).alias("p"))


@query(f"""WITH {SCORED}, e AS (SELECT s1, m, 1.0 * {_LG.format('p')} AS l, 1.0 AS w FROM scored UNION ALL SELECT s1, m, 2.0 * {_LG.format('cos')} AS l, 2.0 AS w FROM scored WHERE cos IS NOT NULL)
    SELECT s1, m, round(1 / (1 + exp(-(sum(l) / sum(w)))), 6) AS p FROM e GROUP BY s1, m""")
def dc_ensemble(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return D.ensemble([(x, 1.0), (x.where("cos is not null").select("s1", "m", F.col("cos").alias("p")), 2.0)]).select("s1", "m", r("p"))


@query(f"WITH {SCORED} SELECT s1, m, round(CASE WHEN cos IS NULL THEN p ELSE (p + cos) / 2 END, 8) AS p FROM scored")
def dc_mean_runs(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return D.mean_runs([x, x.where("cos is not null").select("s1", "m", F.col("cos").alias("p"))]).select("s1", "m", r("p", 8))


@query(f"WITH {SCORED} SELECT s1, m, round(CASE WHEN country = 'France' THEN coalesce(cos, 0) ELSE p END, 6) AS p FROM scored")
def dc_override(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).select("s1", "m", "p", "country", "cos")
    return D.override(x, x.withColumn("p", F.coalesce("cos", F.lit(0.0))), "country", ["France"]).select("s1", "m", r("p"))


@query(f"""WITH {SCORED}, {EXCL}, pred AS (SELECT s1, m FROM excl WHERE p >= 0.9), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY s1) AS i FROM excl) WHERE i = 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, translate(m, '0123456789', '9876543210') DESC) AS k FROM b WHERE s1 NOT IN (SELECT s1 FROM pred) AND m NOT IN (SELECT m FROM pred))
    SELECT s1, m FROM x WHERE k = 1 AND p >= CASE country WHEN 'India' THEN 0.5 WHEN 'US' THEN 0.6 ELSE 1.1 END""")
def dc_first_match(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return D.first_match(x, D.decode(x, 0.9), {"India": 0.5, "US": 0.6})


@query(f"""WITH {SCORED}, {EXCL}, pred AS (SELECT s1, m FROM excl WHERE p >= 0.9), ro AS (SELECT s1, m, 0 AS pri FROM scored WHERE p >= 0.85 UNION ALL SELECT s1, m, 1 AS pri FROM scored WHERE cos >= 0.8)
    SELECT s1, m FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY pri, s1) AS k FROM ro) WHERE k = 1 AND m NOT IN (SELECT m FROM pred)""")
def dc_merge_routes(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return D.merge_routes(D.decode(x, 0.9), [x.where("p >= 0.85"), x.where("cos >= 0.8")])


@query(f"WITH {SCORED} SELECT {sql_bucket('s1', 'fold', 2)}::BIGINT AS fold, count(DISTINCT s1)::BIGINT AS n, round(avg(p), 6) AS p FROM scored GROUP BY 1")
def dc_folds(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("fold", D.bucket(F.col("s1"), "fold", 2)).groupBy("fold").agg(F.countDistinct("s1").alias("n"), F.round(F.avg("p"), 6).alias("p"))


@query(f"""WITH {LABELLED}, {EXCL}, cand AS (SELECT s1, m, p, y, {sql_bucket('s1', 'fold', 2)} AS fold FROM excl WHERE p < 0.9), t AS (SELECT v::DOUBLE AS threshold FROM (VALUES (0.4), (0.6), (0.8)) x(v))
    SELECT fold::BIGINT AS fold, threshold, count(*)::BIGINT AS adds, round(avg(y), 6) AS precision FROM cand JOIN t ON p >= threshold GROUP BY fold, threshold""")
def dc_gate(spark: SparkSession, d: str) -> DataFrame:
    """What adds above each threshold would gain, on each fold: a threshold chosen on one is checked on the other."""
    x = D.exclusive(labelled(spark, d)).where("p < 0.9").withColumn("fold", D.bucket(F.col("s1"), "fold", 2))
    t = spark.createDataFrame([(0.4,), (0.6,), (0.8,)], "threshold double")
    return x.crossJoin(F.broadcast(t)).where("p >= threshold").groupBy("fold", "threshold").agg(F.count(F.lit(1)).alias("adds"), F.round(F.avg("y"), 6).alias("precision"))


@query(f"""WITH {SCORED}, {EXCL}, st AS (SELECT s1, m FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS k FROM scored) WHERE k = 1 AND p >= 0.6), li AS (SELECT t.entity_id AS s1, coalesce(string_agg(DISTINCT e.m, ',' ORDER BY e.m), '') AS l FROM s1t t LEFT JOIN (SELECT * FROM excl WHERE p >= 0.6) e ON e.s1 = t.entity_id GROUP BY 1)
    SELECT 'two rows of a record, strict' AS what, (SELECT count(*) FROM (SELECT m FROM st GROUP BY m HAVING count(*) > 1))::BIGINT AS n UNION ALL SELECT 'two rows of a record' AS what, (SELECT count(*) FROM (SELECT m FROM excl WHERE p >= 0.6 GROUP BY m HAVING count(*) > 1))::BIGINT AS n
    UNION ALL SELECT 'no candidate' AS what, (SELECT count(*) FROM excl e WHERE p >= 0.6 AND NOT EXISTS (SELECT 1 FROM candidate_pairs c WHERE c.s1 = e.s1 AND c.m = e.m))::BIGINT AS n UNION ALL SELECT 'rows without a list or with two' AS what, (SELECT count(DISTINCT entity_id) FROM s1t)::BIGINT - (SELECT count(*) FROM li)::BIGINT AS n
    UNION ALL SELECT 'ids twice in a list' AS what, (SELECT count(*) FROM (SELECT s1, unnest(string_split(l, ',')) AS m FROM li WHERE l <> '') GROUP BY s1, m HAVING count(*) > 1)::BIGINT AS n""".replace("(SELECT count(*) FROM (SELECT s1, unnest(string_split(l, ',')) AS m FROM li WHERE l <> '') GROUP BY s1, m HAVING count(*) > 1)::BIGINT", "(SELECT count(*) FROM (SELECT s1, m FROM (SELECT s1, unnest(string_split(l, ',')) AS m FROM li WHERE l <> '') GROUP BY s1, m HAVING count(*) > 1))::BIGINT"))
def dc_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of what must hold of a result: records on two rows (also before ties are broken), matches that are no candidates, rows
    without exactly one list, ids twice in a list."""
    x = scored(spark, d)
    ids = s1(spark, d).select(F.col("entity_id").alias("s1"))
    return D.breaches(x, D.decode(x, 0.6), D.best_per_record(x).where("p >= 0.6"), table(spark, d, "candidate_pairs"), ids)


@query(f"WITH {LABELLED}, {EXCL}, pred AS (SELECT DISTINCT s1, m FROM truth WHERE EXISTS (SELECT 1 FROM scored s WHERE s.s1 = truth.s1 AND s.m = truth.m)), tr AS (SELECT s1, m FROM truth), " + ORACLES["dc_macro_f"][ORACLES["dc_macro_f"].index("j AS (SELECT coalesce(a.s1, b.s1)") :])
def dc_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The macro F that these candidates allow: all known matches among them, nothing else."""
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"), "country")
    t = truth(spark, d)
    f = D.macro_fbeta(t.join(labelled(spark, d).select("s1", "m"), ["s1", "m"], "left_semi"), t, ids.select("s1")).join(ids, "s1")
    return f.groupBy("country").agg(F.round(F.avg("f"), 6).alias("f"), F.round(F.avg(F.when(F.col("n_true") == 0, F.col("f"))), 6).alias("f_single"), F.round(F.avg(F.when(F.col("n_true") > 0, F.col("f"))), 6).alias("f_matched"), F.count(F.lit(1)).alias("n"))


_GOT = "nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1)"


@query(f"""WITH {LABELLED}, wt AS (SELECT w::DOUBLE AS weight FROM (VALUES (0.3), (0.5), (0.7)) v(w)), g AS (SELECT t::DOUBLE AS threshold FROM (VALUES (0.4), (0.6), (0.8)) v(t)), bl AS (SELECT s1, m, y, weight, round(CASE WHEN cos IS NULL THEN p ELSE 1 / (1 + exp(-(weight * {_LG.format('p')} + (1 - weight) * {_LG.format('cos')}))) END, 6) AS p FROM scored CROSS JOIN wt),
    ex AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY weight, m) AS pm FROM bl) WHERE p = pm), got AS (SELECT weight, threshold, s1, count(*) AS n_pred, sum(y) AS tp FROM ex JOIN g ON p >= threshold GROUP BY ALL), {_GOT},
    a AS (SELECT weight, threshold, t.entity_id AS s1, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1t t CROSS JOIN wt CROSS JOIN g LEFT JOIN nt ON nt.s1 = t.entity_id LEFT JOIN got USING (weight, threshold, s1)) SELECT weight, threshold, round(avg({_F}), 6) AS f FROM a GROUP BY weight, threshold""".replace("LEFT JOIN got USING (weight, threshold, s1)", "LEFT JOIN got ON got.weight = wt.weight AND got.threshold = g.threshold AND got.s1 = t.entity_id").replace("a AS (SELECT weight, threshold, t.entity_id", "a AS (SELECT wt.weight, g.threshold, t.entity_id"))
def dc_blend_search(spark: SparkSession, d: str) -> DataFrame:
    """The macro F of each weight of a blend and each threshold."""
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"))
    return D.blend_search(labelled(spark, d), "cos", truth(spark, d), ids, [0.3, 0.5, 0.7], [0.4, 0.6, 0.8]).select("weight", "threshold", r("f"))


@query(f"""WITH {LABELLED}, {EXCL}, f AS (SELECT s1, m, y, sum(p) OVER o AS cum, row_number() OVER o AS k, sum(p) OVER (PARTITION BY s1) AS s,
    exp(sum(ln(greatest(1e-6, least(1.0, 1 - p)))) OVER (PARTITION BY s1)) AS p0 FROM excl WHERE p >= 0.02 WINDOW o AS (PARTITION BY s1 ORDER BY p DESC, m ROWS UNBOUNDED PRECEDING)), e AS (SELECT *, round(1.25 * cum / (k + 0.25 * s), 9) AS e FROM f), x AS (SELECT *, max(e) OVER (PARTITION BY s1) AS em FROM e),
    b AS (SELECT *, min(CASE WHEN e = em THEN k END) OVER (PARTITION BY s1) AS kb FROM x), got AS (SELECT s1, count(*) AS n_pred, sum(y) AS tp FROM b WHERE k <= kb AND em > p0 GROUP BY s1), {_GOT},
    a AS (SELECT t.entity_id AS s1, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1t t LEFT JOIN nt ON nt.s1 = t.entity_id LEFT JOIN got ON got.s1 = t.entity_id) SELECT round(avg({_F}), 6) AS f FROM a""")
def dc_grid_expected(spark: SparkSession, d: str) -> DataFrame:
    """The macro F of the decoder by expected F, which has no threshold, beside dc_grid."""
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"))
    return D.macro_fbeta(D.decode_expected_f(labelled(spark, d)), truth(spark, d), ids).agg(F.round(F.avg("f"), 6).alias("f"))


_TUNE = f"{sql_bucket('t.entity_id', 'fold', 2)}"


@query(f"""WITH {LABELLED}, {EXCL}, g AS (SELECT t::DOUBLE AS threshold FROM (VALUES (0.5), (0.6), (0.7), (0.8), (2.0)) v(t)), got AS (SELECT threshold, s1, count(*) AS n_pred, sum(y) AS tp FROM excl JOIN g ON p >= 0.8 OR p >= threshold GROUP BY ALL), {_GOT},
    a AS (SELECT g.threshold, {_TUNE}::BIGINT AS fold, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM s1t t CROSS JOIN g LEFT JOIN nt ON nt.s1 = t.entity_id LEFT JOIN got ON got.s1 = t.entity_id AND got.threshold = g.threshold),
    f AS (SELECT fold, threshold, round(avg({_F}), 9) AS f, round(avg(CASE WHEN n_true = 0 THEN {_F} END), 9) AS fs FROM a GROUP BY fold, threshold), b AS (SELECT * FROM f WHERE threshold = 2.0), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, threshold DESC) AS k FROM f WHERE threshold < 2.0) WHERE k = 1)
    SELECT t.fold AS tuned_on, t.threshold, round(c.f - b.f, 6) AS gain, c.f - b.f >= 0.001 AND coalesce(c.fs, 0) >= coalesce(b.fs, 0) AS passed FROM best t JOIN f c ON c.fold = 1 - t.fold AND c.threshold = t.threshold JOIN b ON b.fold = c.fold""")
def dc_tuned_gate(spark: SparkSession, d: str) -> DataFrame:
    """A threshold for adds to a strict result, tuned on one fold and gated on the other: it must gain and not harm rows without matches."""
    x = labelled(spark, d)
    ids = train(spark, d)[0].select(F.col("entity_id").alias("s1"))
    return D.tuned_gate(x, 0.8, [0.5, 0.6, 0.7, 0.8], truth(spark, d), ids, 0.001)


@query(f"""WITH {SCORED}, {EXCL}, ad AS (SELECT s1, m FROM excl WHERE p >= 0.3 AND p < 0.9), nm AS (SELECT entity_id AS s1, country, regexp_replace(lower(business_name), '[^a-z0-9]', '', 'g') AS ck FROM s1t), tied AS (SELECT country, ck FROM nm WHERE ck <> '' GROUP BY country, ck HAVING count(*) >= 2),
    bare AS (SELECT entity_id AS m FROM ({S23.removeprefix('s23 AS (').removesuffix(')')}) GROUP BY entity_id HAVING min(business_address) = '')
    SELECT s1, m FROM ad WHERE NOT (m IN (SELECT m FROM bare) AND s1 IN (SELECT s1 FROM nm JOIN tied USING (country, ck)))""")
def dc_tie_skip(spark: SparkSession, d: str) -> DataFrame:
    """Adds but for those of records without an address where several clean rows have the name."""
    from samewise.operators.rules import without_ties

    adds = D.exclusive(scored(spark, d)).where("p >= 0.3 and p < 0.9").select("s1", "m")
    a = s1(spark, d).select(F.col("entity_id").alias("id"), "country", F.lower("business_name").alias("n"))
    b = s23(spark, d).groupBy("entity_id").agg(F.min("business_address").alias("a")).select(F.col("entity_id").alias("id"), "a")
    return without_ties(adds, a, b)


@query(f"""WITH {LABELLED}, r AS (SELECT s1, m, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS r0, CASE WHEN cos IS NOT NULL THEN row_number() OVER (PARTITION BY s1 ORDER BY coalesce(cos, -1) DESC, m) END AS r1, CASE WHEN cos IS NULL THEN row_number() OVER (PARTITION BY s1, cos IS NULL ORDER BY p DESC, m) END AS r2 FROM scored),
    x AS (SELECT k, coalesce(r0 <= k, FALSE) AS h0, coalesce(r1 <= k, FALSE) AS h1, coalesce(r2 <= k, FALSE) AS h2 FROM truth LEFT JOIN r USING (s1, m) CROSS JOIN (VALUES (1), (5), (10), (30)) c(k))
    SELECT 'both' AS route, k::BIGINT AS k, round(avg(h0::INT), 6) AS recall, round(avg(h0::INT), 6) AS union_recall FROM x GROUP BY k UNION ALL SELECT 'address' AS route, k::BIGINT AS k, round(avg(h1::INT), 6) AS recall, round(avg((h0 OR h1)::INT), 6) AS union_recall FROM x GROUP BY k
    UNION ALL SELECT 'name only' AS route, k::BIGINT AS k, round(avg(h2::INT), 6) AS recall, round(avg((h0 OR h1 OR h2)::INT), 6) AS union_recall FROM x GROUP BY k""")
def bl_recall(spark: SparkSession, d: str) -> DataFrame:
    """The share of the known matches that each route has among its k best, and with the routes before it."""
    from samewise.operators.retrieval import recall_report

    x = labelled(spark, d).select("s1", "m", "p", "cos")
    rank = lambda df, c: W.ordered(df, ["s1"], [F.desc(c), F.asc("m")], "rank").select("s1", "m", "rank")
    routes = [("both", rank(x, "p")), ("address", rank(x.withColumn("cos", F.coalesce("cos", F.lit(-1.0))), "cos").join(x.where("cos is not null").select("s1", "m"), ["s1", "m"], "left_semi")), ("name only", rank(x.where("cos is null"), "p"))]
    return recall_report(routes, truth(spark, d), [1, 5, 10, 30]).select("route", "k", r("recall"), r("union_recall"))


# --- candidate unions ------------------------------------------------------------------------------------------------------------
_ROUTES = "ra AS (SELECT s1, m, max(p) AS tok_score FROM candidate_pairs WHERE route = (SELECT min(route) FROM candidate_pairs) AND NOT isnan(p) GROUP BY s1, m), rb AS (SELECT s1, m, max(cos::DOUBLE) AS dense_score FROM candidate_pairs WHERE route <> (SELECT min(route) FROM candidate_pairs) AND cos IS NOT NULL GROUP BY s1, m)"


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "candidate_pairs")
    least = p.agg(F.min("route").alias("least"))
    p = p.crossJoin(F.broadcast(least))  # one row
    a = p.where("route = least and p is not null and not isnan(p)").groupBy("s1", "m").agg(F.max("p").alias("tok_score"))
    b = p.where("route <> least and cos is not null").groupBy("s1", "m").agg(F.max(F.col("cos").cast("double")).alias("dense_score"))
    return a, b


@query(f"WITH {_ROUTES} SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.m, b.m) AS m, round(tok_score, 6) AS tok_score, round(dense_score, 6) AS dense_score FROM ra a FULL JOIN rb b ON a.s1 = b.s1 AND a.m = b.m")
def bl_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _routes(spark, d)
    return a.join(b, ["s1", "m"], "full").select("s1", "m", r("tok_score"), r("dense_score"))


@query(f"""WITH {_ROUTES}, a AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY tok_score DESC, m) AS tok_rank FROM ra), b AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY dense_score DESC, m) AS dense_rank FROM rb)
    SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.m, b.m) AS m, round(coalesce(tok_score, 0), 6) AS tok_score, coalesce(tok_rank, 999)::BIGINT AS tok_rank, round(coalesce(dense_score, 0), 6) AS dense_score, coalesce(dense_rank, 999)::BIGINT AS dense_rank
    FROM a FULL JOIN b ON a.s1 = b.s1 AND a.m = b.m WHERE coalesce(tok_rank <= 5, FALSE) OR coalesce(dense_rank <= 3, FALSE)""")
def cd_union_caps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that some route ranks within its cap; a missed route's score is 0, its rank 999."""
    a, b = _routes(spark, d)
    a = W.ordered(a, ["s1"], [F.desc("tok_score"), F.asc("m")], "tok_rank")
    b = W.ordered(b, ["s1"], [F.desc("dense_score"), F.asc("m")], "dense_rank")
    x = a.join(b, ["s1", "m"], "full").where(F.coalesce(F.col("tok_rank") <= 5, F.lit(False)) | F.coalesce(F.col("dense_rank") <= 3, F.lit(False)))
    return x.na.fill({"tok_score": 0.0, "dense_score": 0.0, "tok_rank": 999, "dense_rank": 999}).select("s1", "m", r("tok_score"), "tok_rank", r("dense_score"), "dense_rank")


@query(f"WITH {SCORED} SELECT s1, m, round(p, 6) AS p FROM scored WHERE {sql_bucket('s1', 'drop', 100)} >= 15")
def cd_drop_rows(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    gone = x.select("s1").distinct().where(D.bucket(F.col("s1"), "drop", 100) < 15)
    return x.join(gone, "s1", "left_anti").select("s1", "m", r("p"))


@query(f"WITH {SCORED}, k AS (SELECT s1, m, p, count(*) OVER (PARTITION BY m)::BIGINT AS n_cand_c, round(p - max(p) OVER (PARTITION BY m), 6) AS p_gap_c FROM scored) SELECT s1, m, n_cand_c, p_gap_c FROM k WHERE {sql_bucket('s1', 'drop', 100)} >= 15")
def cd_context_then_rows(spark: SparkSession, d: str) -> DataFrame:
    """The context of a record's candidates over all rows, and only then the rows that are kept."""
    x = W.with_group(scored(spark, d).select("s1", "m", "p"), "m", n_cand_c=F.count(F.lit(1)), _best=F.max("p"))
    keep = x.select("s1").distinct().where(D.bucket(F.col("s1"), "drop", 100) >= 15)
    return x.join(keep, "s1", "left_semi").select("s1", "m", "n_cand_c", F.round(F.col("p") - F.col("_best"), 6).alias("p_gap_c"))


@query(f"WITH {LABELLED} SELECT s1, m, round(p, 6) AS p, FALSE AS copied FROM scored UNION ALL SELECT s1, 'copy of ' || m AS m, round(p, 6) AS p, TRUE AS copied FROM scored WHERE p >= 0.5 AND m NOT IN (SELECT m FROM truth)")
def cd_decoys(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with copies of records that belong to no row but lie near one, as further wrong candidates of it."""
    x = labelled(spark, d).select("s1", "m", "p")
    free = x.where("p >= 0.5").join(truth(spark, d).select("m").distinct(), "m", "left_anti")
    return x.withColumn("copied", F.lit(False)).unionByName(free.select("s1", F.concat(F.lit("copy of "), "m").alias("m"), "p", F.lit(True).alias("copied"))).select("s1", "m", r("p"), "copied")


@query(f"WITH {SCORED} SELECT s1, m, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS k FROM scored) WHERE k <= 3 AND p >= 0.05")
def cd_stage_filter(spark: SparkSession, d: str) -> DataFrame:
    return W.ordered(scored(spark, d), ["s1"], [F.desc("p"), F.asc("m")], "k").where("k <= 3 and p >= 0.05").select("s1", "m", r("p"))


@query(f"WITH {SCORED} SELECT s1, m, round(p, 6) AS p FROM scored WHERE p >= 0.02 AND p < 0.998")
def cd_uncertain(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("p >= 0.02 and p < 0.998").select("s1", "m", r("p"))


@query(f"""WITH {LABELLED}, k AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS k FROM scored), h AS (SELECT s1, m, y, (y = 1 OR k <= 2) AS hard FROM k)
    SELECT s1, m, y::INTEGER AS y, CASE WHEN hard THEN 1.0 ELSE 5.0 END::DOUBLE AS w FROM h WHERE hard OR {sql_bucket('s1 || m', 'neg', 5)} = 0""")
def cd_negatives(spark: SparkSession, d: str) -> DataFrame:
    """All hard rows, a fifth of the easy negatives with five times the weight."""
    k = W.ordered(labelled(spark, d), ["s1"], [F.desc("p"), F.asc("m")], "k").withColumn("hard", (F.col("y") == 1) | (F.col("k") <= 2))
    k = k.where(F.col("hard") | (D.bucket(F.concat("s1", "m"), "neg", 5) == 0))
    return k.select("s1", "m", "y", F.when(F.col("hard"), 1.0).otherwise(5.0).alias("w"))


# --- joins, aggregates, sets -----------------------------------------------------------------------------------------------------
@query(f"WITH {SCORED}, {S23} SELECT a.s1, a.m, b.src FROM scored a JOIN s23 b ON b.entity_id = a.m WHERE b.src = 2")
def jn_inner(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).join(s23(spark, d).withColumnRenamed("entity_id", "m"), "m").where("src = 2").select("s1", "m", "src")


@query(f"WITH {SCORED} SELECT t.entity_id AS s1, count(c.m)::BIGINT AS n FROM s1t t LEFT JOIN scored c ON c.s1 = t.entity_id GROUP BY 1")
def jn_left(spark: SparkSession, d: str) -> DataFrame:
    n = scored(spark, d).groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    return s1(spark, d).select(F.col("entity_id").alias("s1")).join(n, "s1", "left").na.fill(0, ["n"])


@query(f"WITH {SCORED} SELECT entity_id AS s1 FROM s1t WHERE entity_id NOT IN (SELECT s1 FROM scored)")
def jn_anti(spark: SparkSession, d: str) -> DataFrame:
    return s1(spark, d).select(F.col("entity_id").alias("s1")).join(scored(spark, d).select("s1"), "s1", "left_anti")


@query(f"WITH {SCORED} SELECT entity_id AS s1 FROM s1t WHERE entity_id IN (SELECT s1 FROM scored WHERE p >= 0.9)")
def jn_semi(spark: SparkSession, d: str) -> DataFrame:
    return s1(spark, d).select(F.col("entity_id").alias("s1")).join(scored(spark, d).where("p >= 0.9").select("s1"), "s1", "left_semi")


@query(f"""WITH {SCORED}, n AS (SELECT entity_id, country, regexp_replace(lower(business_name), '[^a-z0-9]', '', 'g') AS c FROM s1t), l AS (SELECT *, lead(entity_id, 1) OVER w AS e1, lead(entity_id, 2) OVER w AS e2 FROM n WHERE length(c) >= 3 WINDOW w AS (PARTITION BY country ORDER BY c, entity_id))
    SELECT entity_id AS a, e1 AS b, 1 AS step FROM l WHERE e1 IS NOT NULL UNION ALL SELECT entity_id AS a, e2 AS b, 2 AS step FROM l WHERE e2 IS NOT NULL""")
def jn_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the next two in the order of compact names of its country: a self-join by place, through skew-safe row numbers."""
    n = s1(spark, d).withColumn("c", F.regexp_replace(F.lower("business_name"), "[^a-z0-9]", "")).where(F.length("c") >= 3).select("entity_id", "country", "c")
    k = W.ordered(n, ["country"], [F.asc("c"), F.asc("entity_id")], "k").select("entity_id", "country", "k")
    a = k.select(F.col("entity_id").alias("a"), "country", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"), "k").withColumn("k", F.col("k") + F.col("step"))
    return a.join(k.withColumnRenamed("entity_id", "b"), ["country", "k"]).select("a", "b", "step")


@query(f"WITH {SCORED} SELECT country, count(*)::BIGINT AS n, count(DISTINCT s1)::BIGINT AS n_s1, round(sum(p), 6) AS p_sum, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, round(avg(cos), 6) AS cos FROM scored GROUP BY country")
def ag_basic(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s1").alias("n_s1"), F.round(F.sum("p"), 6).alias("p_sum"), F.round(F.min("p"), 6).alias("p_min"), F.round(F.max("p"), 6).alias("p_max"), F.round(F.avg("cos"), 6).alias("cos"))


@query(f"WITH {SCORED} SELECT m, arg_max(s1, struct_pack(p := p, t := translate(s1, '0123456789', '9876543210'))) AS s1 FROM scored GROUP BY m")
def ag_argmax(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("m").agg(F.max_by("s1", F.struct(F.col("p"), F.translate("s1", "0123456789", "9876543210"))).alias("s1"))


@query(f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS k FROM scored) SELECT m, round(max(CASE WHEN k = 1 THEN p END), 6) AS p1, round(coalesce(max(CASE WHEN k = 2 THEN p END), 0), 6) AS p2 FROM k GROUP BY m")
def ag_first_second(spark: SparkSession, d: str) -> DataFrame:
    k = W.ordered(scored(spark, d), ["m"], [F.desc("p"), F.asc("s1")], "k").where("k <= 2")
    return k.groupBy("m").agg(F.round(F.max(F.when(F.col("k") == 1, F.col("p"))), 6).alias("p1"), F.round(F.coalesce(F.max(F.when(F.col("k") == 2, F.col("p"))), F.lit(0.0)), 6).alias("p2"))


@query(f"WITH {SCORED}, {EXCL} SELECT t.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT e.m, ',' ORDER BY e.m), '') AS matched_entity_ids FROM s1t t LEFT JOIN (SELECT * FROM excl WHERE p >= 0.6) e ON e.s1 = t.entity_id GROUP BY 1")
def sc_id_lists(spark: SparkSession, d: str) -> DataFrame:
    from samewise.sources.files import id_lists

    return id_lists(s1(spark, d).select(F.col("entity_id").alias("s1")), D.decode(scored(spark, d), 0.6))


@query(f"WITH {SCORED}, b AS (SELECT country, {_BAND} AS band FROM scored WHERE p >= 0.5) SELECT band, count(CASE WHEN country = 'India' THEN 1 END)::BIGINT AS india, count(CASE WHEN country = 'US' THEN 1 END)::BIGINT AS us, count(CASE WHEN country = 'France' THEN 1 END)::BIGINT AS france FROM b GROUP BY band")
def ag_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d).where("p >= 0.5").withColumn("band", D.band(F.col("p")))
    return x.groupBy("band").pivot("country", ["India", "US", "France"]).agg(F.count(F.lit(1))).na.fill(0).select("band", F.col("India").alias("india"), F.col("US").alias("us"), F.col("France").alias("france"))


@query(f"WITH {SCORED} SELECT country, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90 FROM scored GROUP BY country")
def ag_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("country").agg(F.round(F.percentile("p", 0.5), 6).alias("p50"), F.round(F.percentile("p", 0.9), 6).alias("p90"))


@query(f"""WITH {LABELLED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored)
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def ag_auc(spark: SparkSession, d: str) -> DataFrame:
    """The area under the ROC curve by average ranks, from counts by distinct score."""
    c = labelled(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).withColumn("g", F.lit(1))
    c = W.ordered(c, ["g"], [F.asc("p")], "i", {"upto": "n"})
    c = c.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    t = c.agg(F.sum(F.col("k") * F.col("rank")).alias("s"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return t.select(F.round((F.col("s") - F.col("k") * (F.col("k") + 1) / 2) / (F.col("k") * (F.col("n") - F.col("k"))), 6).alias("auc"))


@query(f"WITH {SCORED} SELECT country, s1, m FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5('head' || s1 || m)) AS k FROM scored) WHERE k <= 5")
def ag_head(spark: SparkSession, d: str) -> DataFrame:
    """Five rows of each class, the same ones at every run."""
    x = scored(spark, d).withColumn("h", F.md5(F.concat(F.lit("head"), "s1", "m")))
    w = Window.partitionBy("country").orderBy("h")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 5").select("country", "s1", "m")  # cut to five before the shuffle


@query(f"WITH {SCORED} (SELECT s1, m FROM scored WHERE p >= 0.6) EXCEPT (SELECT s1, m FROM scored WHERE cos >= 0.6)")
def so_except(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return x.where("p >= 0.6").select("s1", "m").join(x.where("cos >= 0.6").select("s1", "m"), ["s1", "m"], "left_anti")


@query(f"WITH {SCORED} SELECT s1, m FROM scored WHERE p >= 0.8 UNION SELECT s1, m FROM scored WHERE cos >= 0.8")
def so_union(spark: SparkSession, d: str) -> DataFrame:
    x = scored(spark, d)
    return x.where("p >= 0.8").select("s1", "m").unionByName(x.where("cos >= 0.8").select("s1", "m")).distinct()


@query("SELECT s1, m, p FROM (SELECT s1, m, p, row_number() OVER (PARTITION BY s1, m ORDER BY scored_at DESC, p DESC NULLS LAST, route, cos NULLS FIRST) AS k FROM candidate_pairs) WHERE k = 1 AND p IS NOT NULL AND NOT isnan(p)")
def so_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated pairs the one scored last."""
    p = table(spark, d, "candidate_pairs")
    w = Window.partitionBy("s1", "m").orderBy(F.desc("scored_at"), F.desc_nulls_last("p"), F.asc("route"), F.asc_nulls_first("cos"))  # repeats of one pair
    return p.withColumn("k", F.row_number().over(w)).where("k = 1 and p is not null and not isnan(p)").select("s1", "m", "p")


@query(f"WITH {S1} SELECT entity_id FROM s1t ORDER BY md5('sample' || entity_id) LIMIT 50")
def so_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty rows at random, the same ones at every run."""
    return s1(spark, d).orderBy(F.md5(F.concat(F.lit("sample"), "entity_id"))).limit(50).select("entity_id")
