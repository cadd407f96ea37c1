"""The views that the queries of the reference's operators run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import text as N
from samewise.session import table


def s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_source1").select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")])


def s23(spark: SparkSession, d: str) -> DataFrame:
    """The records of both noisy sources, each once, with their source."""
    parts = [table(spark, d, f"test_source{k}").withColumn("src", F.lit(k).cast("tinyint")) for k in (2, 3)]
    both = parts[0].unionByName(parts[1])
    return both.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")], "src").distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    """s1, m, p, cos and country, one row for each scored pair."""
    p = table(spark, d, "candidate_pairs").where("p is not null and not isnan(p) and s1 is not null and m is not null")
    one = p.groupBy("s1", "m").agg(F.max("p").alias("p"), F.max(F.col("cos").cast("double")).alias("cos"))
    return one.join(s1(spark, d).select(F.col("entity_id").alias("s1"), "country"), "s1", "left").select("s1", "m", "p", "cos", F.coalesce("country", F.lit("")).alias("country"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """s1, m, p, cos, country and y of the labelled tables: pairs that share a word of the name and one of the address, or whose whole
    names are alike, with the Jaccard values of addresses (cos) and, on average, of both (p), and whether they are known matches."""
    a, b, t = train(spark, d)
    side = lambda df: df.groupBy("entity_id", "country").agg(F.min(F.struct("business_name", "business_address")).alias("r")).select(
        F.col("entity_id").alias("id"), "country", F.array_distinct(N.tokens(N.clean(F.col("r.business_name")))).alias("n"), F.array_distinct(N.tokens(N.clean(F.col("r.business_address")))).alias("a")
    )
    a, b = side(a), side(b)
    word = lambda df, c, i: df.select(F.col("id").alias(i), F.explode(c).alias("w"))
    by_name = word(a, "n", "s1").join(word(b, "n", "m"), "w").select("s1", "m").distinct()
    by_place = word(a, "a", "s1").join(word(b, "a", "m"), "w").select("s1", "m").distinct()
    x = by_name.join(by_place, ["s1", "m"], "left_semi").unionByName(by_name.join(b.where("size(a) = 0").select(F.col("id").alias("m")), "m", "left_semi").select("s1", "m")).distinct()
    x = x.join(a.select(F.col("id").alias("s1"), "country", F.col("n").alias("na"), F.col("a").alias("aa")), "s1").join(b.select(F.col("id").alias("m"), F.col("n").alias("nb"), F.col("a").alias("ab")), "m")
    cos = F.when(F.size("ab") > 0, jaccard("aa", "ab"))
    x = x.select("s1", "m", F.round((jaccard("na", "nb") + F.coalesce(cos, F.lit(0.5))) / 2, 6).alias("p"), F.round(cos, 6).alias("cos"), "country")
    y = t.distinct().withColumn("y", F.lit(1))
    return x.where("p >= 0.2").join(y, ["s1", "m"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def jaccard(a: str, b: str) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def truth(spark: SparkSession, d: str) -> DataFrame:
    """The known matches (s1, m)."""
    return train(spark, d)[2].distinct()


def train(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labelled clean source, records and matches (s1, m)."""
    c = ("business_name", "business_address", "country")
    a = table(spark, d, "train_source1").select("entity_id", *[F.coalesce(x, F.lit("")).alias(x) for x in c])
    b = table(spark, d, "train_source2").unionByName(table(spark, d, "train_source3")).select("entity_id", *[F.coalesce(x, F.lit("")).alias(x) for x in c]).distinct()
    t = table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("m")).where("m <> ''")
    return a, b, t


S1 = "s1t AS (SELECT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country FROM test_source1)"
S23 = """s23 AS (SELECT DISTINCT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country, src FROM
    (SELECT *, 2::TINYINT AS src FROM test_source2 UNION ALL SELECT *, 3::TINYINT AS src FROM test_source3))"""
SCORED = f"""{S1}, scored AS (SELECT p.s1, p.m, p.p, p.cos, coalesce(t.country, '') AS country
    FROM (SELECT s1, m, max(p) AS p, max(cos::DOUBLE) AS cos FROM candidate_pairs WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY s1, m) p LEFT JOIN s1t t ON t.entity_id = p.s1)"""
LATIN = f"replace(replace(replace(translate(lower({{0}}), '{N.ACCENTED}', '{N.BASE}'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
CLEAN = f"trim(regexp_replace({LATIN}, '[^a-z0-9]+', ' ', 'g'))"
TOK = "list_filter(string_split({0}, ' '), lambda t: t <> '')"


def jaccard_sql(x: str, y: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({x}, {y}))) > 0 THEN len(list_intersect(list_distinct({x}), list_distinct({y})))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) ELSE 0 END)"


def _side_sql(table_: str) -> str:
    return f"SELECT entity_id AS id, country, list_distinct({TOK.format(CLEAN.format('r.n'))}) AS n, list_distinct({TOK.format(CLEAN.format('r.a'))}) AS a FROM (SELECT entity_id, country, min(struct_pack(n := business_name, a := business_address)) AS r FROM {table_} GROUP BY entity_id, country)"


#: The same with the labelled tables in place of the test tables, and y.
S1_TRAIN, S23_TRAIN = S1.replace("test_source", "train_source"), S23.replace("test_source", "train_source")
_JC = f"CASE WHEN len(b.a) > 0 THEN {jaccard_sql('a.a', 'b.a')} END"
LABELLED = f"""{S1_TRAIN}, {S23_TRAIN}, truth AS (SELECT DISTINCT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS m FROM train_matches WHERE matched_entity_ids <> ''), la AS ({_side_sql('s1t')}), lb AS ({_side_sql('s23')}),
    bn AS (SELECT DISTINCT x.id AS s1, y.id AS m FROM (SELECT id, unnest(n) AS w FROM la) x JOIN (SELECT id, unnest(n) AS w FROM lb) y USING (w)), bp AS (SELECT DISTINCT x.id AS s1, y.id AS m FROM (SELECT id, unnest(a) AS w FROM la) x JOIN (SELECT id, unnest(a) AS w FROM lb) y USING (w)),
    lp AS (SELECT s1, m FROM bn JOIN bp USING (s1, m) UNION SELECT s1, m FROM bn JOIN lb ON lb.id = m WHERE len(lb.a) = 0),
    scored AS (SELECT * FROM (SELECT s1, m, round(({jaccard_sql('a.n', 'b.n')} + coalesce({_JC}, 0.5)) / 2, 6) AS p, round({_JC}, 6) AS cos, a.country, CASE WHEN t.m IS NULL THEN 0 ELSE 1 END AS y FROM lp JOIN la a ON a.id = lp.s1 JOIN lb b ON b.id = lp.m LEFT JOIN truth t USING (s1, m)) WHERE p >= 0.2)"""
EXCL = "excl AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY m) AS pm FROM scored) WHERE p = pm)"


def sql_bucket(ident: str, salt: str, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}' || {ident}), 1, 8))::BIGINT % {n})"
