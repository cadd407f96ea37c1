"""Queries of pair features and of the joins after decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import text as N
from samewise.operators import decode as D
from samewise.operators import features as X
from samewise.operators import rules as U
from samewise.functions import similarity as S
from samewise.operators import windows as W
from samewise.plans.base import EXCL, LABELLED, SCORED, labelled, s23, scored, train
from samewise.plans.texts import _BIZ, _BIZ_TRAIN, _CK, _CLEAN, _CORE, _LEGAL, _PAIR, _SK, _TOK, RATIO_PAIRS, RATIO_SQL, biz, lcs_sql, pairs
from samewise.session import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = biz(spark, d)
    one = x.where("side = 2").groupBy("side", "id").agg(F.min(F.struct("country", "raw", "addr", "n", "a")).alias("r")).select("side", "id", "r.*")  # repeats of a record are alike
    return x.where("side = 1"), one


def _joined(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return X.joined(scored(spark, d).select(F.col("s1").alias("q"), F.col("m").alias("c")), a, b)


_CL = f"{SCORED}, " + _BIZ[_BIZ.index("s23 AS") :]
_CTOK = f"(CASE WHEN len({_CORE}) > 0 THEN {_CORE} ELSE {_TOK.format('n')} END)"
_HOST = "replace(regexp_extract(lower(trim(raw)), '^(?:www\\.)?([a-z0-9-]+)\\.(?:com|in|net|org|co|biz|info|io|fr|us|example)\\b', 1), '-', ' ')"
_PARTS = f"""pt AS (SELECT side, id, n, a, {_HOST} AS web, {_LEGAL} AS legal, regexp_replace(n, '[^a-z0-9]', '', 'g') AS compact, CASE WHEN len({_CTOK}) >= 2 THEN array_to_string(list_transform({_CTOK}, lambda t: t[1:1]), '') ELSE '' END AS acr,
    list_filter({_TOK.format('a')}, lambda t: regexp_matches(t, '[0-9]')) AS nums FROM cl), pn AS (SELECT *, nums[1] AS num, nullif(regexp_extract(nums[1], '^([0-9]{{1,9}})', 1), '')::DOUBLE AS v FROM pt)"""


@query(f"""WITH {_CL}, {_PARTS} SELECT s.s1 AS q, s.m AS c, (x.acr <> '' AND x.acr = y.compact)::INTEGER::DOUBLE AS n_acr_a, (y.acr <> '' AND y.acr = x.compact)::INTEGER::DOUBLE AS n_acr_b, length(x.n)::DOUBLE AS n_len_a, length(y.n)::DOUBLE AS n_len_b,
    len(x.nums)::DOUBLE AS num_count_a, len(y.nums)::DOUBLE AS num_count_b, (x.legal = y.legal)::INTEGER::DOUBLE AS legal_eq, ((x.legal = '') <> (y.legal = ''))::INTEGER::DOUBLE AS legal_missing, (y.a = '')::INTEGER::DOUBLE AS b_addr_empty,
    CASE WHEN x.num IS NOT NULL AND y.num IS NOT NULL THEN (x.num = y.num)::INTEGER::DOUBLE ELSE -1 END AS num_first_eq, CASE WHEN x.num IS NOT NULL AND y.num IS NOT NULL THEN levenshtein(x.num, y.num)::DOUBLE ELSE -1 END AS num_first_lev,
    length(x.a)::DOUBLE AS a_len_a, length(y.a)::DOUBLE AS a_len_b, (y.web <> '')::INTEGER::DOUBLE AS b_is_web, CASE WHEN x.num IS NOT NULL AND y.num IS NOT NULL THEN (length(y.num) - length(x.num))::DOUBLE ELSE -1 END AS num_first_lendiff,
    round(CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN ln(1 + abs(x.v - y.v)) ELSE -1 END, 6) AS num_first_absdiff, round(CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN sign(y.v - x.v) * ln(1 + abs(y.v - x.v)) END, 6) AS num_first_signed
    FROM scored s JOIN pn x ON x.id = s.s1 JOIN pn y ON y.id = s.m""")
def ft_plain(spark: SparkSession, d: str) -> DataFrame:
    x = X.plain_features(_joined(spark, d))
    keep = ("n_acr_a", "n_acr_b", "n_len_a", "n_len_b", "num_count_a", "num_count_b", "legal_eq", "legal_missing", "b_addr_empty", "num_first_eq", "num_first_lev", "a_len_a", "a_len_b", "b_is_web", "num_first_lendiff")
    return x.select("q", "c", *keep, F.round("num_first_absdiff", 6).alias("num_first_absdiff"), F.round("num_first_signed", 6).alias("num_first_signed"))


@query()
def ft_similarities(spark: SparkSession, d: str) -> DataFrame:
    x = X.fuzzy_features(_joined(spark, d))
    return x.select("q", "c", *[F.round(c, 4).alias(c) for c in ("n_ratio", "n_tset", "n_tsort", "n_partial", "n_jw", "n_clean_tset", "n_compact_ratio", "n_clean_ratio", "n_compact_partial", "n_alt_tset", "a_ratio", "a_tset", "a_partial", "a_tsort", "a_words_tset", "num_tset", "num_first_ratio", "x_name_in_addr", "sim_mix")])


@query()
def ft_frame(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature frame of the pair model: plain features, similarities, the overlaps of names and addresses by inverse document
    frequencies."""
    a, b = _sides(spark, d)
    x = X.frame(scored(spark, d).select(F.col("s1").alias("q"), F.col("m").alias("c")), a, b)
    return x.select("q", "c", *[F.round(c, 5).alias(c) for c in X.feature_columns(x)])


def _global(spark: SparkSession, d: str, name: str, f) -> DataFrame:
    return S.scored_once(pairs(spark, d), "a", "b", {name: f})


_GN = f"{_PAIR}, {RATIO_PAIRS}, rs AS ({RATIO_SQL}), gn AS (SELECT s1, m, tset AS g FROM rs)"


@query(f"""WITH RECURSIVE {_GN}, k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY g DESC, s1) AS rc, row_number() OVER (PARTITION BY s1 ORDER BY g DESC, m) AS rq FROM gn), t AS (SELECT *, max(g) OVER (PARTITION BY m) AS m1, coalesce(max(CASE WHEN rc = 2 THEN g END) OVER (PARTITION BY m), 0) AS m2 FROM k)
    SELECT s1, m, round(g, 4) AS g_name, rc::BIGINT AS g_name_rank_c, rq::BIGINT AS g_name_rank_q, round(g - m1, 4) AS g_name_gap_c, count(*) FILTER (WHERE g >= 90) OVER (PARTITION BY m)::BIGINT AS twins_c, count(*) FILTER (WHERE g >= 90) OVER (PARTITION BY s1)::BIGINT AS twins_q, round(CASE WHEN g >= m1 THEN g - m2 ELSE g - m1 END, 4) AS g_name_margin_c FROM t""")
def wn_global_names(spark: SparkSession, d: str) -> DataFrame:
    """The likeness of names over all pairs, with ranks, twins and margins among a record's and a row's pairs."""
    x = _global(spark, d, "g_name", S.token_set_ratio).select("s1", "m", F.round("g_name", 4).alias("g_name"))
    x = W.global_context(x, "g_name", 90.0)
    return x.select("s1", "m", "g_name", "g_name_rank_c", "g_name_rank_q", F.round("g_name_gap_c", 4).alias("g_name_gap_c"), F.col("twins_c"), F.col("twins_q"), F.round("g_name_margin_c", 4).alias("g_name_margin_c"))


@query()
def wn_global_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the likenesses of names and addresses over all pairs, and sim_mix, each with gap, rank and margin."""
    x = X.fuzzy_features(_joined(spark, d)).select(F.col("q").alias("s1"), F.col("c").alias("m"), F.col("n_tset").alias("g_name"), F.col("a_tset").alias("g_addr"), "sim_mix")
    x = x.withColumn("g_mix", (F.col("g_name") + F.least(F.greatest("g_addr", F.lit(0.0)), F.lit(100.0))) / 2)
    x = W.global_context(staged(x, "global"), "g_mix", 90.0)
    x = W.second_best(W.gap_and_rank(x, "sim_mix", "s1", "m", "q"), "sim_mix", "s1", "sim_mix_margin_q")
    return x.select("s1", "m", *[F.round(c, 4).alias(c) for c in ("g_name", "g_addr", "g_mix", "g_mix_gap_c", "g_mix_margin_c", "sim_mix", "sim_mix_gap_q", "sim_mix_margin_q")], "g_mix_rank_c", "g_mix_rank_q", "sim_mix_rank_q")


@query(f"""WITH RECURSIVE {_PAIR}, kk AS (SELECT s1, m, p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS k FROM scored), an AS (SELECT a.s1, a.m, CASE WHEN a.k = 1 THEN c.m ELSE b.m END AS anchor FROM kk a LEFT JOIN kk b ON b.s1 = a.s1 AND b.k = 1 LEFT JOIN kk c ON c.s1 = a.s1 AND c.k = 2),
    nm AS (SELECT entity_id AS m, {_CLEAN.format('business_name')} AS nb FROM (SELECT entity_id, max(business_name) AS business_name FROM s23 GROUP BY 1)), pz AS (SELECT an.s1, an.m, coalesce(y.nb, '') AS a, coalesce(x.nb, '') AS b FROM an LEFT JOIN nm x ON x.m = an.m LEFT JOIN nm y ON y.m = an.anchor WHERE anchor IS NOT NULL), {RATIO_PAIRS.replace(' FROM pr)', ' FROM pz)')}, rs AS ({RATIO_SQL})
    SELECT an.s1, an.m, coalesce(rs.tset, -1) AS tri_name FROM an LEFT JOIN rs ON rs.s1 = an.s1 AND rs.m = an.m""")
def wn_triangle(spark: SparkSession, d: str) -> DataFrame:
    """How like each candidate's name is that of its row's most likely other record."""
    one = s23(spark, d).groupBy(F.col("entity_id").alias("m")).agg(N.clean(F.max("business_name")).alias("text"))
    return W.triangle(scored(spark, d).select("s1", "m", "p"), one, S.token_set_ratio, "tri_name").select("s1", "m", F.round("tri_name", 4).alias("tri_name"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs that share a word: (q, c, y, ta, tb)."""
    a, b, _ = train(spark, d)
    name = lambda df, i, n: df.groupBy(F.col("entity_id").alias(i)).agg(F.array_distinct(N.tokens(N.clean(F.min(F.struct("business_name", "business_address"))["business_name"]))).alias(n))
    x = labelled(spark, d).select(F.col("s1").alias("q"), F.col("m").alias("c"), "y").join(name(a, "q", "ta"), "q").join(name(b, "c", "tb"), "c")
    return x.where(F.arrays_overlap("ta", "tb")).select("q", "c", "y", "ta", "tb")


_NEAR = f"{LABELLED}, ne AS (SELECT s1 AS q, m AS c, y, a.n AS ta, b.n AS tb FROM scored JOIN la a ON a.id = s1 JOIN lb b ON b.id = m WHERE len(list_intersect(a.n, b.n)) > 0)"
_BASE = "(SELECT ln((sum(y) + 1)::DOUBLE / (count(*) - sum(y) + 1)) FROM ne)"


def _odds_sql(more: str, less: str) -> str:
    return f"SELECT token, ln((sum(y) + 1)::DOUBLE / (count(*) - sum(y) + 1)) - {_BASE} AS score FROM (SELECT y, unnest(list_filter({more}, lambda t: NOT list_contains({less}, t))) AS token FROM ne) GROUP BY token HAVING count(*) >= 20"


@query(f"WITH {_NEAR}, o AS ({_odds_sql('tb', 'ta')}), w AS ({_odds_sql('ta', 'tb')}) SELECT 'extra' AS kind, token, round(score, 6) AS score FROM o UNION ALL SELECT 'missing' AS kind, token, round(score, 6) AS score FROM w")
def ft_token_odds(spark: SparkSession, d: str) -> DataFrame:
    x = staged(_near(spark, d), "near")
    kinds = [X.token_odds(x, k, 20).select(F.lit(k).alias("kind"), "token", F.round("score", 6).alias("score")) for k in ("extra", "missing")]
    return kinds[0].unionByName(kinds[1])


@query(f"""WITH {_NEAR}, o AS ({_odds_sql('tb', 'ta')}), w AS ({_odds_sql('ta', 'tb')}), e AS (SELECT q, c, unnest(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS token FROM ne), i AS (SELECT q, c, unnest(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS token FROM ne),
    es AS (SELECT q, c, min(score) AS mn, sum(score) AS sm FROM e JOIN o USING (token) GROUP BY q, c), ms AS (SELECT q, c, min(score) AS mn, sum(score) AS sm FROM i JOIN w USING (token) GROUP BY q, c)
    SELECT n.q, n.c, len(list_filter(tb, lambda t: NOT list_contains(ta, t)))::DOUBLE AS dec_n_extra, len(list_filter(ta, lambda t: NOT list_contains(tb, t)))::DOUBLE AS dec_n_missing, round(coalesce(es.mn, 0), 6) AS dec_extra_min, round(coalesce(es.sm, 0), 6) AS dec_extra_sum,
    round(coalesce(ms.mn, 0), 6) AS dec_missing_min, round(coalesce(ms.sm, 0), 6) AS dec_missing_sum FROM ne n LEFT JOIN es USING (q, c) LEFT JOIN ms USING (q, c)""")
def ft_decoy(spark: SparkSession, d: str) -> DataFrame:
    x = staged(_near(spark, d), "near")
    y = X.decoy_features(x.drop("y"), X.token_odds(x, "extra", 20), X.token_odds(x, "missing", 20))
    return y.select("q", "c", "dec_n_extra", "dec_n_missing", *[F.round(c, 6).alias(c) for c in ("dec_extra_min", "dec_extra_sum", "dec_missing_min", "dec_missing_sum")])


@query(f"WITH {_NEAR}, o AS ({_odds_sql('ta', 'tb')}), q AS (SELECT * FROM (VALUES ('services', 'service'), ('pvt', 'private'), ('trading', 'negoce'), ('food', 'products')) v(token, other)) SELECT token, round(score, 6) AS score FROM o UNION ALL SELECT other AS token, round(max(score), 6) AS score FROM o JOIN q USING (token) WHERE other NOT IN (SELECT token FROM o) GROUP BY other")
def ft_equivalents(spark: SparkSession, d: str) -> DataFrame:
    odds = staged(X.token_odds(_near(spark, d), "missing", 20), "odds")
    return X.with_equivalents(odds, {"services": ["service"], "pvt": ["private"], "trading": ["negoce"], "food": ["products"]}).select("token", F.round("score", 6).alias("score"))


# --- joins after decoding --------------------------------------------------------------------------------------------------------
def _rule_sql(view: str, least: int = 2, sure: float = 0.9) -> str:
    """The compared pairs (cp), the best row of each record, the claimed pairs (pred), and voc, the words that records add to names, in
    least pairs or more: of the test or the labelled (known) tables."""
    base = _CL if view == "test" else f"{LABELLED}, " + _BIZ_TRAIN[_BIZ_TRAIN.index("biz AS") :]
    return f"""{base}, {EXCL}, ky AS (SELECT DISTINCT ON (side, id) side, id, country, raw, addr, n, a, list_sort(list_distinct({_CTOK})) AS words, {_TOK.format('n')} AS toks, nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '') AS hn, {_SK} AS street, {_CK} AS city, {_LEGAL} AS legal,
    array_to_string(list_transform(regexp_extract_all(a, '[0-9]+'), lambda x: ltrim(x, '0')), ' ') AS digits, array_to_string(list_transform({_CTOK}, lambda t: t[1:1]), '') AS init, {_UNIT} AS unit, {_SUB} AS sub FROM cl ORDER BY side, id, raw, addr, country),
    pred AS (SELECT s1, m FROM excl WHERE p >= {sure}), cp AS (SELECT s.s1, s.m, s.p, x.hn AS hn_a, y.hn AS hn_b, x.hn = y.hn AS same_hn, list_filter(x.words, lambda t: NOT list_contains(y.words, t)) AS gone, list_filter(y.words, lambda t: NOT list_contains(x.words, t)) AS new, x.street AS sa, y.street AS sb, x.legal AS la, y.legal AS lb,
    x.city AS ca, y.city AS cb, y.addr AS ab, y.toks AS tb FROM scored s JOIN ky x ON x.id = s.s1 AND x.side = 1 JOIN ky y ON y.id = s.m AND y.side = 2), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS k FROM cp) WHERE k = 1),
    voc AS (SELECT new[1] AS word FROM cp WHERE len(gone) <= 1 AND len(new) = 1 GROUP BY new[1] HAVING count(*) >= {least})"""


_UNIT = "array_to_string(list_sort(regexp_extract_all(lower(addr), '(?:unit|suite|ste|apt|appt|shop|office|lot) (?:no )?[0-9]+')), '|')"
_SUB = "regexp_extract(lower(addr), '^[^0-9]*[0-9]+ ?(bis|ter|quater|[a-h])(?:[^a-z]|$)', 1)"
_RULE, _KNOWN = _rule_sql("test"), _rule_sql("known", 1)
_ONE_NEW = "len(gone) <= 1 AND len(new) = 1 AND new[1] IN (SELECT word FROM voc)"


def _one_each(spark: SparkSession, d: str, known: bool = False) -> tuple[DataFrame, DataFrame]:
    x = biz(spark, d, known)
    one = x.groupBy("side", "id").agg(F.min(F.struct("raw", "addr", "country", "n", "a")).alias("r")).select("side", "id", "r.*")
    k = staged(U.keyed(one), "keyed")
    return k.where("side = 1"), k.where("side = 2")


def _compared(spark: SparkSession, d: str, known: bool = False, sure: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compared pairs, claimed pairs, rows and records, of the test or the labelled tables."""
    a, b = _one_each(spark, d, known)
    s = (labelled if known else scored)(spark, d).select("s1", "m", "p")
    return U.compared(s, a, b), D.decode(s, sure), a, b


@query(f"WITH {_RULE} SELECT s1, m FROM best WHERE m NOT IN (SELECT m FROM pred) AND same_hn AND {_ONE_NEW}")
def ru_suffix_adds(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d)
    return U.suffix_adds(x, pred, U.added_words(x, 2))


_FORMS = f"[{', '.join(repr(x) for x in N.LEGAL_FORMS)}]"
_POS = f"""CASE WHEN NOT list_contains(tb, new[1]) THEN 'na' WHEN tb[1] = new[1] THEN 'front' WHEN len(list_filter(tb, lambda t: list_contains({_FORMS}, t))) > 0 THEN CASE WHEN list_position(tb, new[1]) > list_position(tb, list_filter(tb, lambda t: list_contains({_FORMS}, t))[1]) THEN 'appended' ELSE 'middle' END
    WHEN list_position(tb, new[1]) = len(tb) THEN 'noleg_last' ELSE 'noleg_mid' END"""


@query(f"WITH {_KNOWN} SELECT s1, m FROM best WHERE m NOT IN (SELECT m FROM pred) AND same_hn AND {_ONE_NEW} AND {_POS} IN ('front', 'appended', 'noleg_last')")
def ru_suffix_adds_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The same where the added word stands first, last, or behind the legal form."""
    x, pred, *_ = _compared(spark, d, True)
    return U.suffix_adds(x, pred, U.added_words(x, 1), ["front", "appended", "noleg_last"])


@query(f"WITH {_RULE} SELECT p.s1, p.m FROM pred p JOIN cp c ON c.s1 = p.s1 AND c.m = p.m WHERE NOT same_hn AND c.p < 0.998")
def ru_number_drops(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d)
    return U.changed_number_drops(x, pred)


@query(f"WITH {_RULE} SELECT p.s1, p.m FROM pred p JOIN cp c ON c.s1 = p.s1 AND c.m = p.m WHERE same_hn AND {_ONE_NEW}")
def ru_swap_drops(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d)
    return U.swap_drops(x, pred, U.added_words(x, 2))


_SOME = _rule_sql("known", 1, 0.4)


@query(f"""WITH RECURSIVE {_SOME}, sw AS (SELECT *, gone[1] AS dw, new[1] AS aw FROM cp WHERE len(gone) = 1 AND len(new) = 1), dv AS (SELECT dw AS word FROM sw WHERE dw NOT IN ('services', 'company') GROUP BY dw HAVING count(*) >= 5), h AS (SELECT * FROM sw WHERE same_hn AND aw NOT IN ('services', 'company') AND aw IN (SELECT word FROM dv)),
    xy AS (SELECT aw AS x, dw AS y FROM h), {lcs_sql('xy')} SELECT p.s1, p.m FROM pred p JOIN h ON h.s1 = p.s1 AND h.m = p.m JOIN lcs ON lcs.x = aw AND lcs.y = dw
    WHERE NOT (lcs.n = length(aw) OR lcs.n = length(dw) OR (length(aw) <= 4 AND aw[1] = dw[1] AND len(list_filter(string_split(aw, ''), lambda t: NOT contains(dw, t))) = 0) OR 200.0 * lcs.n / (length(aw) + length(dw)) >= 70)""")
def ru_derived_drops(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d, True, 0.4)
    return U.derived_swap_drops(x, pred, ["services", "company"], 5)


_AHEAD = f"""ya AS (SELECT c.*, array_to_string(x.words, ' ') AS wa, array_to_string(y.words, ' ') AS wb FROM cp c JOIN ky x ON x.id = c.s1 AND x.side = 1 JOIN ky y ON y.id = c.m AND y.side = 2 WHERE ab = ''), xy AS (SELECT wa AS x, wb AS y FROM ya), {lcs_sql('xy')},
    si AS (SELECT ya.*, CASE WHEN length(wa) + length(wb) = 0 THEN 100.0 ELSE 200.0 * lcs.n / (length(wa) + length(wb)) END AS sim FROM ya JOIN lcs ON lcs.x = wa AND lcs.y = wb), rk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY sim DESC, s1) AS k2 FROM si),
    tw AS (SELECT m, max(sim) AS m1, max(CASE WHEN k2 = 2 THEN sim END) AS m2 FROM rk GROUP BY m), ad AS (SELECT si.* FROM si JOIN tw ON tw.m = si.m AND tw.m1 = si.sim WHERE m1 - coalesce(m2, 0) >= 15 AND si.m NOT IN (SELECT m FROM pred))"""


@query(f"WITH RECURSIVE {_RULE}, {_AHEAD} SELECT s1, m FROM ad WHERE len(gone) = 0 AND len(new) = 0 AND p >= 0.2")
def ru_nameonly_adds(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d)
    return U.nameonly_adds(x, pred, 15, 0.2)


@query(f"WITH RECURSIVE {_KNOWN}, {_AHEAD} SELECT s1, m FROM ad WHERE {_ONE_NEW}")
def ru_nameonly_suffix_adds(spark: SparkSession, d: str) -> DataFrame:
    """The same where the record's name has one word more."""
    x, pred, *_ = _compared(spark, d, True)
    return U.nameonly_adds(x, pred, 15, 0.2, U.added_words(x, 1))


@query(f"""WITH {_RULE.replace('>= 2)', '>= 1)')} SELECT s1, m FROM best WHERE m NOT IN (SELECT m FROM pred) AND hn_b IS NULL AND hn_a IS NOT NULL AND sa <> '' AND {_ONE_NEW} AND len(list_filter(string_split(sa, ' '), lambda t: NOT list_contains(string_split({_CLEAN.format('ab')}, ' '), t))) = 0 AND (ca = '' OR cb = '' OR ca = cb)""")
def ru_numberless_adds(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d)
    return U.numberless_adds(x, pred, U.added_words(x, 1))


_OUTSIDE = "(SELECT m FROM scored WHERE p >= 0.6)"


@query(f"""WITH {_KNOWN}, j AS (SELECT x.id AS s1, y.id AS m FROM ky x JOIN ky y ON x.side = 1 AND y.side = 2 AND x.hn = y.hn AND x.street = y.street AND x.street <> '' AND x.digits = y.digits AND (x.legal = '' OR y.legal = '' OR x.legal = y.legal)
    WHERE y.id NOT IN {_OUTSIDE} AND len(list_filter(x.words, lambda t: NOT list_contains(y.words, t))) <= 1 AND len(list_filter(y.words, lambda t: NOT list_contains(x.words, t))) = 1 AND list_filter(y.words, lambda t: NOT list_contains(x.words, t))[1] IN (SELECT word FROM voc))
    SELECT min(s1) AS s1, m FROM j GROUP BY m HAVING count(*) = 1""")
def ru_outside_adds(spark: SparkSession, d: str) -> DataFrame:
    """Of the labelled records that have no candidate with p of 0.6."""
    x, _, a, b = _compared(spark, d, True)
    return U.outside_adds(a, b, labelled(spark, d).where("p >= 0.6"), U.added_words(x, 1))


@query(f"""WITH {_rule_sql('known', 1, 0.95)}, s AS (SELECT * FROM cp WHERE len(gone) = 0 AND len(new) = 0), h AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS k FROM s WHERE NOT same_hn AND length(hn_a) <= 9 AND length(hn_b) <= 9 AND m NOT IN (SELECT m FROM pred)
    AND m NOT IN (SELECT m FROM s WHERE same_hn) AND sa = sb AND sa <> '' AND NOT (lb <> '' AND la <> lb) AND (hn_b::BIGINT - hn_a::BIGINT < 0 OR hn_b::BIGINT - hn_a::BIGINT > 2)) SELECT s1, m FROM h WHERE k = 1""")
def ru_shifted_adds(spark: SparkSession, d: str) -> DataFrame:
    x, pred, *_ = _compared(spark, d, True, 0.95)
    return U.shifted_number_adds(x, pred, 2)


_WEB = "replace(regexp_extract(lower(trim(raw)), '^(?:www\\.)?([a-z0-9-]+)\\.(?:com|in|net|org|co|biz|info|io|fr|us|example)\\b', 1), '-', ' ')"
_WORD = f"""sw AS (SELECT id AS m, hn, street, city, regexp_replace(n, '[^a-z0-9]', '', 'g') AS word, toks AS tb, unit, sub FROM ky WHERE side = 2 AND NOT contains(trim(raw), ' ') AND trim(raw) <> '' AND {_WEB} = ''
    AND hn IS NOT NULL AND street <> '' AND id NOT IN (SELECT m FROM pred)), pl AS (SELECT *, count(*) OVER (PARTITION BY hn, street, city) AS tenants FROM ky WHERE side = 1)"""
_FITS = "((length(word) BETWEEN 2 AND 5 AND contains(init, word)) OR (length(word) >= 5 AND len(list_intersect(p.toks, tb)) = 0))"


@query(f"WITH {_KNOWN}, {_WORD} SELECT DISTINCT p.id AS s1, w.m FROM sw w JOIN pl p ON p.hn = w.hn AND p.street = w.street AND p.city = w.city WHERE tenants = 1 AND {_FITS}")
def ru_renamed_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True)
    return U.renamed_adds(a, b, pred)


@query(f"WITH {_KNOWN}, {_WORD} SELECT min(p.id) AS s1, w.m FROM sw w JOIN pl p ON p.hn = w.hn AND p.street = w.street AND p.city = w.city WHERE tenants >= 2 AND length(word) BETWEEN 2 AND 5 AND contains(init, word) GROUP BY w.m HAVING count(*) = 1")
def ru_shared_place_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True)
    return U.shared_place_adds(a, b, pred)


@query(f"WITH {_SOME}, {_WORD} SELECT min(x.id) AS s1, y.id AS m FROM ky y JOIN pl x ON y.side = 2 AND x.hn = y.hn AND x.street = y.street AND x.unit = y.unit AND x.sub = y.sub WHERE tenants >= 2 AND x.unit <> '' AND x.street <> '' AND y.id NOT IN (SELECT m FROM pred) GROUP BY y.id HAVING count(*) = 1")
def ru_unit_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True, 0.4)
    return U.unit_adds(a, b, pred)


@query(f"""WITH {_KNOWN}, {_WORD}, j AS (SELECT DISTINCT p.id AS s1, w.m FROM sw w JOIN ky p ON p.side = 1 AND p.hn = w.hn AND p.city = w.city WHERE w.city <> '' AND length(word) BETWEEN 2 AND 5 AND contains(p.init, word) AND (w.unit = '' OR p.unit = '' OR w.unit = p.unit) AND (w.sub = '' OR p.sub = '' OR w.sub = p.sub))
    SELECT min(s1) AS s1, m FROM j GROUP BY m HAVING count(*) = 1""")
def ru_initials_in_city_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True)
    return U.initials_in_city_adds(a, b, pred)


@query(f"""WITH {_KNOWN}, {_WORD} SELECT DISTINCT p.id AS s1, y.id AS m FROM ky y JOIN pl p ON y.side = 2 AND p.hn = y.hn AND p.street = y.street AND p.city = y.city AND p.legal = y.legal WHERE tenants = 1 AND len(y.words) = 1 AND y.legal <> '' AND y.street <> '' AND length(y.words[1]) >= 4
    AND y.id NOT IN (SELECT m FROM pred) AND y.words[1] NOT IN (SELECT unnest(toks) FROM ky WHERE side = 1)""")
def ru_invented_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True)
    return U.invented_with_legal_adds(a, b, pred)


@query(f"""WITH {_KNOWN}, w AS (SELECT id AS m, hn, regexp_replace({_WEB}, '[^a-z0-9]', '', 'g') AS h FROM ky WHERE side = 2 AND {_WEB} <> '' AND hn IS NOT NULL AND id NOT IN (SELECT m FROM pred)), j AS (SELECT DISTINCT x.id AS s1, w.m FROM w JOIN ky x ON x.side = 1 AND x.hn = w.hn AND regexp_replace(x.n, '[^a-z0-9]', '', 'g') = w.h)
    SELECT min(s1) AS s1, m FROM j GROUP BY m HAVING count(*) = 1""")
def ru_handle_adds(spark: SparkSession, d: str) -> DataFrame:
    """Records whose name is the web address of the only row at their number with that name."""
    _, pred, a, b = _compared(spark, d, True)
    return U.handle_adds(a, b, pred)


@query(f"""WITH RECURSIVE {_KNOWN}, {_WORD}, j AS (SELECT w.m, p.id AS s1, word, init, p.toks AS ta, tb, p.street AS x, w.street AS y FROM sw w JOIN ky p ON p.side = 1 AND p.hn = w.hn AND p.city = w.city WHERE w.city <> '' AND p.street <> ''), {lcs_sql('j')},
    r AS (SELECT j.*, 200.0 * lcs.n / (length(j.x) + length(j.y)) AS sr FROM j JOIN lcs ON lcs.x = j.x AND lcs.y = j.y), o AS (SELECT m FROM r WHERE sr >= 60 GROUP BY m HAVING count(*) = 1)
    SELECT DISTINCT s1, m FROM r WHERE m IN (SELECT m FROM o) AND sr >= 50 AND sr < 100 AND ((length(word) BETWEEN 2 AND 5 AND contains(init, word)) OR (length(word) >= 5 AND len(list_intersect(ta, tb)) = 0))""")
def ru_fuzzy_street_adds(spark: SparkSession, d: str) -> DataFrame:
    _, pred, a, b = _compared(spark, d, True)
    return U.fuzzy_street_adds(a, b, pred, 50)


@query(f"""WITH {_RULE}, low AS (SELECT s1, m FROM excl WHERE p >= 0.6), pl AS (SELECT *, count(*) OVER (PARTITION BY hn, street, city) AS tenants, count(*) OVER (PARTITION BY country, words) AS same FROM ky WHERE side = 1)
    SELECT l.s1, l.m FROM low l WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.s1 = l.s1 AND p.m = l.m) AND l.s1 IN (SELECT id FROM pl WHERE same = 1 OR (tenants = 1 AND hn IS NOT NULL))""")
def ru_safe_adds(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _one_each(spark, d)
    s = scored(spark, d)
    return U.safe_adds(D.decode(s, 0.6), D.decode(s, 0.9), a)


def _tie_sql(known: str, where: str, limit: str, more: str = "TRUE") -> str:
    return f"""WITH {known}, k AS (SELECT *, array_to_string(words, ' ') AS key FROM ky), t AS (SELECT country, key FROM k WHERE side = 1 AND key <> '' GROUP BY country, key HAVING count(*) >= 2 AND {limit}),
    j AS (SELECT r.id AS m, x.id AS s1, r.hn AS hb, x.hn AS ha FROM k r JOIN k x ON r.side = 2 AND x.side = 1 AND r.country = x.country AND r.key = x.key AND r.legal = x.legal JOIN t ON t.country = r.country AND t.key = r.key WHERE {where} AND r.legal <> '' AND r.id NOT IN (SELECT m FROM pred)), o AS (SELECT min(s1) AS s1, m, min(ha) AS ha, min(hb) AS hb FROM j GROUP BY m HAVING count(*) = 1)
    SELECT s1, m FROM o WHERE {more}"""


@query(_tie_sql(_RULE, "r.addr = ''", "count(*) FILTER (WHERE legal = '') <= 2"))
def ru_legal_tie(spark: SparkSession, d: str) -> DataFrame:
    """Records without an address whose words several rows have: the one with their legal form."""
    _, pred, a, b = _compared(spark, d)
    return U.legal_tie(a, b, pred)


@query(_tie_sql(_rule_sql("test", 1, 2.0), "r.addr <> '' AND r.hn IS NOT NULL", "TRUE", "ha = hb AND EXISTS (SELECT 1 FROM scored s WHERE s.s1 = o.s1 AND s.m = o.m AND s.p >= 0.5)"))
def ru_legal_tie_addressed(spark: SparkSession, d: str) -> DataFrame:
    """The same for records with an address, at the row's house number, where the pair's p is 0.5 or more."""
    _, pred, a, b = _compared(spark, d, False, 2.0)
    return U.legal_tie(a, b, pred, addressed=True, scored=scored(spark, d))
