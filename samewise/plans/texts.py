"""Queries of normalisation, similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.functions import similarity as S
from samewise.functions import text as N
from samewise.functions.phonetic import udf_code
from samewise.operators import retrieval as R
from samewise.plans.base import CLEAN, LABELLED, LATIN, S1, S23, SCORED, TOK, labelled, s1, s23, scored, train, truth
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


_LATIN, _CLEAN, _TOK = LATIN, CLEAN, TOK
_BIZ = f"""{S1}, {S23}, biz AS (SELECT 1 AS side, entity_id AS id, country, business_name AS raw, business_address AS addr FROM s1t UNION ALL SELECT 2 AS side, entity_id AS id, country, business_name AS raw, business_address AS addr FROM s23),
    cl AS (SELECT side, id, country, raw, addr, {_CLEAN.format('raw')} AS n, {_CLEAN.format('addr')} AS a FROM biz)"""


#: The same over the labelled tables.
_BIZ_TRAIN = _BIZ.replace("test_source", "train_source")


def lcs_sql(pairs_: str) -> str:
    """CTE lcs (x, y, n): the length of the longest common subsequence of each pair (x, y) of the table pairs_, row by row of the table of
    lengths: a cell is the highest of the cells before it, raised where the letters are equal."""
    return f"""lr AS (SELECT x, y, 0 AS i, list_transform(range(length(y)), lambda j: 0) AS r FROM (SELECT DISTINCT x, y FROM {pairs_}) UNION ALL
    SELECT x, y, i + 1 AS i, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + (CASE WHEN x[i + 1] = y[k] THEN 1 ELSE 0 END))))) AS r FROM lr WHERE i < length(x)),
    lcs AS (SELECT x, y, coalesce(r[length(y)], 0) AS n FROM lr WHERE i = length(x))"""


def biz(spark: SparkSession, d: str, known: bool = False) -> DataFrame:
    """All records: side 1 the clean source, side 2 the noisy ones; n and a their cleaned name and address. known: of the labelled tables."""
    one, more = train(spark, d)[:2] if known else (s1(spark, d), s23(spark, d))
    a = one.select(F.lit(1).alias("side"), F.col("entity_id").alias("id"), "country", F.col("business_name").alias("raw"), F.col("business_address").alias("addr"))
    b = more.select(F.lit(2).alias("side"), F.col("entity_id").alias("id"), "country", F.col("business_name").alias("raw"), F.col("business_address").alias("addr"))
    return a.unionByName(b).withColumn("n", N.clean(F.col("raw"))).withColumn("a", N.clean(F.col("addr")))


@query("SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS m FROM train_matches WHERE matched_entity_ids <> ''")
def sc_known_matches(spark: SparkSession, d: str) -> DataFrame:
    from samewise.sources.files import explode_lists

    return explode_lists(table(spark, d, "train_matches"))


@query(f"WITH {S1}, {S23} SELECT src::TINYINT AS src, country, count(*)::BIGINT AS n FROM s23 GROUP BY src, country")
def sc_split(spark: SparkSession, d: str) -> DataFrame:
    return s23(spark, d).groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT source1_entity_id AS s, matched_entity_ids AS x FROM train_matches), adds AS (SELECT source1_entity_id AS s, 'S3-999999999' AS m FROM train_matches WHERE source1_entity_id LIKE '%7')
    SELECT s AS source1_entity_id, CASE WHEN s LIKE '%7' THEN CASE WHEN x = '' THEN 'S3-999999999' ELSE x || ',S3-999999999' END ELSE x END AS matched_entity_ids FROM l""")
def sc_append(spark: SparkSession, d: str) -> DataFrame:
    from samewise.sources.files import append_to_lists

    lists = table(spark, d, "train_matches").select("source1_entity_id", F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))
    adds = lists.where("source1_entity_id like '%7'").select(F.col("source1_entity_id").alias("s1"), F.lit("S3-999999999").alias("m"))
    return append_to_lists(lists, adds)


@query("""WITH b AS (SELECT entity_id, ('0x' || substr(md5('dev' || entity_id), 1, 8))::BIGINT % 10 AS b FROM train_source1), e AS (SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS m FROM train_matches WHERE matched_entity_ids <> ''),
    r AS (SELECT entity_id FROM train_source2 UNION SELECT entity_id FROM train_source3), k AS (SELECT entity_id FROM b WHERE b < 3)
    SELECT 'clean' AS kind, entity_id FROM k UNION ALL SELECT 'noisy' AS kind, entity_id FROM r WHERE entity_id IN (SELECT m FROM e WHERE s1 IN (SELECT entity_id FROM k)) OR
    (entity_id NOT IN (SELECT m FROM e) AND ('0x' || substr(md5('dev' || entity_id), 1, 8))::BIGINT % 10 < 3)""")
def sc_dev_sample(spark: SparkSession, d: str) -> DataFrame:
    from samewise.operators.decode import bucket
    from samewise.plans.base import train
    from samewise.sources.files import dev_sample

    a, b, t = train(spark, d)
    keep, noisy, _ = dev_sample(a, b.select("entity_id").distinct(), t, 3, 10, bucket)
    return keep.select(F.lit("clean").alias("kind"), "entity_id").unionByName(noisy.select(F.lit("noisy").alias("kind"), "entity_id"))


# --- normalisation ---------------------------------------------------------------------------------------------------------------
@query(f"WITH {_BIZ} SELECT id, n, a FROM cl")
def nm_clean(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", "n", "a")


@query()
def nm_normalized(spark: SparkSession, d: str) -> DataFrame:
    """The whole normalisation of all records, with NFKD and transliteration."""
    x = biz(spark, d).select("id", "country", N.normalize_name(F.col("raw")).alias("n"), N.normalize_address(F.col("addr")).alias("a"))
    return x.select("id", "country", "n.*", "a.*")


_JUNK = "{0}"
for _p in (r"(?i)\(\s*id\s*[:#]?\s*[0-9]+\s*\)", r"#\s*[0-9]{{3,}}", r"\+?[0-9][0-9 \-]{{8,}}[0-9]", r"(?i)\bid\s*[:#]\s*[0-9]+"):
    _JUNK = f"regexp_replace({_JUNK}, '{_p}', ' ', 'g')"


@query(f"WITH {_BIZ} SELECT id, {_JUNK.format('raw')} AS stripped FROM cl")
def nm_junk(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.strip_junk(F.col("raw")).alias("stripped"))


_DBA = r"(?i)^(.*?)\s(?:t/a|d/b/a|dba|trading as|a/k/a|aka|o/a)\s(.*)$"


@query(f"WITH {_BIZ} SELECT id, CASE WHEN regexp_matches(raw, '{_DBA}') THEN regexp_extract(raw, '{_DBA}', 2) ELSE raw END AS trading, regexp_extract(raw, '{_DBA}', 1) AS alias FROM cl")
def nm_dba(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.trading_name(F.col("raw")).alias("trading"), N.alias_name(F.col("raw")).alias("alias"))


@query(f"WITH {_BIZ} SELECT id, replace(regexp_extract(lower(trim(raw)), '^(?:www\\.)?([a-z0-9-]+)\\.(?:com|in|net|org|co|biz|info|io|fr|us|example)\\b', 1), '-', ' ') AS host FROM cl")
def nm_web(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.web_host(F.col("raw")).alias("host"))


_DIG, _LET = "length(regexp_replace(t, '[^0-9]', '', 'g'))", "length(regexp_replace(t, '[^a-z]', '', 'g'))"
_OCR = f"""CASE WHEN regexp_matches(t, '^[0-9]*$') OR regexp_matches(t, '^[a-z]*$') OR regexp_matches(t, '^[0-9]+(st|nd|rd|th|er|e|eme|ere)$') THEN t
    WHEN regexp_matches(t, '^[0-9]{{2,}}[a-z]{{3,}}$') THEN regexp_extract(t, '^([0-9]+)', 1) || ' ' || regexp_extract(t, '([a-z]+)$', 1)
    WHEN {_LET} >= 2 AND {_DIG} <= 2 AND {_LET} > {_DIG} THEN translate(t, '0134578', 'oleastb') ELSE t END"""


@query(f"WITH {_BIZ}, w AS (SELECT id, unnest({_TOK.format('n')}) AS t FROM cl) SELECT DISTINCT t AS token, {_OCR} AS fixed FROM w")
def nm_ocr(spark: SparkSession, d: str) -> DataFrame:
    t = biz(spark, d).select(F.explode(N.tokens(F.col("n"))).alias("token")).distinct()
    return t.select("token", N.fix_ocr(F.col("token")).alias("fixed"))


_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CORE = f"list_filter({_TOK.format('n')}, lambda t: NOT list_contains([{_LIST((*N.LEGAL_FORMS, *N.TITLES))}], t))"
_CANON = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.LEGAL_CANON.items()) + " ELSE t END"
_LEGAL = f"array_to_string(list_sort(list_distinct(list_transform(list_filter({_TOK.format('n')}, lambda t: list_contains([{_LIST(N.LEGAL_FORMS)}], t)), lambda t: {_CANON}))), ' ')"


@query(f"WITH {_BIZ} SELECT id, array_to_string(CASE WHEN len({_CORE}) > 0 THEN {_CORE} ELSE {_TOK.format('n')} END, ' ') AS core, {_LEGAL} AS legal FROM cl")
def nm_core(spark: SparkSession, d: str) -> DataFrame:
    t = N.tokens(F.col("n"))
    return biz(spark, d).select("id", F.array_join(N.core(t), " ").alias("core"), N.legal(t).alias("legal"))


_ABBR = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.STREET_WORDS.items()) + " ELSE t END"
_ATOK = f"list_transform(list_transform({_TOK.format('a')}, lambda t: {_ABBR}), lambda t: CASE WHEN regexp_matches(t, '^[0-9]+$') THEN coalesce(nullif(ltrim(t, '0'), ''), '0') ELSE t END)"


@query(f"WITH {_BIZ}, x AS (SELECT id, {_ATOK} AS t FROM cl) SELECT id, array_to_string(list_filter(t, lambda y: regexp_matches(y, '[0-9]')), ' ') AS nums, array_to_string(list_filter(t, lambda y: NOT regexp_matches(y, '[0-9]')), ' ') AS words FROM x")
def nm_address(spark: SparkSession, d: str) -> DataFrame:
    x = biz(spark, d).select("id", N.address_tokens(F.col("a")).alias("t"))
    return x.select("id", F.array_join(F.filter("t", lambda t: t.rlike("[0-9]")), " ").alias("nums"), F.array_join(F.filter("t", lambda t: ~t.rlike("[0-9]")), " ").alias("words"))


@query(f"WITH {_BIZ} SELECT id, nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '') AS house, array_to_string(list_transform(regexp_extract_all(a, '[0-9]+'), lambda x: ltrim(x, '0')), ' ') AS numbers FROM cl")
def nm_numbers(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.house_number(F.col("a")).alias("house"), N.digits(F.col("a")).alias("numbers"))


_PART = f"coalesce(list_filter(string_split({_LATIN.format('addr')}, ','), lambda x: regexp_matches(x, '[0-9]'))[1], '')"
_SK = f"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace({_PART}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains([{_LIST(N.STREET_TYPES)}], t) AND NOT regexp_matches(t, '[0-9]') AND length(t) >= 3)), ' ')"
_CK = f"array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split({_LATIN.format('addr')}, ','), lambda x: NOT regexp_matches(x, '[0-9]')), lambda x: trim(regexp_replace(x, '[^a-z]+', ' ', 'g'))), lambda x: x <> ''))), '|')"


@query(f"WITH {_BIZ} SELECT id, {_SK} AS street, {_CK} AS city FROM cl")
def nm_place_keys(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.street_key(F.col("addr")).alias("street"), N.city_key(F.col("addr")).alias("city"))


_CITIES = ["bitond falls", "jadan falls", "mukur falls", "sotinpur", "nodrornagar", "zuzindabad"]


@query(f"WITH {_BIZ}, p AS (SELECT id, ' ' || regexp_replace(a, '\\bst\\b', 'saint', 'g') || ' ' AS p FROM cl) SELECT id, CASE " + " ".join(f"WHEN contains(p, ' {c} ') THEN '{c}'" for c in sorted(_CITIES, key=lambda x: (-len(x), x))) + " END AS city FROM p")
def nm_city(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.city(F.col("addr"), _CITIES).alias("city"))


@query(f"WITH {_BIZ} SELECT id, array_to_string(list_sort(regexp_extract_all(lower(addr), '(?:unit|suite|ste|apt|appt|shop|office|lot) (?:no )?[0-9]+')), '|') AS unit, regexp_extract(lower(addr), '^[^0-9]*[0-9]+ ?(bis|ter|quater|[a-h])(?:[^a-z]|$)', 1) AS sub FROM cl")
def nm_unit(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", N.unit_key(F.col("addr")).alias("unit"), N.sub_number(F.col("addr")).alias("sub"))


_FOLD = "regexp_replace(n, '[^a-z0-9]', '', 'g')"
for _a, _b in N.FOLDS:
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
for _c in N.LETTERS:
    _FOLD = f"regexp_replace({_FOLD}, '{_c}{_c}+', '{_c}', 'g')"
_ACR = f"CASE WHEN len({_TOK.format('n')}) >= 2 THEN array_to_string(list_transform({_TOK.format('n')}, lambda t: t[1:1]), '') ELSE '' END"


@query(f"WITH {_BIZ}, f AS (SELECT id, n, {_FOLD} AS f FROM cl) SELECT id, f[1:1] || regexp_replace(f[2:], '[aeiou]', '', 'g') AS fold, {_ACR} AS acronym, regexp_replace(n, '[^a-z0-9]', '', 'g') AS compact FROM f")
def nm_fold(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return biz(spark, d).select("id", N.fold_name(N.compact(n)).alias("fold"), N.acronym(N.tokens(n)).alias("acronym"), N.compact(n).alias("compact"))


@query(f"WITH {_BIZ}, t AS (SELECT id, {_TOK.format('a')} AS t FROM cl) SELECT id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]), ' ') AS bigrams FROM t")
def nm_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", F.array_join(N.bigrams(N.tokens(F.col("a"))), " ").alias("bigrams"))


@query()
def nm_phonetic(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("id", udf_code("n").alias("code"))


@query()
def nm_indic(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).where(N.has_indic(F.col("raw"))).select("id", N.nfkd("raw").alias("latin"))


@query(f"WITH {_BIZ} SELECT id, trim(regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM cl WHERE regexp_matches(raw, '^[ -~À-ÖØ-ÝÞà-öù-ýÿ]*$') AND NOT regexp_matches(raw, '[Þþ]')")
def nm_norm(spark: SparkSession, d: str) -> DataFrame:
    """The normaliser of the rules, which keeps letters of every script, over the names in Western letters."""
    x = biz(spark, d).where(F.col("raw").rlike("^[ -~À-ÖØ-ÝÞà-öù-ýÿ]*$") & ~F.col("raw").rlike("[Þþ]"))
    return x.select("id", N.norm(F.col("raw")).alias("norm"))


@query()
def nm_norm_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The same for all other names."""
    x = biz(spark, d).where(~F.col("raw").rlike("^[ -~À-ÖØ-ÝÞà-öù-ýÿ]*$"))
    return x.select("id", N.norm(F.col("raw")).alias("norm"))


_DOTTED = "lower(raw)"
for _p, _q in N.DOTTED:
    _DOTTED = f"regexp_replace({_DOTTED}, '{_p}', '{_q}', 'g')"


@query(f"WITH {_BIZ} SELECT id, array_to_string(list_filter(string_split(trim(regexp_replace({LATIN.format(_DOTTED)}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: list_contains([{', '.join(repr(x) for x in N.LEGAL_FORMS)}], t)), ' ') AS legal FROM cl")
def nm_legal_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The legal forms of each name, also where they are written with dots."""
    t = N.tokens(N.clean(N.undotted(F.col("raw"))))
    return biz(spark, d).select("id", F.array_join(F.filter(t, lambda x: x.isin(*N.LEGAL_FORMS)), " ").alias("legal"))


@query(f"WITH {_BIZ} SELECT id, 'query: ' || n || ' | ' || a AS query, n || ' | ' || a AS pair FROM cl")
def nm_record_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a record for encoders and pair models."""
    return biz(spark, d).select("id", N.record_text(F.col("n"), F.col("a"), "query: ").alias("query"), N.record_text(F.col("n"), F.col("a")).alias("pair"))


_AL = f"list_filter(string_split({_CLEAN.format("regexp_extract(raw, '" + _DBA + "', 1)")}, ' '), lambda t: t <> '')"


@query(f"WITH {_BIZ}, t AS (SELECT side, id, (CASE WHEN len({_CORE}) > 0 THEN {_CORE} ELSE {_TOK.format('n')} END) AS c, CASE WHEN side = 2 THEN {_AL} ELSE [] END AS al, {_TOK.format('a')} AS aw, regexp_replace(n, '[^a-z0-9]', '', 'g') AS cmp FROM cl) SELECT id, array_to_string(list_concat(list_concat(list_concat(list_concat(c, al), aw), list_transform(range(1, len(aw)), lambda i: aw[i] || '_' || aw[i + 1])), CASE WHEN cmp <> '' THEN ['cmp_' || cmp] ELSE [] END), ' ') AS doc FROM t")
def nm_block_document(spark: SparkSession, d: str) -> DataFrame:
    """The words that a record is retrieved by: core name, a noisy record's alias, address and its bigrams, the compact name."""
    x = biz(spark, d)
    alias = F.when(F.col("side") == 2, N.tokens(N.clean(N.alias_name(F.col("raw"))))).otherwise(F.array().cast("array<string>"))
    return x.select("id", F.array_join(N.block_document(N.core(N.tokens(F.col("n"))), alias, N.tokens(F.col("a")), N.compact(F.col("n"))), " ").alias("doc"))


# --- similarities on scored pairs ------------------------------------------------------------------------------------------------
_PAIR = f"{SCORED}, {S23}, pr AS (SELECT c.s1, c.m, {_CLEAN.format('t.business_name')} AS a, {_CLEAN.format('r.business_name')} AS b FROM scored c JOIN s1t t ON t.entity_id = c.s1 JOIN (SELECT entity_id, max(business_name) AS business_name FROM s23 GROUP BY 1) r ON r.entity_id = c.m)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs with both cleaned names."""
    one = s23(spark, d).groupBy("entity_id").agg(F.max("business_name").alias("nb"))
    x = scored(spark, d).select("s1", "m").join(s1(spark, d).select(F.col("entity_id").alias("s1"), F.col("business_name").alias("na")), "s1").join(one.withColumnRenamed("entity_id", "m"), "m")
    return x.select("s1", "m", N.clean(F.col("na")).alias("a"), N.clean(F.col("nb")).alias("b"))


_TA, _TB = _TOK.format("a"), _TOK.format("b")


@query(f"WITH {_PAIR} SELECT s1, m, levenshtein(a, b)::INTEGER AS lev, len(list_intersect(list_distinct({_TA}), list_distinct({_TB})))::INTEGER AS shared, contains(a, b) AS inside FROM pr")
def ss_edit_and_overlap(spark: SparkSession, d: str) -> DataFrame:
    ta, tb = N.tokens(F.col("a")), N.tokens(F.col("b"))
    return pairs(spark, d).select("s1", "m", F.levenshtein("a", "b").alias("lev"), F.size(F.array_intersect(ta, tb)).alias("shared"), F.contains("a", "b").alias("inside"))


@query(f"WITH {_PAIR} SELECT s1, m, round(jaro_winkler_similarity(a, b), 5) AS jw FROM pr WHERE a <> '' AND b <> ''")
def ss_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("a <> '' and b <> ''").select("s1", "m", F.round(S.udf_jaro_winkler("a", "b"), 5).alias("jw"))


_SORTED = "array_to_string(list_sort({0}), ' ')"
_BOTH, _LEFT, _RIGHT = (f"list_sort(list_distinct({x}))" for x in (f"list_intersect({_TA}, {_TB})", f"list_filter({_TA}, lambda t: NOT list_contains({_TB}, t))", f"list_filter({_TB}, lambda t: NOT list_contains({_TA}, t))"))
#: x and y of the five ratios: as they are, sorted, and common tokens with either side's rest.
RATIO_PAIRS = f"""rp AS (SELECT s1, m, a, b, {_SORTED.format(_TA)} AS sa, {_SORTED.format(_TB)} AS sb, array_to_string({_BOTH}, ' ') AS co, array_to_string(list_concat({_BOTH}, {_LEFT}), ' ') AS pa, array_to_string(list_concat({_BOTH}, {_RIGHT}), ' ') AS pb,
    len({_BOTH}) AS nb, len({_LEFT}) AS nl, len({_RIGHT}) AS nr, len({_TA}) AS na_, len({_TB}) AS nb_ FROM pr), xy AS (SELECT a AS x, b AS y FROM rp UNION SELECT sa AS x, sb AS y FROM rp UNION SELECT pa AS x, pb AS y FROM rp), {lcs_sql('xy')}"""
_RATIO = "(CASE WHEN length({0}) + length({1}) = 0 THEN 100.0 ELSE 200.0 * {2} / (length({0}) + length({1})) END)"
_TSET = "CASE WHEN na_ = 0 OR nb_ = 0 THEN 0.0 WHEN nb > 0 AND (nl = 0 OR nr = 0) THEN 100.0 WHEN nb = 0 THEN {0} ELSE greatest({0}, {1}, {2}) END".format(_RATIO.format("pa", "pb", "l3.n"), _RATIO.format("co", "pa", "length(co)"), _RATIO.format("co", "pb", "length(co)"))
RATIO_SQL = f"SELECT s1, m, round({_RATIO.format('a', 'b', 'l1.n')}, 4) AS ratio, round({_TSET}, 4) AS tset, round({_RATIO.format('sa', 'sb', 'l2.n')}, 4) AS tsort FROM rp JOIN lcs l1 ON l1.x = a AND l1.y = b JOIN lcs l2 ON l2.x = sa AND l2.y = sb JOIN lcs l3 ON l3.x = pa AND l3.y = pb"


@query(f"WITH RECURSIVE {_PAIR}, {RATIO_PAIRS} {RATIO_SQL}")
def ss_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Three ratios of the names of scored pairs: each distinct pair of names is scored once."""
    return S.scored_once(pairs(spark, d), "a", "b", {"ratio": S.ratio, "tset": S.token_set_ratio, "tsort": S.token_sort_ratio}).select("s1", "m", *[F.round(c, 4).alias(c) for c in ("ratio", "tset", "tsort")])


@query()
def ss_partial(spark: SparkSession, d: str) -> DataFrame:
    return S.scored_once(pairs(spark, d), "a", "b", {"partial": S.partial_ratio}).select("s1", "m", F.round("partial", 4).alias("partial"))


@query(f"""WITH {_PAIR}, l AS (SELECT s1, m, a, b, list_distinct({_TA}) AS x, list_distinct({_TB}) AS y, regexp_replace(a, '[^a-z0-9]', '', 'g') AS ca, regexp_replace(b, '[^a-z0-9]', '', 'g') AS cb FROM pr)
    SELECT s1, m, CASE WHEN b = '' THEN 'no name' WHEN a = b THEN 'same' WHEN ca = cb THEN 'same letters' WHEN len(x) = len(y) AND len(list_intersect(x, y)) = len(x) THEN 'same words' WHEN len(list_intersect(x, y)) = len(x) THEN 'words added' WHEN len(list_intersect(x, y)) = len(y) THEN 'words left out' WHEN levenshtein(a, b) <= 2 THEN 'mistyped' WHEN len(list_intersect(x, y)) > 0 THEN 'shares words' ELSE 'other' END AS relation FROM l""")
def nm_relation(spark: SparkSession, d: str) -> DataFrame:
    """How the two names of a pair are related."""
    return pairs(spark, d).select("s1", "m", N.relation(F.col("a"), F.col("b")).alias("relation"))


_IDF = f"""{_BIZ}, p AS (SELECT s1 AS q, m AS c FROM scored), ta AS (SELECT id, unnest(list_distinct({_TOK.format('n')})) AS t FROM cl), df AS (SELECT t, ln((SELECT count(*) FROM cl)::DOUBLE / count(*)) AS idf FROM ta GROUP BY t), w AS (SELECT id, t, idf FROM ta JOIN df USING (t)),
    s AS (SELECT id, sum(idf) AS s FROM w GROUP BY id), h AS (SELECT q, c, sum(x.idf) AS wi, max(x.idf) AS top, count(*) AS k FROM p JOIN w x ON x.id = q JOIN w y ON y.id = c AND y.t = x.t GROUP BY q, c)"""


@query(f"WITH {SCORED}, " + _IDF.replace(f"{S1}, ", "") + """ SELECT p.q, p.c, round(CASE WHEN coalesce(a.s, 0) + coalesce(b.s, 0) - coalesce(wi, 0) > 0 THEN coalesce(wi, 0) / (coalesce(a.s, 0) + coalesce(b.s, 0) - coalesce(wi, 0)) ELSE -1 END, 6) AS widf,
    round(coalesce(top, 0), 6) AS widf_max, coalesce(k, 0)::BIGINT AS shared FROM p LEFT JOIN h ON h.q = p.q AND h.c = p.c LEFT JOIN s a ON a.id = p.q LEFT JOIN s b ON b.id = p.c WHERE p.c IN (SELECT id FROM cl)""")
def ss_idf_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = biz(spark, d).select("side", "id", N.tokens(F.col("n")).alias("tokens"))
    p = scored(spark, d).select(F.col("s1").alias("q"), F.col("m").alias("c")).join(x.select(F.col("id").alias("c")), "c", "left_semi")
    o = R.idf_overlap(p, x.where("side = 1").drop("side"), x.where("side = 2").drop("side"))
    return o.select("q", "c", F.round("widf", 6).alias("widf"), F.round("widf_max", 6).alias("widf_max"), "shared")


# --- retrieval -------------------------------------------------------------------------------------------------------------------
def _tf_sql(doc: str, k: int, max_df: float, min_df: int, where: str = "TRUE") -> str:
    return f"""docs AS (SELECT side, id, country, {doc} AS l FROM cl WHERE {where}), n AS (SELECT country, count(*) AS n FROM docs GROUP BY country),
    t AS (SELECT side, id, country, t, count(*) AS tf FROM (SELECT side, id, country, unnest(l) AS t FROM docs) WHERE t <> '' GROUP BY ALL), df AS (SELECT country, t, count(*) AS df FROM t GROUP BY country, t),
    w AS (SELECT side, id, t.country, t.t, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM t JOIN df USING (country, t) JOIN n USING (country) WHERE df >= {min_df} AND df <= {max_df} * n),
    u AS (SELECT side, id, country, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
    s AS (SELECT a.id AS q, b.id AS c, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.country = b.country AND a.t = b.t AND a.side = {{q}} AND b.side = 3 - {{q}} GROUP BY 1, 2)
    SELECT q, c, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s WHERE score >= 0.01) WHERE rank <= {k}"""


@query(f"WITH {_BIZ}, " + _tf_sql(f"list_concat({_TOK.format('n')}, {_TOK.format('a')})", 5, 0.05, 1).format(q=1))
def bl_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The five records of each clean row nearest by words of name and address."""
    x = biz(spark, d).select("side", "id", "country", F.concat(N.tokens(F.col("n")), N.tokens(F.col("a"))).alias("tokens"))
    q, c = R.tfidf(x.where("side = 1"), x.where("side = 2"), max_df=0.05)
    return R.similarity_join(q, c, 5)


_GRAMS = "flatten(list_transform({0}, lambda t: list_transform(range(1, greatest(length(t) + 2 - 2, 1) + 1), lambda i: (' ' || t || ' ')[i:i + 2])))"


@query(f"WITH {_BIZ}, " + _tf_sql(_GRAMS.format(_TOK.format("n")), 5, 0.02, 2).format(q=1))
def bl_characters(spark: SparkSession, d: str) -> DataFrame:
    x = biz(spark, d).select("side", "id", "country", N.char_grams(N.tokens(F.col("n"))).alias("tokens"))
    q, c = R.tfidf(x.where("side = 1"), x.where("side = 2"), max_df=0.02, min_df=2)
    return R.similarity_join(q, c, 5)


@query(f"WITH {_BIZ}, " + _tf_sql(_GRAMS.format(_TOK.format("n")), 5, 0.02, 2, "side = 1 OR a = ''").format(q=2))
def bl_reverse_name(spark: SparkSession, d: str) -> DataFrame:
    """Of each record without an address the five nearest clean rows by name."""
    x = biz(spark, d).where("side = 1 or a = ''").select("side", "id", "country", N.char_grams(N.tokens(F.col("n"))).alias("tokens"))
    q, c = R.tfidf(x.where("side = 2"), x.where("side = 1"), max_df=0.02, min_df=2)
    return R.similarity_join(q, c, 5)


def _space_sql(tag: str, tokens: str, w: float, most: float, least: int) -> str:
    return f"""d{tag} AS (SELECT side, id, country, unnest({tokens}) AS t FROM cl), t{tag} AS (SELECT side, id, country, t, count(*) AS tf FROM d{tag} WHERE t <> '' GROUP BY ALL), n{tag} AS (SELECT country, count(*) AS n FROM cl WHERE side = 2 GROUP BY country),
    f{tag} AS (SELECT country, t, count(*) AS df FROM t{tag} WHERE side = 2 GROUP BY country, t), w{tag} AS (SELECT side, id, x.country, '{tag}' || x.t AS t, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM t{tag} x JOIN f{tag} USING (country, t) JOIN n{tag} USING (country) WHERE df >= {least} AND df <= {most} * n),
    u{tag} AS (SELECT side, id, country, t, sqrt({w}) * w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w{tag})"""


@query(f"WITH {_BIZ}, {_space_sql('1', _TOK.format('n'), 0.6, 1.0, 1)}, {_space_sql('2', _TOK.format('a'), 0.4, 0.02, 2)}, " + """u AS (SELECT * FROM u1 UNION ALL SELECT * FROM u2), s AS (SELECT a.id AS q, b.id AS c, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.country = b.country AND a.t = b.t AND a.side = 1 AND b.side = 2 WHERE a.id IN (SELECT id FROM cl WHERE side = 1 AND a <> '') GROUP BY 1, 2)
    SELECT q, c, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s WHERE score >= 0.25) WHERE rank <= 5""")
def bl_two_spaces(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest records by names and addresses in two weighted spaces."""
    x = biz(spark, d).select("side", "id", "country", "a", N.tokens(F.col("n")).alias("nt"), N.tokens(F.col("a")).alias("at"))
    q, c = R.two_spaces(x.where("side = 1 and a <> ''"), x.where("side = 2"), "nt", "at")
    return R.similarity_join(q, c, 5, 0.25)


@query()
def bl_native(spark: SparkSession, d: str) -> DataFrame:
    """Records in an Indic script, transcribed, with their best clean row in two weighted spaces, where no route has the pair."""
    x = biz(spark, d)
    x = x.withColumn("n", N.base_clean(F.col("raw")))
    y = x.select("side", "id", "country", "raw", N.tokens(F.col("n")).alias("nt"), N.tokens(F.col("a")).alias("at"))
    q, c = R.two_spaces(y.where("side = 2").where(N.has_indic(F.col("raw"))), y.where("side = 1"), "nt", "at")
    best = R.similarity_join(q, c, 5, 0.25).where("rank = 1").select(F.col("c").alias("s1"), F.col("q").alias("m"), "score")
    return best.join(table(spark, d, "candidate_pairs").select("s1", "m"), ["s1", "m"], "left_anti")


@query(f"""WITH {_BIZ}, k AS (SELECT DISTINCT side, id, country, key FROM (SELECT side, id, country, unnest(list_concat(list_concat({_TOK.format('n')}, {_TOK.format('a')}), list_transform(range(1, len({_TOK.format('a')})), lambda i: ({_TOK.format('a')})[i] || '_' || ({_TOK.format('a')})[i + 1]))) AS key FROM cl) WHERE length(key) > 1),
    n AS (SELECT country, count(*) AS n FROM cl GROUP BY country), df AS (SELECT country, key, df FROM (SELECT country, key, count(*) AS df FROM k GROUP BY country, key) JOIN n USING (country) WHERE df <= greatest(50.0, n * 0.0005)), r AS (SELECT * FROM (SELECT k.*, df, row_number() OVER (PARTITION BY side, id ORDER BY df, key) AS i FROM k JOIN df USING (country, key)) WHERE i <= 8),
    s AS (SELECT a.id AS q, b.id AS c, round(sum(ln(n::DOUBLE / a.df)), 6) AS score, count(*) AS key_n FROM r a JOIN r b ON a.country = b.country AND a.key = b.key AND a.side = 1 AND b.side = 2 JOIN n ON n.country = a.country GROUP BY 1, 2)
    SELECT q, c, score, key_n::BIGINT AS key_n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s) WHERE rank <= 5""")
def bl_rare_keys(spark: SparkSession, d: str) -> DataFrame:
    a = N.tokens(F.col("a"))
    x = biz(spark, d)
    k = x.select("side", "id", "country", F.explode(F.concat(N.tokens(F.col("n")), a, N.bigrams(a))).alias("key")).where("length(key) > 1")
    return R.rare_key_join(k, x.groupBy("country").agg(F.count(F.lit(1)).alias("n")), 50, 8, 5, 0.0005)


def _guard_sql(key: str, a: int, b: int) -> str:
    return f"""WITH {_BIZ}, k AS (SELECT DISTINCT side, id, country, key FROM (SELECT side, id, country, {key} AS key FROM cl) WHERE key IS NOT NULL AND key <> ''),
    ok AS (SELECT country, key FROM k GROUP BY country, key HAVING count(*) FILTER (WHERE side = 1) BETWEEN 1 AND {a} AND count(*) FILTER (WHERE side = 2) BETWEEN 1 AND {b})
    SELECT DISTINCT x.id AS q, y.id AS c FROM k x JOIN k y ON x.country = y.country AND x.key = y.key AND x.side = 1 AND y.side = 2 JOIN ok ON ok.country = x.country AND ok.key = x.key"""


@query(_guard_sql("nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '') || '|' || nullif(" + _SK + ", '')", 20, 80))
def bl_house_street(spark: SparkSession, d: str) -> DataFrame:
    """House number and street, guarded by 20 clean rows and 80 records."""
    street = F.nullif(N.street_key(F.col("addr")), F.lit(""))
    return R.guarded_join(biz(spark, d), F.concat(N.house_number(F.col("a")), F.lit("|"), street), 20, 80)


@query(_guard_sql("regexp_replace(n, '[^a-z0-9]', '', 'g') || '|' || nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '')", 20, 80))
def bl_same_name(spark: SparkSession, d: str) -> DataFrame:
    return R.guarded_join(biz(spark, d), F.concat(N.compact(F.col("n")), F.lit("|"), N.house_number(F.col("a"))), 20, 80)


_WORDS = f"list_filter({_TOK.format('a')}, lambda t: NOT regexp_matches(t, '[0-9]'))"
_HOUSE = "nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '')"


@query(f"""WITH {_BIZ}, r AS (SELECT side, id, country, regexp_replace(n, '[^a-z0-9]', '', 'g') AS name, {_HOUSE} AS house, {_WORDS} AS words FROM cl), rr AS (SELECT * FROM r WHERE length(name) >= 3), nn AS (SELECT country, count(*) AS n FROM rr GROUP BY country),
    w AS (SELECT side, id, country, name, unnest(list_distinct(words)) AS w FROM rr), rare AS (SELECT country, w FROM (SELECT country, w, count(*) AS df FROM w WHERE length(w) >= 3 GROUP BY country, w) JOIN nn USING (country) WHERE df < 0.1 * n),
    k AS (SELECT DISTINCT side, id, country, key FROM (SELECT side, id, country, name || '|#' || house AS key FROM rr WHERE house IS NOT NULL UNION ALL SELECT side, id, w.country, name || '|' || w.w AS key FROM w JOIN rare ON rare.country = w.country AND rare.w = w.w)),
    ok AS (SELECT country, key FROM k GROUP BY country, key HAVING count(*) FILTER (WHERE side = 1) BETWEEN 1 AND 20 AND count(*) FILTER (WHERE side = 2) BETWEEN 1 AND 80)
    SELECT DISTINCT x.id AS q, y.id AS c FROM k x JOIN k y ON x.country = y.country AND x.key = y.key AND x.side = 1 AND y.side = 2 JOIN ok ON ok.country = x.country AND ok.key = x.key""")
def bl_same_name_or_word(spark: SparkSession, d: str) -> DataFrame:
    """Same compact name and the house number or an address word in less than a tenth of the country's rows."""
    x = biz(spark, d).select("side", "id", "country", N.compact(F.col("n")).alias("name"), N.house_number(F.col("a")).alias("house"), F.filter(N.tokens(F.col("a")), lambda t: ~t.rlike("[0-9]")).alias("words"))
    return R.same_name_join(x, 0.1, 20, 80)


@query(f"WITH {_BIZ}, " + _tf_sql(_GRAMS.format(_TOK.format("n")), 25, 0.02, 2, "side = 1 OR a = ''").format(q=2) + " AND rank > 10")
def bl_reverse_band(spark: SparkSession, d: str) -> DataFrame:
    """Of each record without an address the clean rows on ranks 11 to 25 by name."""
    x = biz(spark, d).where("side = 1 or a = ''").select("side", "id", "country", N.char_grams(N.tokens(F.col("n"))).alias("tokens"))
    q, c = R.tfidf(x.where("side = 2"), x.where("side = 1"), max_df=0.02, min_df=2)
    return R.similarity_join(q, c, 25).where("rank > 10")


_HOUSED = f"""hr AS (SELECT DISTINCT side, id, country, {_HOUSE} AS house, {_WORDS} AS words FROM cl), nn AS (SELECT country, count(*) AS n FROM hr GROUP BY country), hw AS (SELECT side, id, country, house, unnest(list_distinct(words)) AS w FROM hr),
    dw AS (SELECT country, w, count(*) AS df FROM hw GROUP BY country, w), hx AS (SELECT hw.*, df, n FROM hw JOIN dw ON dw.country = hw.country AND dw.w = hw.w JOIN nn ON nn.country = hw.country WHERE house IS NOT NULL AND length(hw.w) >= 3)"""
_GUARDED = """ok AS (SELECT country, key FROM k GROUP BY country, key HAVING count(*) FILTER (WHERE side = 1) BETWEEN 1 AND 20 AND count(*) FILTER (WHERE side = 2) BETWEEN 1 AND 80)
    SELECT DISTINCT x.id AS q, y.id AS c FROM k x JOIN k y ON x.country = y.country AND x.key = y.key AND x.side = 1 AND y.side = 2 JOIN ok ON ok.country = x.country AND ok.key = x.key"""


def _housed(spark: SparkSession, d: str) -> DataFrame:
    return biz(spark, d).select("side", "id", "country", N.house_number(F.col("a")).alias("house"), F.filter(N.tokens(F.col("a")), lambda t: ~t.rlike("[0-9]")).alias("words")).distinct()


@query(f"WITH {_BIZ}, {_HOUSED}, k AS (SELECT DISTINCT side, id, country, house || '|' || s AS key FROM (SELECT side, id, country, house, string_agg(DISTINCT w, ' ' ORDER BY w) AS s FROM hx WHERE df < greatest(2.0, n * 0.002) GROUP BY side, id, country, house)), {_GUARDED}")
def bl_house_rare_words(spark: SparkSession, d: str) -> DataFrame:
    """House number and all words of the address that less than 0.2 % of the country's rows have."""
    return R.guarded_join(R.house_keys(_housed(spark, d))[0], F.col("key"), 20, 80)


@query(f"WITH {_BIZ}, {_HOUSED}, k AS (SELECT DISTINCT side, id, country, house || '|' || w AS key FROM (SELECT *, row_number() OVER (PARTITION BY side, id, country ORDER BY df, w) AS i FROM hx) WHERE i <= 2), {_GUARDED}")
def bl_house_rarest(spark: SparkSession, d: str) -> DataFrame:
    """House number and each of the two rarest words of the address."""
    return R.guarded_join(R.house_keys(_housed(spark, d))[1], F.col("key"), 20, 80)


@query()
def bl_phonetic(spark: SparkSession, d: str) -> DataFrame:
    return R.guarded_join(biz(spark, d), F.concat(udf_code("n"), F.lit("|"), N.house_number(F.col("a"))), 10, 40)


@query("WITH x AS (" + ORACLES["nm_fold"] + f"), {_BIZ.split(', cl AS')[0]}, k AS (SELECT DISTINCT side, b.id, country, fold AS key FROM biz b JOIN x ON x.id = b.id WHERE length(fold) >= 4), ok AS (SELECT country, key FROM k GROUP BY country, key HAVING count(*) FILTER (WHERE side = 1) BETWEEN 1 AND 10 AND count(*) FILTER (WHERE side = 2) BETWEEN 1 AND 40) SELECT DISTINCT x.id AS q, y.id AS c FROM k x JOIN k y ON x.country = y.country AND x.key = y.key AND x.side = 1 AND y.side = 2 JOIN ok ON ok.country = x.country AND ok.key = x.key")
def bl_folded(spark: SparkSession, d: str) -> DataFrame:
    fold = N.fold_name(N.compact(F.col("n")))
    return R.guarded_join(biz(spark, d), F.when(F.length(fold) >= 4, fold), 10, 40)


@query(f"""WITH {_BIZ}, s AS (SELECT side, id, country, regexp_replace(n, '[^a-z0-9]', '', 'g') AS k FROM cl), p AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY k, side, id) AS pos FROM s WHERE length(k) >= 3)
    SELECT DISTINCT CASE WHEN a.side = 1 THEN a.id ELSE b.id END AS q, CASE WHEN a.side = 1 THEN b.id ELSE a.id END AS c FROM p a JOIN p b ON a.country = b.country AND b.pos - a.pos BETWEEN 1 AND 4 AND a.side <> b.side""")
def bl_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    x = biz(spark, d).select("side", "id", "country", N.compact(F.col("n")).alias("k")).where("length(k) >= 3")
    return R.sorted_neighbourhood(x, "k")


_VEC = "v AS (SELECT vec_id AS id, label AS country, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END AS side FROM embeddings)"


def _dense_sql(q: int, k: int) -> str:
    return f"WITH {_VEC}, s AS (SELECT a.id AS q, b.id AS c, round(list_dot_product(a.e, b.e), 5) AS score FROM v a JOIN v b ON a.country = b.country AND a.side = {q} AND b.side = {3 - q}) SELECT q, c, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s) WHERE rank <= {k}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("country"), F.col("embedding").alias("vector"))
    return v.where("id % 4 = 0"), v.where("id % 4 <> 0")


@query(_dense_sql(1, 5))
def bl_dense(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return R.dense_top_k(q, c, 5)


@query(_dense_sql(2, 3))
def bl_dense_reverse(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return R.dense_top_k(c, q, 3)


@query()
def bl_encoded(spark: SparkSession, d: str) -> DataFrame:
    """The three records nearest to each clean row by hashed vectors of its name, where no learned encoder is at hand."""
    x = biz(spark, d).select("side", "id", "country", R.hashed_vector(N.char_grams(N.tokens(F.col("n")))).alias("vector")).distinct()
    return R.dense_top_k(x.where("side = 1").drop("side"), x.where("side = 2").drop("side"), 3)


_COS = f"""ct AS (SELECT id, unnest(list_distinct(list_concat({_TOK.format('n')}, {_TOK.format('a')}))) AS t FROM one), cd AS (SELECT t, ln((1 + (SELECT count(*) FROM one))::DOUBLE / (1 + count(*))) + 1 AS w FROM ct GROUP BY t), cw AS (SELECT id, t, w FROM ct JOIN cd USING (t)), cn AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM cw GROUP BY id),
    ch AS (SELECT q, c, sum(x.w * y.w) AS dot FROM cp JOIN cw x ON x.id = q JOIN cw y ON y.id = c AND y.t = x.t GROUP BY q, c), cc AS (SELECT cp.q, cp.c, round(coalesce(dot / (a.nrm * b.nrm), 0), 6) AS cosine FROM cp LEFT JOIN ch ON ch.q = cp.q AND ch.c = cp.c LEFT JOIN cn a ON a.id = cp.q LEFT JOIN cn b ON b.id = cp.c)"""
_ONE = "one AS (SELECT side, id, r.n AS n, r.a AS a FROM (SELECT side, id, min(struct_pack(n := n, a := a)) AS r FROM cl GROUP BY side, id))"


def _texts_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, tokens) of each clean row and record, by the words of name and address."""
    one = biz(spark, d).groupBy("side", "id").agg(F.min(F.struct("n", "a")).alias("r"))
    x = one.select("side", "id", F.concat(N.tokens(F.col("r.n")), N.tokens(F.col("r.a"))).alias("tokens"))
    return x.where("side = 1").drop("side"), x.where("side = 2").drop("side")


@query(f"WITH {SCORED}, " + _BIZ.replace(f"{S1}, ", "") + f", {_ONE}, cp AS (SELECT DISTINCT s1 AS q, m AS c FROM scored), {_COS} SELECT q, c, cosine FROM cc")
def ss_idf_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of given pairs by inverse document frequencies."""
    p = scored(spark, d).select(F.col("s1").alias("q"), F.col("m").alias("c"))
    return R.idf_cosine(p, *_texts_of(spark, d)).select("q", "c", F.round("cosine", 6).alias("cosine"))


_STREET_KEY = "nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '') || '|' || nullif(" + _SK + ", '')"
_NAME_KEY = "regexp_replace(n, '[^a-z0-9]', '', 'g') || '|' || nullif(ltrim(regexp_extract(a, '([0-9]+)', 1), '0'), '')"


@query(f"""WITH {_BIZ}, {_ONE}, rt AS (SELECT q, c, 'street' AS route FROM ({_guard_sql(_STREET_KEY, 20, 80)}) UNION ALL SELECT q, c, 'name' AS route FROM ({_guard_sql(_NAME_KEY, 20, 80)})), known AS (SELECT s1 AS q, m AS c FROM candidate_pairs),
    nw AS (SELECT * FROM rt r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.q = r.q AND k.c = r.c)), cp AS (SELECT DISTINCT q, c FROM nw), {_COS}
    SELECT q, c, route, cosine FROM (SELECT q, c, route, cosine, row_number() OVER (PARTITION BY q, route ORDER BY cosine DESC, c) AS i FROM nw JOIN cc USING (q, c)) WHERE i <= 2""")
def bl_new_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs of two routes that no route found before, the two of each clean row and route with the highest IDF cosine."""
    known = table(spark, d, "candidate_pairs").select(F.col("s1").alias("q"), F.col("m").alias("c"))
    return R.new_pairs([("street", bl_house_street(spark, d)), ("name", bl_same_name(spark, d))], known, *_texts_of(spark, d))


@query(f"""WITH {_BIZ}, w AS (SELECT id, list_distinct({_TOK.format('n')}) AS l FROM cl WHERE side = 1), p AS (SELECT x.a, y.b, count(*) AS n FROM (SELECT id, unnest(l) AS a FROM w) x JOIN (SELECT id, unnest(l) AS b FROM w) y ON x.id = y.id AND x.a < y.b GROUP BY 1, 2)
    SELECT a, b, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p WHERE n >= 2) WHERE k <= 15""")
def ag_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """The 15 words that most often stand in a name with each word."""
    w = biz(spark, d).where("side = 1").select("id", F.array_distinct(N.tokens(F.col("n"))).alias("l"))
    p = w.select("l", F.explode("l").alias("a")).select("a", F.explode("l").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return p.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("k <= 15").select("a", "b", "n")


@query(f"WITH {_PAIR}, l AS (SELECT s1, m, list_distinct({_TA}) AS x, list_distinct({_TB}) AS y FROM pr) SELECT s1, m, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS extra, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS missing, array_to_string(list_sort(list_distinct(list_concat(x, y))), ' ') AS every FROM l")
def so_list_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = N.tokens(F.col("a")), N.tokens(F.col("b"))
    j = lambda x: F.array_join(F.array_sort(x), " ")
    return pairs(spark, d).select("s1", "m", j(F.array_except(b, a)).alias("extra"), j(F.array_except(a, b)).alias("missing"), j(F.array_union(a, b)).alias("every"))
