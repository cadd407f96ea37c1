"""Joins after decoding that add or drop pairs by the words and numbers in which both sides differ. Word lists, labels and limits are
parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import text as N
from samewise.functions.similarity import udf_is_abbreviation, udf_ratio
from samewise.operators.windows import best_two

Words = list[str] | DataFrame  # a list, or a table with the column word


def keyed(df: DataFrame) -> DataFrame:
    """(id, country, raw, addr, n, a) with its distinct core words, house number, street, city and legal forms."""
    t = N.tokens(F.col("n"))
    return df.withColumns({
        "words": F.array_sort(F.array_distinct(N.core(t))), "hn": N.house_number(F.col("a")), "street": N.street_key(F.col("addr")), "city": N.city_key(F.col("addr")), "legal": N.legal(t),
        "digits": N.digits(F.col("a")), "init": F.array_join(F.transform(N.core(t), lambda x: F.substring(x, 1, 1)), ""), "unit": N.unit_key(F.col("addr")), "sub": N.sub_number(F.col("addr")), "toks": t,
    })


def compared(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (s1, m, …) with the words that m's name lacks (nd, dw the first) and has more (na, aw the first) and same_hn, which is null
    where a number is missing. a, b: keyed."""
    take = ("words", "hn", "street", "city", "legal", "digits", "toks", "init", "raw", "addr")
    x = pairs.join(a.select(F.col("id").alias("s1"), *[F.col(c).alias(f"{c}_a") for c in take]), "s1").join(b.select(F.col("id").alias("m"), *[F.col(c).alias(f"{c}_b") for c in take]), "m")
    gone, new = F.array_except("words_a", "words_b"), F.array_except("words_b", "words_a")
    return x.withColumns({"nd": F.size(gone), "na": F.size(new), "dw": F.try_element_at(gone, F.lit(1)), "aw": F.try_element_at(new, F.lit(1)), "same_hn": F.col("hn_a") == F.col("hn_b")})


def among(x: DataFrame, column: str, words: Words) -> DataFrame:
    """The rows of x whose column is one of words."""
    if isinstance(words, DataFrame):
        return x.join(words.select(F.col("word").alias(column)).distinct(), column, "left_semi")
    return x.where(F.col(column).isin(words))


def not_among(x: DataFrame, column: str, words: Words) -> DataFrame:
    if isinstance(words, DataFrame):
        return x.join(words.select(F.col("word").alias(column)).distinct(), column, "left_anti")
    return x.where(~F.col(column).isin(words))


def added_words(x: DataFrame, least: int) -> DataFrame:
    """(word): the words by which records' names are longer than a row's, in least or more of the compared pairs."""
    return x.where("nd <= 1 and na = 1").groupBy(F.col("aw").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def unclaimed(x: DataFrame, pred: DataFrame) -> DataFrame:
    return x.join(pred.select("m").distinct(), "m", "left_anti")


def best_of(x: DataFrame, score: str = "p") -> DataFrame:
    """The row with the highest score of each m; of equal ones the smallest s1."""
    top = x.groupBy("m").agg(F.max(score).alias("_top"))
    y = x.join(top, "m").where(F.col(score) == F.col("_top")).drop("_top")
    return y.join(y.groupBy("m").agg(F.min("s1").alias("s1")), ["m", "s1"])


def suffix_adds(x: DataFrame, pred: DataFrame, suffixes: Words, positions: list[str] | None = None) -> DataFrame:
    """Unclaimed records whose best row has the same number and whose name has one word more, from suffixes, at one of positions."""
    y = among(unclaimed(best_of(x), pred).where("same_hn and nd <= 1 and na = 1"), "aw", suffixes)
    if positions:
        y = y.where(N.word_position(F.col("toks_b"), F.col("aw")).isin(positions))
    return y.select("s1", "m")


def numberless_adds(x: DataFrame, pred: DataFrame, suffixes: Words) -> DataFrame:
    """The same for records without a number: all words of the row's street stand in the record's address, cities don't differ."""
    y = among(unclaimed(best_of(x), pred).where("hn_b is null and hn_a is not null and nd <= 1 and na = 1 and street_a <> ''"), "aw", suffixes)
    inside = F.size(F.array_except(F.split("street_a", " "), N.tokens(N.clean(F.col("addr_b"))))) == 0
    return y.where(inside & ((F.col("city_a") == "") | (F.col("city_b") == "") | (F.col("city_a") == F.col("city_b")))).select("s1", "m")


def changed_number_drops(x: DataFrame, pred: DataFrame, sure: float = 0.998) -> DataFrame:
    """Claimed pairs with different house numbers that aren't sure."""
    return pred.join(x.where(~F.col("same_hn") & (F.col("p") < sure)).select("s1", "m"), ["s1", "m"], "left_semi")


def swap_drops(x: DataFrame, pred: DataFrame, vocabulary: Words) -> DataFrame:
    """Claimed pairs at one number where one word was replaced by a word of vocabulary."""
    return pred.join(among(x.where("nd <= 1 and na = 1 and same_hn"), "aw", vocabulary).select("s1", "m"), ["s1", "m"], "left_semi")


def derived_swap_drops(x: DataFrame, pred: DataFrame, suffixes: Words, least: int = 40) -> DataFrame:
    """The same with the words that were dropped least times as vocabulary, but for suffixes and abbreviations of the dropped word."""
    swaps = x.where("nd = 1 and na = 1")
    words = swaps.groupBy(F.col("dw").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    hit = among(not_among(swaps.where("same_hn"), "aw", suffixes), "aw", not_among(words, "word", suffixes)).where(~udf_is_abbreviation("aw", "dw"))
    return pred.join(hit.select("s1", "m"), ["s1", "m"], "left_semi")


def nameonly_adds(x: DataFrame, pred: DataFrame, margin: float, least: float, suffixes: Words | None = None) -> DataFrame:
    """Unclaimed records without an address: the row whose name is ahead of the second one's by margin, with the same words and p of
    least or more, or, with suffixes, with one word more of these."""
    y = x.where("addr_b = ''").withColumn("sim", udf_ratio(F.array_join("words_a", " "), F.array_join("words_b", " ")))
    ahead = best_two(y, "sim", "m").where(F.col("_m1") - F.coalesce("_m2", F.lit(0.0)) >= margin).select("m", F.col("_m1").alias("sim"))
    y = unclaimed(y.join(ahead, ["m", "sim"]), pred)
    if suffixes is None:
        return y.where((F.col("nd") == 0) & (F.col("na") == 0) & (F.col("p") >= least)).select("s1", "m")
    return among(y.where("nd <= 1 and na = 1"), "aw", suffixes).select("s1", "m")


def outside_adds(a: DataFrame, b: DataFrame, scored: DataFrame, suffixes: Words) -> DataFrame:
    """Records without any candidate: exactly one row at their number and street, all numbers equal, legal forms and cities
    compatible, one word more from suffixes."""
    free = b.join(scored.select(F.col("m").alias("id")).distinct(), "id", "left_anti").where("hn is not null and street <> ''")
    j = a.where("hn is not null and street <> ''").select("hn", "street").distinct()
    near = free.join(j, ["hn", "street"], "left_semi").select("hn", "street", F.col("id").alias("m"))
    p = a.where("hn is not null and street <> ''").select("hn", "street", F.col("id").alias("s1")).join(near, ["hn", "street"]).select("s1", "m")
    x = compared(p, a, b).where("nd <= 1 and na = 1 and digits_a = digits_b and (legal_a = '' or legal_b = '' or legal_a = legal_b)")
    return _single(among(x, "aw", suffixes).select("s1", "m"))


def _single(x: DataFrame) -> DataFrame:
    """The pairs of the records that have one."""
    return x.groupBy("m").agg(F.min("s1").alias("s1"), F.count(F.lit(1)).alias("n")).where("n = 1").select("s1", "m")


def shifted_number_adds(x: DataFrame, pred: DataFrame, up_to: int = 100) -> DataFrame:
    """Unclaimed records with a row's words on its street at another number, not one up_to higher, without an exact alternative."""
    same = x.where("nd = 0 and na = 0")
    exact = same.where("same_hn").select("m").distinct()
    delta = F.col("hn_b").cast("long") - F.col("hn_a").cast("long")
    h = unclaimed(same.where("not same_hn and length(hn_a) <= 9 and length(hn_b) <= 9"), pred).join(exact, "m", "left_anti").where("street_a = street_b and street_a <> '' and not (legal_b <> '' and legal_a <> legal_b)")
    return best_of(h.where((delta < 0) | (delta > up_to))).select("s1", "m")


def _places(a: DataFrame) -> DataFrame:
    """a with the number of rows at its place; null without a house number."""
    w = a.groupBy("hn", "street", "city").agg(F.count(F.lit(1)).alias("tenants"))
    return a.join(w, ["hn", "street", "city"], "left")


def _single_word(b: DataFrame) -> DataFrame:
    one = b.where(~F.trim("raw").contains(" ") & (F.trim("raw") != "") & (N.web_host(F.col("raw")) == "")).where("hn is not null and street <> ''")
    return one.withColumn("word", N.compact(F.col("n"))).select(F.col("id").alias("m"), "hn", "street", "city", "word", "unit", "sub", F.col("toks").alias("tb"))


def renamed_adds(a: DataFrame, b: DataFrame, pred: DataFrame) -> DataFrame:
    """Unclaimed records with a name of one word at a place with one row: its initials hold the word, or the word is new to it."""
    j = unclaimed(_single_word(b), pred).join(_places(a).where("tenants = 1").select("hn", "street", "city", F.col("id").alias("s1"), "init", F.col("toks").alias("ta")), ["hn", "street", "city"])
    short = F.length("word").between(2, 5) & F.contains("init", "word")
    new = (F.length("word") >= 5) & ~F.arrays_overlap("ta", "tb")
    return j.where(short | new).select("s1", "m").distinct()


def shared_place_adds(a: DataFrame, b: DataFrame, pred: DataFrame) -> DataFrame:
    """Unclaimed records with a name of one word at a place with several rows: exactly one row's initials hold the word."""
    j = unclaimed(_single_word(b), pred).where(F.length("word").between(2, 5)).join(_places(a).where("tenants >= 2").select("hn", "street", "city", F.col("id").alias("s1"), "init"), ["hn", "street", "city"])
    return _single(j.where(F.contains("init", "word")).select("s1", "m"))


def unit_adds(a: DataFrame, b: DataFrame, pred: DataFrame) -> DataFrame:
    """Unclaimed records with a unit at a place with several rows of which exactly one has that unit and sub-number."""
    left = _places(a).where("tenants >= 2 and unit <> '' and hn is not null and street <> ''").select("hn", "street", "unit", "sub", F.col("id").alias("s1"))
    right = unclaimed(b.where("unit <> '' and hn is not null and street <> ''").select(F.col("id").alias("m"), "hn", "street", "unit", "sub"), pred)
    return _single(right.join(left, ["hn", "street", "unit", "sub"]).select("s1", "m"))


def initials_in_city_adds(a: DataFrame, b: DataFrame, pred: DataFrame) -> DataFrame:
    """Unclaimed records with a name of two to five letters: exactly one row of their number and city has initials that hold it, and
    neither side has a unit or sub-number that the other contradicts."""
    rec = unclaimed(_single_word(b), pred).where(F.length("word").between(2, 5) & (F.col("city") != "")).select("m", "hn", "city", "word", F.col("unit").alias("ub"), F.col("sub").alias("sb"))
    j = rec.join(a.where("city <> '' and hn is not null").select("hn", "city", F.col("id").alias("s1"), "init", F.col("unit").alias("ua"), F.col("sub").alias("sa")), ["hn", "city"])
    agree = lambda x, y: (F.col(x) == "") | (F.col(y) == "") | (F.col(x) == F.col(y))
    return _single(j.where(F.contains("init", "word") & agree("ua", "ub") & agree("sa", "sb")).select("s1", "m").distinct())


def invented_with_legal_adds(a: DataFrame, b: DataFrame, pred: DataFrame, least: int = 4) -> DataFrame:
    """Unclaimed records whose name is one word and legal forms, where no clean row has the word: the only row at their place, if its
    legal forms are the same."""
    words = a.select(F.explode("toks").alias("word")).distinct()
    rec = b.where((F.size("words") == 1) & (F.col("legal") != "") & F.col("hn").isNotNull() & (F.col("street") != "")).select(F.col("id").alias("m"), "hn", "street", "city", "legal", F.col("words")[0].alias("word"))
    rec = unclaimed(rec.where(F.length("word") >= least), pred).join(words, "word", "left_anti")
    return rec.join(_places(a).where("tenants = 1").select("hn", "street", "city", "legal", F.col("id").alias("s1")), ["hn", "street", "city", "legal"]).select("s1", "m").distinct()


def web_names(b: DataFrame) -> DataFrame:
    """(id, handle): the records whose name is a web address, with the letters and digits of its host."""
    return b.select(F.col("id"), N.compact(N.web_host(F.col("raw"))).alias("handle")).where("handle <> ''")


def handle_adds(a: DataFrame, b: DataFrame, pred: DataFrame) -> DataFrame:
    """Unclaimed records whose name is a web address: the only row at their house number whose name, run together, is the handle."""
    rec = unclaimed(web_names(b).join(b.where("hn is not null").select("id", "hn"), "id").withColumnRenamed("id", "m"), pred)
    return _single(rec.join(a.select(F.col("id").alias("s1"), "hn", N.compact(F.col("n")).alias("handle")), ["hn", "handle"]).select("s1", "m").distinct())


def fuzzy_street_adds(a: DataFrame, b: DataFrame, pred: DataFrame, low: float = 85, high: float = 100, rival: float = 60) -> DataFrame:
    """Like renamed_adds where the street is written a little otherwise: a ratio of low to below high to one row, to no other rival."""
    j = unclaimed(_single_word(b), pred).where("city <> ''").withColumnRenamed("street", "sb").join(a.where("city <> '' and street <> ''").select("hn", "city", F.col("street").alias("sa"), F.col("id").alias("s1"), "init", F.col("toks").alias("ta")), ["hn", "city"])
    j = j.withColumn("sr", udf_ratio("sa", "sb"))
    one = j.groupBy("m").agg(F.count_if(F.col("sr") >= rival).alias("n")).where("n = 1").select("m")
    fits = (F.length("word").between(2, 5) & F.contains("init", "word")) | ((F.length("word") >= 5) & ~F.arrays_overlap("ta", "tb"))
    return j.join(one, "m").where((F.col("sr") >= low) & (F.col("sr") < high) & fits).select("s1", "m").distinct()


def safe_adds(low: DataFrame, base: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs of a build with a lower threshold that base lacks, whose row has a name of its own or is alone at its place."""
    names = a.groupBy("country", "words").agg(F.count(F.lit(1)).alias("same"))
    own = _places(a).join(names, ["country", "words"]).where("same = 1 or tenants = 1").select(F.col("id").alias("s1"))
    return low.join(base, ["s1", "m"], "left_anti").join(own, "s1", "left_semi")


def legal_tie(a: DataFrame, b: DataFrame, pred: DataFrame, most_without: int = 2, addressed: bool = False, scored: DataFrame | None = None, gate: float = 0.5) -> DataFrame:
    """Unclaimed records whose words several rows of the country have: the only one with their legal forms. Case A: records without an
    address, where at most most_without of those rows have no form. Case B (addressed): records with an address, whose house number
    that row has too. scored: (s1, m, p), if given, and then only pairs with p of gate or more."""
    k = lambda df: df.withColumn("key", F.array_join("words", " ")).where("key <> ''")
    rows = k(a).select("country", "key", F.col("id").alias("s1"), F.col("legal").alias("la"), F.col("hn").alias("ha"))
    ties = rows.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("la") == "").alias("n0")).where((F.col("n") >= 2) & (F.lit(addressed) | (F.col("n0") <= most_without))).select("country", "key")
    # rows with one legal form among those of equal words: one at most can be the answer
    single = rows.groupBy("country", "key", "la").agg(F.count(F.lit(1)).alias("c"), F.min("s1").alias("s1"), F.min("ha").alias("ha")).where("c = 1 and la <> ''").join(ties, ["country", "key"])
    rec = k(b).where("legal <> '' and addr <> '' and hn is not null" if addressed else "legal <> '' and addr = ''")
    out = unclaimed(rec.select(F.col("id").alias("m"), "country", "key", F.col("legal").alias("la"), F.col("hn").alias("hb")), pred).join(single, ["country", "key", "la"])
    out = (out.where("ha = hb") if addressed else out).select("s1", "m")
    return out if scored is None else out.join(scored.where(F.col("p") >= gate).select("s1", "m").distinct(), ["s1", "m"], "left_semi")


def without_ties(adds: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """adds (s1, m) without those of records that have no address, where several rows of the country have the row's compact name."""
    name = a.select(F.col("id").alias("s1"), "country", N.compact(F.col("n")).alias("ck"))
    tied = name.where("ck <> ''").groupBy("country", "ck").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    bare = b.where("a = ''").select(F.col("id").alias("m"))
    skip = adds.join(bare, "m", "left_semi").join(name, "s1").join(tied, ["country", "ck"], "left_semi").select("s1", "m")
    return adds.join(skip, ["s1", "m"], "left_anti").select("s1", "m")
