"""Features of pairs with the texts of both sides, and log-odds of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import similarity as S
from samewise.functions import text as N


def derived(df: DataFrame, side: str) -> DataFrame:
    """(id, …) with the parts of name n and address a that every pair needs, made once for each record, named {part}_{side}."""
    toks, at = N.tokens(F.col("n")), N.tokens(F.col("a"))
    nums = F.filter(at, lambda t: t.rlike("[0-9]"))
    return df.select(
        F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), F.col("a").alias(f"a_{side}"), F.array_join(N.core(toks), " ").alias(f"core_{side}"), N.legal(toks).alias(f"legal_{side}"),
        N.compact(F.col("n")).alias(f"compact_{side}"), N.acronym(N.core(toks)).alias(f"acr_{side}"), nums.alias(f"nums_{side}"), F.try_element_at(nums, F.lit(1)).alias(f"num_{side}"),
        F.array_join(F.filter(at, lambda t: ~t.rlike("[0-9]")), " ").alias(f"words_{side}"), (N.web_host(F.col("raw")) != "").alias(f"web_{side}"), N.clean(N.alias_name(F.col("raw"))).alias(f"alt_{side}"),
    )


def joined(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (q, c) with the derived parts of both sides."""
    return pairs.join(derived(a, "a"), F.col("q") == F.col("id_a")).join(derived(b, "b"), F.col("c") == F.col("id_b")).drop("id_a", "id_b")


def _number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "^([0-9]{1,9})", 1), F.lit("")).cast("double")


def plain_features(x: DataFrame) -> DataFrame:
    """The features that compile: lengths, counts, acronyms, legal forms, first numbers. -1 stands for not applicable."""
    flag = lambda c: c.cast("double")
    na, nb = _number(F.col("num_a")), _number(F.col("num_b"))
    both = F.col("num_a").isNotNull() & F.col("num_b").isNotNull()
    known = na.isNotNull() & nb.isNotNull()
    return x.withColumns({
        "n_acr_a": flag((F.col("acr_a") != "") & (F.col("acr_a") == F.col("compact_b"))), "n_acr_b": flag((F.col("acr_b") != "") & (F.col("acr_b") == F.col("compact_a"))),
        "n_len_a": F.length("n_a").cast("double"), "n_len_b": F.length("n_b").cast("double"), "a_len_a": F.length("a_a").cast("double"), "a_len_b": F.length("a_b").cast("double"),
        "num_count_a": F.size("nums_a").cast("double"), "num_count_b": F.size("nums_b").cast("double"), "legal_eq": flag(F.col("legal_a") == F.col("legal_b")),
        "legal_missing": flag((F.col("legal_a") == "") != (F.col("legal_b") == "")), "b_is_web": flag(F.col("web_b")), "b_addr_empty": flag(F.col("a_b") == ""),
        "num_first_eq": F.when(both, flag(F.col("num_a") == F.col("num_b"))).otherwise(-1.0), "num_first_lev": F.when(both, F.levenshtein("num_a", "num_b").cast("double")).otherwise(-1.0),
        "num_first_lendiff": F.when(both, (F.length("num_b") - F.length("num_a")).cast("double")).otherwise(-1.0),
        "num_first_absdiff": F.when(known, F.log1p(F.abs(na - nb))).otherwise(-1.0), "num_first_signed": F.when(known, F.signum(nb - na) * F.log1p(F.abs(nb - na))),
    })


def fuzzy_features(x: DataFrame) -> DataFrame:
    """The similarities of names and addresses. -1 stands for not applicable."""
    no = F.col("a_b") == ""
    numbered = (F.size("nums_a") > 0) & (F.size("nums_b") > 0)
    x = x.withColumns({"_na": F.array_join("nums_a", " "), "_nb": F.array_join("nums_b", " ")})
    return x.withColumns({
        "n_ratio": S.udf_ratio("core_a", "core_b"), "n_tset": S.udf_token_set("core_a", "core_b"), "n_tsort": S.udf_token_sort("core_a", "core_b"), "n_partial": S.udf_partial("core_a", "core_b"),
        "n_jw": S.udf_jaro_winkler("core_a", "core_b"), "n_clean_tset": S.udf_token_set("n_a", "n_b"), "n_compact_ratio": S.udf_ratio("compact_a", "compact_b"),
        "a_ratio": F.when(no, -1.0).otherwise(S.udf_ratio("a_a", "a_b")), "a_tset": F.when(no, -1.0).otherwise(S.udf_token_set("a_a", "a_b")), "a_tsort": F.when(no, -1.0).otherwise(S.udf_token_sort("a_a", "a_b")),
        "a_words_tset": F.when(no, -1.0).otherwise(S.udf_token_set("words_a", "words_b")), "x_name_in_addr": S.udf_partial("core_b", "a_a"),
        "n_clean_ratio": S.udf_ratio("n_a", "n_b"), "n_compact_partial": S.udf_partial("compact_a", "compact_b"), "n_alt_tset": F.when(F.col("alt_b") == "", -1.0).otherwise(S.udf_token_set("core_a", "alt_b")),
        "a_partial": F.when(no, -1.0).otherwise(S.udf_partial("a_a", "a_b")), "num_tset": F.when(numbered, S.udf_token_set("_na", "_nb")).otherwise(-1.0), "num_first_ratio": F.when(numbered, S.udf_ratio("num_a", "num_b")).otherwise(-1.0),
    }).drop("_na", "_nb").withColumn("sim_mix", (F.col("n_tset") + F.col("a_tset")) / 2)


def route_features(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (s1, m, …) with the features that compile, for scorers of routes: shares of common words, edits, equal numbers, postcodes,
    legal forms and run-together names, initials, lengths, empty addresses. -1 stands for not applicable. a, b: (id, raw, n, a)."""

    def side(df: DataFrame, x: str) -> DataFrame:
        t, at = N.tokens(F.col("n")), N.tokens(F.col("a"))
        parts = {
            "id": F.col("id"), "n": F.col("n"), "a": F.col("a"), "t": F.array_distinct(t), "at": F.array_distinct(F.filter(at, lambda w: ~w.rlike("[0-9]"))), "hn": F.filter(at, lambda w: w.rlike("^[0-9]{1,4}[a-z]?$")),
            "pc": F.filter(at, lambda w: w.rlike("^[0-9]{5,6}$")), "legal": N.legal(t), "cmp": N.compact(F.col("n")), "init": F.array_join(F.transform(t, lambda w: F.substring(w, 1, 1)), ""), "web": N.compact(N.web_host(F.col("raw"))),
        }
        return df.select(*[c.alias(f"{k}_{x}") for k, c in parts.items()])

    x = pairs.join(side(a, "a"), F.col("s1") == F.col("id_a")).join(side(b, "b"), F.col("m") == F.col("id_b"))

    def share(p: str, q: str):
        u = F.size(F.array_union(p, q))
        return F.when(u > 0, F.size(F.array_intersect(p, q)) / u).otherwise(-1.0)

    flag = lambda c: c.cast("double")
    both = lambda p: (F.size(f"{p}_a") > 0) & (F.size(f"{p}_b") > 0)
    like = 1 - F.levenshtein("n_a", "n_b") / F.greatest(F.length("n_a"), F.length("n_b"), F.lit(1))
    x = x.withColumns({
        "n_jac": share("t_a", "t_b"), "a_jac": share("at_a", "at_b"), "n_like": like.cast("double"), "a_like": (1 - F.levenshtein("a_a", "a_b") / F.greatest(F.length("a_a"), F.length("a_b"), F.lit(1))).cast("double"),
        "hn_eq": F.when(both("hn"), flag(F.arrays_overlap("hn_a", "hn_b"))).otherwise(-1.0), "pin_eq": F.when(both("pc"), flag(F.arrays_overlap("pc_a", "pc_b"))).otherwise(-1.0),
        "legal_eq": F.when((F.col("legal_a") != "") & (F.col("legal_b") != ""), flag(F.col("legal_a") == F.col("legal_b"))).otherwise(-1.0), "cmp_eq": flag(F.col("cmp_a") == F.col("cmp_b")), "web_eq": F.when(F.col("web_b") != "", flag(F.col("cmp_a") == F.col("web_b"))).otherwise(-1.0),
        "init_in": flag((F.length("cmp_b") <= 6) & (F.length("cmp_b") >= 2) & F.contains("init_a", "cmp_b")), "a_empty": flag(F.col("a_a") == ""), "b_empty": flag(F.col("a_b") == ""), "n_len_a": flag(F.length("n_a")), "n_len_b": flag(F.length("n_b")),
    })
    return x.drop(*[f"{k}_{s}" for k in ("id", "n", "a", "t", "at", "hn", "pc", "legal", "cmp", "init", "web") for s in "ab"])


def frame(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (q, c, …) with all features of both texts: plain ones, similarities, and the overlaps of the words of names and of
    addresses by inverse document frequencies. a, b: (id, raw, n, a)."""
    from samewise.operators.retrieval import idf_overlap

    x = fuzzy_features(plain_features(joined(pairs, a, b)))
    for c, text in (("n", "n"), ("a", "a")):
        words = [df.select("id", N.tokens(F.col(text)).alias("tokens")) for df in (a, b)]
        o = idf_overlap(pairs.select("q", "c").distinct(), *words).select("q", "c", F.col("widf").alias(f"{c}_widf"), F.col("widf_max").alias(f"{c}_widf_max"), F.col("shared").cast("double").alias(f"{c}_shared"))
        x = x.join(o, ["q", "c"])
    return x


def token_odds(pairs: DataFrame, kind: str, least: int) -> DataFrame:
    """(token, score): of the words that side b has more (extra) or fewer (missing) in labelled near-duplicates (ta, tb, y), the log of
    matches to others, both + 1, against that of all pairs. Words in fewer than least pairs are left out."""
    t = F.array_except("tb", "ta") if kind == "extra" else F.array_except("ta", "tb")
    total = pairs.agg(F.log((F.sum("y") + 1) / (F.count(F.lit(1)) - F.sum("y") + 1)).alias("base"))
    w = pairs.select("y", F.explode(t).alias("token")).where("token <> ''").groupBy("token").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return w.crossJoin(F.broadcast(total)).select("token", (F.log((F.col("pos") + 1) / (F.col("n") - F.col("pos") + 1)) - F.col("base")).alias("score"))  # total: one row


def with_equivalents(odds: DataFrame, equivalents: dict[str, list[str]]) -> DataFrame:
    """odds with the score of a word given to its equivalents in another language that aren't there yet; of several the highest."""
    rows = [(a, b) for a, bs in sorted(equivalents.items()) for b in bs]
    eq = odds.sparkSession.createDataFrame(rows, "token string, other string")  # a word list
    new = odds.join(F.broadcast(eq), "token").groupBy("other").agg(F.max("score").alias("score")).withColumnRenamed("other", "token")
    return odds.unionByName(new.join(odds, "token", "left_anti"))


def decoy_features(pairs: DataFrame, extra: DataFrame, missing: DataFrame) -> DataFrame:
    """pairs (q, c, ta, tb) with the number of extra and missing words and the least and summed score of each kind; unseen words 0."""
    out = pairs.withColumn("extra", F.array_except("tb", "ta")).withColumn("missing", F.array_except("ta", "tb"))
    for kind, odds in (("extra", extra), ("missing", missing)):
        s = out.select("q", "c", F.explode(kind).alias("token")).join(odds, "token").groupBy("q", "c").agg(F.min("score").alias(f"dec_{kind}_min"), F.sum("score").alias(f"dec_{kind}_sum"))
        out = out.join(s, ["q", "c"], "left").withColumn(f"dec_n_{kind}", F.size(kind).cast("double"))
    return out.na.fill(0.0, ["dec_extra_min", "dec_extra_sum", "dec_missing_min", "dec_missing_sum"]).drop("extra", "missing", "ta", "tb")


def feature_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns that are features: all but ids, labels and weights, and none that contains a string of without."""
    out = {"q", "c", "s1", "m", "country", "y", "w", "p", "fold", "src"}
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "tinyint") and c not in out and not any(x in c for x in without)]
