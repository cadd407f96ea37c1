"""Variant spellings of organisations' names.

Distinct names are indexed under their proper words, alone however short, as full names and run together, each with the strings that deleting up to two letters
leaves (symmetric deletes): two words within that many edits share one. Names that meet there are compared by the best assignment
of their tokens, which may be mistyped, shortened, initials or nicknames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm.names import FULL, Name, damerau, edits_allowed, parse, same_organisation
from samewise.session import shuffled, staged, table, width

#: Tokens in more than this share of the distinct names are common: at most (tokens of a name) / COMMON_SHARE of them, some thousands.
COMMON_SHARE, COMMON_LEAST = 0.002, 12
_KEY = 6


def deletes(s: str, most: int) -> set[str]:
    """s and what is left of it after up to most deletions, two at most."""
    out, n = {s}, len(s)
    if most > 0:
        out.update([s[:i] + s[i + 1 :] for i in range(n)])
    if most > 1:
        for i in range(n - 1):
            head = s[:i]
            out.update([head + s[i + 1 : j] + s[j + 1 :] for j in range(i + 1, n)])
    return out


#: Words longer than this are cut into pieces instead of losing letters, for deletions grow with the square of the length.
LONG, _PIECES = 40, 5


def neighbours(w: str, most: int) -> set[str]:
    """Strings of which two words share one if at most `most` edits lie between them: what deletions leave, or of a long word all the
    places where one of five pieces of a word so like it may stand (two edits, swaps included, touch four of them at most)."""
    out = deletes(w, most) if len(w) <= LONG else {w}
    if len(w) > LONG - 2:
        for n in range(len(w) - most, len(w) + most + 1):  # the other word's length
            at = [n * i // _PIECES for i in range(_PIECES + 1)]
            for i in range(_PIECES):
                for shift in range(-most, most + 1):
                    start, size = at[i] + shift, at[i + 1] - at[i]
                    if 0 <= start and start + size <= len(w):
                        out.add(f"{n}/{i}/{w[start : start + size]}")
    return out


def keys(tokens: tuple[str, ...], common: set[str] | frozenset[str]) -> set[str]:
    """The words under which a name is found: its proper words of six letters or more, neighbouring proper words run together, and,
    of a name without any, all its tokens in order of the alphabet."""
    out, run = set(), []
    for t in [*tokens, ""]:
        if t and t not in common:
            run.append(t)
            if len(t) >= _KEY:
                out.add(t)
            continue
        for i in range(len(run)):
            for j in range(i + 2, min(i + 4, len(run) + 1)):
                out.add("".join(run[i:j]))
        run = []
    return out or ({" ".join(sorted(tokens))} if tokens else set())


def every_key(tokens: tuple[str, ...], common: set[str] | frozenset[str]) -> set[str]:
    """keys() and every proper word however short, nicknames also as the full name: names of short words may be reordered, shortened
    to initials or without their trade. A proper word is in fewer than COMMON_SHARE of the names, so none of them is left out."""
    out = keys(tokens, common) | {t for t in tokens if t not in common}
    for t in tokens:
        for full in FULL.get(t, ()):
            rest = [full if x == t else x for x in tokens]
            out |= {full} if full not in common else keys(tuple(rest), common)
    return out


def parsed(names: DataFrame) -> DataFrame:
    """(name) with what same_organisation looks at, so that it is parsed once: tokens, legal forms, whether Indic and whether a web name."""

    def parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, list(n.tokens), sorted(n.legal), n.indic, n.web) for s in pdf["name"] for n in [parse(s)]]
            yield pd.DataFrame(rows, columns=["name", "tokens", "legal", "indic", "web"])

    return names.mapInPandas(parse_all, "name string, tokens array<string>, legal array<string>, indic boolean, web boolean")


def common_tokens(names: DataFrame) -> frozenset[str]:
    """The tokens that so many of the distinct names have that they tell of a trade or title, not of one organisation. At most the
    mean number of tokens divided by COMMON_SHARE, whatever the number of names."""
    n = names.count()
    least = max(COMMON_LEAST, COMMON_SHARE * n)
    df = names.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return frozenset(r["t"] for r in df.select("t").toLocalIterator())


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): words within the edits allowed for their length, each with itself too. words: distinct, in column w."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in (pdf["w"].iloc[i : i + 500] for i in range(0, len(pdf), 500)):
                rows = [(d, w) for w in part for d in neighbours(w, edits_allowed(len(w)))]
                yield pd.DataFrame(rows, columns=["d", "w"])

    index = words.repartition(4 * width(words.sparkSession)).mapInPandas(spread, "d string, w string").select(F.xxhash64("d").alias("d"), "w")
    a, b = index.select("d", F.col("w").alias("a")), index.select("d", F.col("w").alias("b"))
    met = a.join(shuffled(b), "d").where("a < b").select("a", "b").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [damerau(x, y, e) <= e for x, y in zip(pdf["a"], pdf["b"]) for e in [edits_allowed(min(len(x), len(y)))]]
            yield pdf[pd.Series(ok, index=pdf.index, dtype=bool)]

    return met.mapInPandas(check, "a string, b string").unionByName(words.select(F.col("w").alias("a"), F.col("w").alias("b")))


def name_pairs(names: DataFrame) -> DataFrame:
    """(va, vb): pairs of distinct names, va < vb, that mean the same organisation. names: distinct, not null, in column name."""
    spark = names.sparkSession
    split = staged(parsed(names), "split")
    common = spark.sparkContext.broadcast(common_tokens(split))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, k) for n, t in zip(pdf["name"], pdf["tokens"]) for k in every_key(tuple(t), common.value)]
            yield pd.DataFrame(rows, columns=["name", "w"])

    keyed = staged(split.mapInPandas(index, "name string, w string"), "keyed")
    near = near_words(keyed.select("w").distinct())
    left, right = keyed.select(F.col("name").alias("na"), F.col("w").alias("a")), keyed.select(F.col("name").alias("nb"), F.col("w").alias("b"))
    met = near.join(shuffled(left), "a").join(shuffled(right), "b").where("na <> nb").select(F.least("na", "nb").alias("va"), F.greatest("na", "nb").alias("vb")).distinct()

    def check(slack: int):
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sides = [[Name((tuple(t), frozenset(g), i, w, "", "")) for t, g, i, w in zip(*(pdf[f"{c}{n}"] for c in ("t", "g", "i", "w")))] for n in "ab"]
                ok = [same_organisation(x, y, common.value, slack) for x, y in zip(*sides)]
                yield pdf.loc[pd.Series(ok, index=pdf.index, dtype=bool), ["va", "vb"]]

        return one

    def same(pairs: DataFrame, slack: int) -> DataFrame:
        for n in "ab":
            side = split.select(F.col("name").alias(f"v{n}"), F.col("tokens").alias(f"t{n}"), F.col("legal").alias(f"g{n}"), F.col("indic").alias(f"i{n}"), F.col("web").alias(f"w{n}"))
            pairs = pairs.join(shuffled(side), f"v{n}")
        return pairs.mapInPandas(check(slack), "va string, vb string")

    direct = staged(same(met, 0), "direct")
    # Two writings of a third one: their slips add up.
    ends = direct.select(F.col("va").alias("mid"), F.col("vb").alias("end")).unionByName(direct.select(F.col("vb").alias("mid"), F.col("va").alias("end")))
    two = ends.select("mid", F.col("end").alias("va")).join(shuffled(ends.select("mid", F.col("end").alias("vb"))), "mid").where("va < vb").select("va", "vb").distinct()
    further = same(two.join(shuffled(direct), ["va", "vb"], "left_anti"), 2)
    return direct.unionByName(further)


def variant_pairs(df: DataFrame, ident: str, name: str) -> DataFrame:
    """entity_id_a < entity_id_b: pairs of rows of df whose name means the same organisation but isn't stored as the same string.

    Names are compared once for each distinct pair, so a name that many rows hold costs no more than any other. Null names and
    ids are in no pair, nor are names without a letter or digit; repeated rows count once.
    """
    rows = staged(df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{name}`").alias("name")).where("id is not null and name is not null").distinct(), "named")
    pairs = name_pairs(rows.select("name").distinct())
    left, right = rows.select(F.col("id").alias("ia"), F.col("name").alias("va")), rows.select(F.col("id").alias("ib"), F.col("name").alias("vb"))
    both = pairs.join(shuffled(left), "va").join(shuffled(right), "vb").where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("entity_id_a"), F.greatest("ia", "ib").alias("entity_id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "test_source1"), "entity_id", "business_name")


QUERIES = {"p6_found": p6_found}
ORACLES: dict[str, str] = {}
