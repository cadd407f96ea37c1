"""One form for text that looks the same: compatibility normalisation in composed form, one kind of gap, no default-ignorable
characters, look-alike letters of other scripts as one letter, and full case folding for comparisons that ignore case.

Each distinct value is brought to its form once, however many rows hold it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.session import cut, table

# Letters that are drawn like a Latin one, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеоіјрсухѕһԁԛԝѵ", "ABESIJKMHOPCTXaeoijpcyxshdqwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν", "ABEZHIKMNOPTYXaopv", strict=True))
ARMENIAN = dict(zip("օսոհ", "ounh", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
OTHERS = {"ɡ": "g", "ꓐ": "B", "ꓑ": "P", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"}

_LIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | OTHERS
_TO_CYRILLIC = {b: a for a, b in CYRILLIC.items()}
_TO_GREEK = {b: a for a, b in GREEK.items()}
_LIKE_TABLE = str.maketrans(_LIKE)
#: Compatibility mappings that keep the look: width, no-break forms, ligatures, fonts. A superscript, fraction or circled letter looks otherwise.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}


@lru_cache(1 << 16)
def ignorable(c: str) -> bool:
    """Whether c is default-ignorable: format characters but for the visible prefixed marks, fillers and variation selectors."""
    o = ord(c)
    if unicodedata.category(c) == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= o <= 0xFFFB)
    return o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF


@lru_cache(1 << 16)
def _look(c: str) -> str:
    d = unicodedata.decomposition(c)
    return unicodedata.normalize("NFKC", c) if d.split(" ")[0] in _SAME_LOOK else c


def _clean(s: str) -> str:
    s = "".join(c for c in s if not ignorable(c))
    return " ".join(s.split())  # every kind of white space, as one space


def look(s: str | None) -> str | None:
    """The key of the look of s: equal for two strings just when they are drawn alike; case, accents and punctuation count. None for None."""
    if s is None:
        return None
    if s.isascii():
        return " ".join(s.split())
    s = _clean("".join(map(_look, s)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_LIKE_TABLE))


def _own_script(m: re.Match) -> str:
    w = m[0]
    if any("Ѐ" <= c <= "ԯ" for c in w):
        return "".join(_TO_CYRILLIC.get(c, c) for c in w)
    if any("Ͱ" <= c <= "Ͽ" for c in w):
        return "".join(_TO_GREEK.get(c, c) for c in w)
    return w


def form(s: str | None) -> str | None:
    """s in the form to store: NFKC, one space for any gap, nothing ignorable, and each word in one script: that of its letters
    which no other script has, else Latin. Equal for all strings of one look. None for None, "" for text without visible characters."""
    if s is None:
        return None
    s = look(s)
    if s.isascii():
        return s
    s = re.sub(r"[^\W\d_]+", _own_script, unicodedata.normalize("NFD", s))
    return unicodedata.normalize("NFKC", s)


def fold(s: str | None) -> str | None:
    """The form of s after full case folding: the key under which strings that look alike, and those in another case, meet."""
    return None if s is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", look(s)).casefold())


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("form", "fold")]))
def _forms(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"form": s.map(form, na_action="ignore"), "fold": s.map(fold, na_action="ignore")})


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _looks(s: pd.Series) -> pd.Series:
    return s.map(look, na_action="ignore")


#: In plain ASCII the fold is lower case and single gaps, which compiles.
_ASCII = "^[\\x00-\\x7f]*$"


def folded(c: Column) -> Column:
    """The fold of a column: of ASCII text in the JVM, of other text by one pass over the batch."""
    plain = F.lower(F.trim(F.regexp_replace(c, "[\\x09-\\x0d\\x1c-\\x20]+", " ")))
    return F.when(c.rlike(_ASCII) & ~c.rlike("[\\x00-\\x08\\x0e-\\x1b\\x7f]"), plain).otherwise(_folded(c))


def distinct_values(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").alias("value")).where("value is not null").distinct()


def distinct_forms(df: DataFrame, text: str) -> DataFrame:
    """Each distinct value of df's column text that isn't null, with its form and fold."""
    return distinct_values(df, text).withColumn("f", _forms("value")).select("value", "f.form", "f.fold")


def canonical(df: DataFrame, text: str) -> DataFrame:
    """df with `{text}_form` and `{text}_fold`; null stays null. A value that many rows hold is normalised once, and no row moves
    for its sake: the table of the values is joined to the rows, and a value's rows can be split among tasks."""
    own = f"_{text}_as_stored"
    forms = distinct_forms(df, text).select(F.col("value").alias(own), F.col("form").alias(f"{text}_form"), F.col("fold").alias(f"{text}_fold"))
    return df.join(forms, F.col(f"`{text}`") == F.col(f"`{own}`"), "left").drop(own)


def same_look_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """entity_id_a < entity_id_b: the pairs of rows of df whose text looks the same but is stored in other characters.

    Values are grouped by their fold; only those that share it with another one are then held against each other by their look, for
    the fold takes case away. Only rows whose value has such a partner are joined: many rows of one and the same value cost nothing.
    Null ids or texts are in no pair; repeated ids count once.
    """
    values = cut(distinct_values(df, text).withColumn("fold", folded(F.col("value"))))
    met = values.join(values.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fold"), "fold")
    met = cut(met.withColumn("look", _looks("value")))
    a = met.select(F.col("fold"), F.col("look"), F.col("value").alias("va"))
    b = met.select(F.col("fold"), F.col("look"), F.col("value").alias("vb"))
    pairs = a.join(b, ["fold", "look"]).where("va < vb").select("va", "vb")
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("value")).where("id is not null").distinct()
    left = rows.select(F.col("id").alias("ia"), F.col("value").alias("va"))
    right = rows.select(F.col("id").alias("ib"), F.col("value").alias("vb"))
    both = pairs.join(left, "va").join(right, "vb").where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("entity_id_a"), F.greatest("ia", "ib").alias("entity_id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(table(spark, sf_dir, "test_source1"), "entity_id", "business_name")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(table(spark, sf_dir, "test_source1").select("entity_id", "business_name"), "business_name")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
ORACLES: dict[str, str] = {}
