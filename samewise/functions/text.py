"""Normalisation of names and addresses as column expressions, which Spark compiles; one pandas UDF for what it lacks (NFKD)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.functions.translit import romanize

# Letters with accents and their base letters, in order; canonical legal forms; the replacements of the name fold.
ACCENTED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
LEGAL_CANON = {"private": "pvt", "limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co"}
LEGAL_FORMS = ("pvt", "private", "ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "llp", "lp", "plc", "sarl", "sas", "sasu", "eurl", "sci", "sa", "snc", "gmbh", "kg", "ek", "eood")
TITLES = ("mr", "mrs", "ms", "dr", "shri", "sri", "shree", "smt", "messrs", "the", "prof", "mme", "mlle", "and", "of", "et", "de", "du", "des", "la", "le", "les")
STREET_WORDS = {"rd": "road", "street": "st", "str": "st", "saint": "st", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "dr": "drive", "ln": "lane", "pl": "place", "ch": "chemin", "r": "rue", "mg": "marg", "opp": "opposite", "nr": "near", "ste": "suite", "apt": "apartment", "appt": "apartment"}
STREET_TYPES = ("road", "st", "avenue", "boulevard", "drive", "lane", "place", "chemin", "rue", "marg", "cross", "x", "no", "plot", "shop", "de", "du", "la", "sur", "bis", "ter")
#: Literal replacements of the name fold, in order, and the letters that may double.
FOLDS = (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("ou", "u"), ("ksh", "x"), ("ks", "x"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ph", "f"), ("jh", "j"), ("ck", "k"), ("w", "v"), ("z", "j"), ("q", "k"), ("y", "i"))
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, Indic and Cyrillic letters in Latin; null stays null."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", romanize(x)) if not unicodedata.combining(c)), na_action="ignore")


def latin(c: Column) -> Column:
    """Lower case, accents of Latin letters off: the compiled form of nfkd for Western text."""
    low = F.translate(F.lower(c), ACCENTED, BASE)
    return F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def has_indic(c: Column) -> Column:
    return c.rlike("[\\u0900-\\u0D7F]")


def squash(c: Column) -> Column:
    """Runs of anything but letters a-z and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def clean(c: Column) -> Column:
    return squash(latin(c))


def tokens(c: Column) -> Column:
    """The words of a cleaned text; none of ""."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def strip_junk(c: Column) -> Column:
    """Without (ID: n), #nnn, phone numbers and id:n."""
    for p in (r"(?i)\(\s*id\s*[:#]?\s*[0-9]+\s*\)", r"#\s*[0-9]{3,}", r"\+?[0-9][0-9 \-]{8,}[0-9]", r"(?i)\bid\s*[:#]\s*[0-9]+"):
        c = F.regexp_replace(c, p, " ")
    return c


_DBA = r"(?i)^(.*?)\s(?:t/a|d/b/a|dba|trading as|a/k/a|aka|o/a)\s(.*)$"


def trading_name(c: Column) -> Column:
    """Of "X t/a Y", Y; else the whole name."""
    return F.when(c.rlike(_DBA), F.regexp_extract(c, _DBA, 2)).otherwise(c)


def alias_name(c: Column) -> Column:
    """Of "X t/a Y", X; else ""."""
    return F.regexp_extract(c, _DBA, 1)


_WEB = r"^(?:www\.)?([a-z0-9-]+)\.(?:com|in|net|org|co|biz|info|io|fr|us|example)\b"


def web_host(c: Column) -> Column:
    """The label of the host where the name is a web address, hyphens as spaces; else ""."""
    return F.replace(F.regexp_extract(F.lower(F.trim(c)), _WEB, 1), F.lit("-"), F.lit(" "))


#: Legal forms written with dots.
DOTTED = ((r"\bs\.? ?a\.? ?r\.? ?l\b\.?", "sarl"), (r"\bs\.? ?a\.? ?s\.? ?u\b\.?", "sasu"), (r"\bs\.? ?a\.? ?s\b\.?", "sas"), (r"\be\.? ?u\.? ?r\.? ?l\b\.?", "eurl"), (r"\bs\. ?c\. ?i\b\.?", "sci"), (r"\bs\. ?n\. ?c\b\.?", "snc"), (r"\bl\. ?l\. ?c\b\.?", "llc"), (r"\be\. ?k\b\.?", "ek"))


def undotted(c: Column) -> Column:
    """Lower case with dotted legal forms as one word."""
    c = F.lower(c)
    for p, q in DOTTED:
        c = F.regexp_replace(c, p, q)
    return c


def norm(c: Column) -> Column:
    """Decomposed, without marks, lower case, everything but letters and digits of any script as one space."""
    return F.trim(F.regexp_replace(F.lower(_decomposed(c)), "[^\\p{L}\\p{N}]+", " "))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M")), na_action="ignore")


def record_text(n: Column, a: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), n, F.lit(" | "), a)


def block_document(name: Column, alias: Column, address: Column, compact_name: Column) -> Column:
    """The words of a record's document for retrieval: those of name, alias and address, the address's bigrams, and the compact name."""
    own = F.when(compact_name != "", F.array(F.concat(F.lit("cmp_"), compact_name))).otherwise(F.array().cast("array<string>"))
    return F.concat(name, alias, address, bigrams(address), own)


def relation(a: Column, b: Column) -> Column:
    """How two cleaned names are related, the first that fits."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return (
        F.when(b == "", "no name").when(a == b, "same").when(compact(a) == compact(b), "same letters").when((F.size(x) == F.size(y)) & (both == F.size(x)), "same words").when(both == F.size(x), "words added")
        .when(both == F.size(y), "words left out").when(F.levenshtein(a, b) <= 2, "mistyped").when(both > 0, "shares words").otherwise("other")
    )


def with_dictionary(df: DataFrame, column: str, dictionary: DataFrame, new: str) -> DataFrame:
    """df with new: the text of column, its words in Indic scripts that dictionary (native, latin) has replaced, before any rule transcribes
    the rest. Null stays null. The dictionary is joined to the distinct words, so it may be of any size."""
    split = lambda c: F.split(F.lower(c), "(?<=[\\s,.&/()-])|(?=[\\s,.&/()-])")
    texts = df.select(F.col(f"`{column}`").alias("_text")).where(has_indic(F.col("_text"))).distinct()
    parts = texts.select("_text", F.posexplode(split(F.col("_text"))).alias("_i", "native"))
    got = parts.join(dictionary.select("native", "latin"), "native", "left").groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("latin", "native").alias("w")))).alias("_w"))  # words of one text
    got = got.select("_text", F.array_join(F.transform("_w", lambda x: x["w"]), "").alias(new))
    return df.join(got, F.col(f"`{column}`") == F.col("_text"), "left").withColumn(new, F.coalesce(F.col(new), F.col(f"`{column}`"))).drop("_text")


def fix_ocr(t: Column) -> Column:
    """A token's digits as the letters they stand for, if it is a word: two letters or more, two digits at most, more letters than
    digits. Digits, words and ordinals stay; a number glued to a word is split off."""
    digits, letters = F.regexp_replace(t, "[^0-9]", ""), F.regexp_replace(t, "[^a-z]", "")
    word = (F.length(letters) >= 2) & (F.length(digits) <= 2) & (F.length(letters) > F.length(digits))
    return (
        F.when(t.rlike("^[0-9]*$") | t.rlike("^[a-z]*$") | t.rlike("^[0-9]+(st|nd|rd|th|er|e|eme|ere)$"), t)
        .when(t.rlike("^[0-9]{2,}[a-z]{3,}$"), F.concat(F.regexp_extract(t, "^([0-9]+)", 1), F.lit(" "), F.regexp_extract(t, "([a-z]+)$", 1)))
        .when(word, F.translate(t, "0134578", "oleastb"))
        .otherwise(t)
    )


def join_initials(c: Column) -> Column:
    """"s c i" as "sci"."""
    return F.regexp_replace(c, r"\b([a-z]) (?=[a-z]\b)", "$1")


def base_clean(c: Column, unicode: bool = True) -> Column:
    """The whole cleaning: no accents, & as and, no apostrophes, punctuation as spaces, OCR repairs, initials joined. With
    unicode, compatibility forms are decomposed, Indic and Cyrillic transcribed and letters of other scripts kept."""
    x = latin(nfkd(c)) if unicode else latin(c)
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), "['’]", "")
    x = F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " ")) if unicode else squash(x)
    return join_initials(F.array_join(F.transform(tokens(x), fix_ocr), " "))


def merge_fragments(c: Column) -> Column:
    """Pieces that punctuation left: "m s" as ms, "l l c" as llc, "p ltd" as pvt ltd, as whole words."""
    for a, b in ((r"\bm s\b", "ms"), (r"\bl l c\b", "llc"), (r"\bp ltd\b", "pvt ltd")):
        c = F.regexp_replace(c, a, b)
    return c


def core(toks: Column) -> Column:
    """The tokens without legal forms and titles, or all if none is left."""
    left = F.filter(toks, lambda t: ~t.isin(*LEGAL_FORMS, *TITLES))
    return F.when(F.size(left) > 0, left).otherwise(toks)


def _map(t: Column, values: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), t), t)


def legal(toks: Column) -> Column:
    """The legal forms among toks, canonical, distinct, sorted, joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(toks, lambda t: t.isin(*LEGAL_FORMS)), lambda t: _map(t, LEGAL_CANON)))), " ")


def normalize_name(c: Column, unicode: bool = True) -> Column:
    """struct(name_clean, name_core, name_alt, name_legal, name_is_web)."""
    s = strip_junk(F.coalesce(c, F.lit("")))
    host = web_host(s)
    body = merge_fragments(F.when(host != "", host).otherwise(base_clean(trading_name(s), unicode)))
    toks = tokens(body)
    alt = F.filter(tokens(base_clean(alias_name(s), unicode)), lambda t: ~t.isin(*LEGAL_FORMS, *TITLES))
    return F.struct(body.alias("name_clean"), F.array_join(core(toks), " ").alias("name_core"), F.array_join(alt, " ").alias("name_alt"), legal(toks).alias("name_legal"), (host != "").alias("name_is_web"))


def address_tokens(c: Column) -> Column:
    """The tokens of a cleaned address, abbreviations written out, numbers without leading zeros."""
    number = lambda t: F.when(t.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(t)
    return F.transform(tokens(c), lambda t: number(_map(t, STREET_WORDS)))


def normalize_address(c: Column, unicode: bool = True) -> Column:
    """struct(addr_clean, addr_nums, addr_words)."""
    toks = address_tokens(base_clean(F.coalesce(c, F.lit("")), unicode))
    has = lambda t: t.rlike("[0-9]")
    return F.struct(F.array_join(toks, " ").alias("addr_clean"), F.array_join(F.filter(toks, has), " ").alias("addr_nums"), F.array_join(F.filter(toks, lambda t: ~has(t)), " ").alias("addr_words"))


def house_number(c: Column) -> Column:
    """The first number of a cleaned address without leading zeros; null if there is none or only zeros."""
    return F.nullif(F.ltrim(F.regexp_extract(c, "([0-9]+)", 1), F.lit("0")), F.lit(""))


def digits(c: Column) -> Column:
    """All numbers without leading zeros, joined by blanks."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.ltrim(x, F.lit("0"))), " ")


def street_key(c: Column) -> Column:
    """The sorted words, three letters or more and no kind of street, of the part between commas that holds the first number."""
    part = F.coalesce(F.try_element_at(F.filter(F.split(latin(c), ","), lambda x: x.rlike("[0-9]")), F.lit(1)), F.lit(""))
    words = F.filter(tokens(squash(part)), lambda t: ~t.isin(*STREET_TYPES) & ~t.rlike("[0-9]") & (F.length(t) >= 3))
    return F.array_join(F.array_sort(words), " ")


def city(c: Column, cities: list[str]) -> Column:
    """The longest of cities that stands as a word in the address, else null."""
    padded = F.concat(F.lit(" "), F.regexp_replace(clean(c), r"\bst\b", "saint"), F.lit(" "))
    out = F.lit(None).cast("string")
    for name in sorted(cities, key=lambda x: (len(x), x)):
        out = F.when(F.contains(padded, F.lit(f" {name} ")), F.lit(name)).otherwise(out)
    return out


def last_match(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def city_key(c: Column) -> Column:
    """All parts between commas without a digit, cleaned, distinct, sorted, joined by |."""
    parts = F.transform(F.filter(F.split(latin(c), ","), lambda x: ~x.rlike("[0-9]")), lambda x: F.trim(F.regexp_replace(x, "[^a-z]+", " ")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), "|")


def unit_key(c: Column) -> Column:
    """Units ("shop 4", "apt 5"), sorted, joined by |."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"(?:unit|suite|ste|apt|appt|shop|office|lot) (?:no )?[0-9]+"), F.lit(0))), "|")


def sub_number(c: Column) -> Column:
    """bis, ter, quater or a letter a-h behind the first number, else ""."""
    return F.regexp_extract(F.lower(c), "^[^0-9]*[0-9]+ ?(bis|ter|quater|[a-h])(?:[^a-z]|$)", 1)


def compact(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def acronym(toks: Column) -> Column:
    """The initials of two or more tokens, else ""."""
    return F.when(F.size(toks) >= 2, F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def fold_name(c: Column) -> Column:
    """A compact name by its sound: digraphs and doubled letters as one, no vowels after the first letter."""
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, "([a-z])\\1+", "$1")
    return F.concat(F.substring(c, 1, 1), F.regexp_replace(F.substring(c, 2, 1 << 20), "[aeiou]", ""))


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens joined by _."""
    n = F.size(toks)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.element_at(toks, i), F.lit("_"), F.element_at(toks, i + 1)))).otherwise(F.array().cast("array<string>"))


def char_grams(toks: Column, n: int = 3) -> Column:
    """The n-grams inside each token padded by one blank on both sides, repeats kept."""
    padded = F.transform(toks, lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))))


def word_position(toks: Column, word: Column) -> Column:
    """Where word stands among a name's tokens: na, front, appended (behind the first legal form), middle (before it), noleg_last or
    noleg_mid (in a name without one)."""
    at, n = F.array_position(toks, word), F.size(toks)
    forms = F.filter(F.transform(toks, lambda t, i: F.when(t.isin(*LEGAL_FORMS), i + 1)), lambda x: x.isNotNull())
    first = F.try_element_at(forms, F.lit(1))
    return F.when(at == 0, "na").when(at == 1, "front").when(first.isNotNull() & (at > first), "appended").when(first.isNotNull(), "middle").when(at == n, "noleg_last").otherwise("noleg_mid")
