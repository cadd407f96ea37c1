"""Postal addresses: their parts, and which ones denote the same building.

An address is weighed by the 3-grams of its words and its postcode, without unit, floor, landmark and kind of street. Rare grams
weigh more. The heaviest grams of each address, as many as a partner of the least cosine must share one of, are its entries in an
inverted index; entries meet under compatible house numbers, where the grams from the shared one on still allow the cosine.
Candidates are verified by the cosine over all grams, by house number, postcode, and words that contradict each other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm.names import damerau, plain
from samewise.session import staged, table

GRAM, BUCKETS = 3, 1 << 18
LEAST_COSINE = 0.25

# Words of addresses in English, French and German.
STREETS = {
    "street": "street", "st": "street", "str": "street", "road": "road", "rd": "road", "lane": "lane", "ln": "lane", "marg": "marg", "mg": "marg", "avenue": "avenue", "ave": "avenue", "av": "avenue",
    "boulevard": "boulevard", "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard", "drive": "drive", "dr": "drive", "rue": "rue", "r": "rue", "chemin": "chemin", "ch": "chemin", "place": "place", "pl": "place",
    "allee": "allee", "al": "allee", "weg": "weg", "wg": "weg", "platz": "place", "strasse": "street", "court": "court", "ct": "court", "square": "square", "sq": "square", "highway": "highway", "hwy": "highway",
    "cross": "cross", "x": "cross", "main": "main", "route": "route", "impasse": "impasse", "quai": "quai", "gasse": "gasse", "terrace": "terrace", "way": "way",
}
_LONG = ("street", "avenue", "boulevard", "chemin", "strasse", "cross", "drive", "allee", "court", "square", "highway", "impasse", "terrace", "gasse")
_LAND = r"near|nr|opp|opposite|behind|beside|next to|across from|in front of|adjacent to"
_KIND = r"temple|school|cinema|bank|bus stand|bus stop|plaza|mall|park|hospital|church|station|market|hotel"
_LAND_MORE = r"face (?:au|aux|a la|a l)|en face (?:du|de la|des)|pres (?:du|de la|des)|a cote (?:du|de la)|derriere (?:le|la)|devant (?:le|la)|am|an der|beim|bei der|neben (?:dem|der)|hinter (?:dem|der)|vor (?:dem|der)|gegenuber (?:dem|der)"
_KIND_MORE = r"parc|gare|eglise|ecole|marche|mairie|poste|tor|markt|bahnhof|kirche|rathaus|schule|park|post"
_landmarks = re.compile(
    rf"\b(?:{_LAND})\b\.?\s+(?:[^\W\d]+\s+){{1,3}}?(?:{_KIND})\b|\b(?:{_LAND_MORE})\s+(?:{_KIND_MORE})\s+[^\W\d]+(?!\s*\d)|\b(?:residence|hinterhaus|vorderhaus|gegenuber|pres du)\s+[^\W\d]+"
)
_landmark_rest = re.compile(rf"(?:^|[,;]|\s-\s)\s*(?:{_LAND})\b[^,;\d]*?(?=$|[,;]|\s-\s)")
_unit = re.compile(r"\b(?:shop|office|suite|ste|unit|apt|apartment|flat|room|rm|lot|appt|appartement|bat|batiment|whg|wohnung|floor|fl|level|etage|stock)\b\.?\s*(?:no\b\.?|n°|nr\b\.?|#)?\s*\d+[a-z]?\b|\b\d+\s*\.?\s*(?:og|ug|eg|etage|floor|stock|er etage|eme etage)\b")
_pin = re.compile(r"\bpin(?:code)?\b\W*(\d{3})\s?(\d{3})\b")
_post = re.compile(r"\b(\d{5,6})\b")
_mark = re.compile(r"(?:\b(?:h|d|s|p)\s*\.\s*no\b\.?|\b(?:plot|house|door|haus|hse)?\s*no\b\.?|\bnum(?:ero)?\b\.?|n°|\bnr\b\.?|#)\s*(?=\d)")
_mark_left = re.compile(r"\b(?:h|d)\s*\.\s*no\b\.?|\bplot no\b\.?|\bno\b\.?|#")
_range = re.compile(r"(?<![\w])0*(\d+)[-–]0*(\d+)(?![\w])")
_house = re.compile(r"(?<![\w])0*(\d+)\s?(bis|ter|quater)?(?![\w])|(?<![\w])0*(\d+)([a-z])(?![\w])")
#: A span of house numbers that takes in more is no building.
_SPAN = 40
_german = re.compile(r"\b([^\W\d_]{3,}?)(strasse|str|allee|al|weg|wg|platz|pl)\b\.?(?=\s*\d)")
_GERMAN = {"str": "strasse", "al": "allee", "wg": "weg", "pl": "platz"}
_LITTLE = {"de", "du", "des", "la", "le", "les", "sur", "the", "no", "pin", "and", "d", "h", "to", "at", "of"}
COUNTRIES = {"india", "us", "usa", "france", "germany", "deutschland", "canada", "kenya", "brazil", "brasil", "bulgaria", "nepal", "belgium", "belgique", "fiji", "malta", "uk"}


class Address(tuple):
    """(house number with suffix, or first and last joined by -, or None; postcode or None; kinds of street; words in order)."""

    __slots__ = ()
    house = property(lambda self: self[0])
    post = property(lambda self: self[1])
    kinds = property(lambda self: self[2])
    words = property(lambda self: self[3])


def numbers(house: str) -> list[str]:
    """The house numbers that house stands for: itself, or all from the first to the last."""
    lo, _, hi = house.partition("-")
    return [str(k) for k in range(int(lo), int(hi) + 1)] if hi else [house]


def same_house(a: str, b: str) -> bool:
    """Whether two house numbers are compatible: equal, or one lies in the other's span."""
    return a == b or (("-" in a or "-" in b) and bool(set(numbers(a)) & set(numbers(b))))


@lru_cache(1 << 15)
def _mistyped(t: str) -> str | None:
    """The kind of street that t is with one slip."""
    return next((STREETS[k] for k in _LONG if damerau(t, k, 1) <= 1), None)


def squeeze(w: str) -> str:
    """w with doubled letters as one."""
    return re.sub(r"(.)\1+", r"\1", w)


def _postcode(s: str) -> re.Match | None:
    """The number of five or six digits that is the postcode: the last one, unless it is the address's only number and a street's
    name and kind follow it, which makes it the house number."""
    found = list(_post.finditer(s))
    if not found:
        return None
    m = found[-1]
    if len(found) == 1 and not _house.search(s[: m.start()] + " , " + s[m.end() :]):
        street = re.match(r"\s+[^\d,;]*?([^\W\d]+)\.?\s*(?:[,;]|$)", s[m.end() :])
        if street and street[1] in STREETS:
            return None
    return m


@lru_cache(1 << 14)
def parse(raw: str | None) -> Address:
    """The parts of raw; a null, empty or blank one has none."""
    if not raw or not raw.strip():
        return Address((None, None, frozenset(), ()))
    s = plain(raw).replace("’", "'").replace("'", " ")
    s = re.sub(r"\s+", " ", s)
    s = _landmarks.sub(" , ", s)
    s = _landmark_rest.sub(" , ", s) if re.search(r"[,;]|\s-\s", s) else s
    s = _unit.sub(" , ", s)
    post = None
    if m := _pin.search(s):
        post, s = m[1] + m[2], s[: m.start()] + " , " + s[m.end() :]
    elif m := _postcode(s):
        post, s = m[1], s[: m.start()] + " , " + s[m.end() :]
    s = _mark.sub(" ", s)
    s = _german.sub(lambda m: m[1] + " " + _GERMAN.get(m[2], m[2]), s)
    house = None
    if (m := _range.search(s)) and int(m[1]) < int(m[2]) <= int(m[1]) + _SPAN:
        house, s = f"{m[1]}-{m[2]}", s[: m.start()] + " " + s[m.end() :]
    elif m := _house.search(s):
        house = (m[1] or m[3]) + (m[2] or m[4] or "")
        s = s[: m.start()] + " " + s[m.end() :]
    s = _mark_left.sub(" ", s)
    kinds, words = set(), []
    for t in re.findall(r"[^\W\d_]+", s):
        if t in STREETS:
            kinds.add(STREETS[t])
        elif len(t) >= 5 and (k := _mistyped(t)):
            kinds.add(k)
        elif t not in _LITTLE and t not in COUNTRIES:
            words.append(t)
    return Address((house, post, frozenset(kinds), tuple(words)))


def grams(a: Address) -> list[int]:
    """The buckets of the address's grams, each once."""
    out = {zlib.crc32(("p" + a.post).encode()) % BUCKETS} if a.post else set()
    for w in a.words:
        w = f"_{squeeze(w)}_"
        out.update(zlib.crc32(w[i : i + GRAM].encode()) % BUCKETS for i in range(max(1, len(w) - GRAM + 1)))
    return sorted(out)


def ranked(buckets: list[int], weight: np.ndarray, least: float) -> tuple[list[int], list[float]]:
    """The heaviest buckets, as many that the rest has a norm below least of the whole: whoever has a cosine of least shares one. With
    each, the squared weights from it on."""
    b = np.asarray(buckets, dtype=np.int64)
    if not len(b):
        return [], []
    b = b[np.lexsort((b, -weight[b]))]
    mass = np.cumsum(weight[b][::-1].astype(float) ** 2)[::-1]  # of each and all lighter ones
    keep = mass >= least * least * mass[0] * (1 - 1e-9)
    return b[keep].tolist(), mass[keep].tolist()


def prefix(buckets: list[int], weight: np.ndarray, least: float) -> list[int]:
    return ranked(buckets, weight, least)[0]


def cosine(x: list[int], y: list[int], weight: np.ndarray) -> float:
    wx, wy = sum(weight[b] ** 2 for b in x), sum(weight[b] ** 2 for b in y)
    both = sum(weight[b] ** 2 for b in set(x) & set(y))
    return float(both / math.sqrt(wx * wy)) if wx and wy else 0.0


@lru_cache(1 << 16)
def word_near(a: str, b: str) -> bool:
    """Whether a and b can be one word mistyped: within the edits for the shorter one, as written or with doubled letters as one."""
    if a == b:
        return True
    for x, y in ((a, b), (squeeze(a), squeeze(b))):
        n = min(len(x), len(y))
        if x == y or (n >= 4 and damerau(x, y, 1 if n < 7 else 2) <= (1 if n < 7 else 2)):
            return True
    return False


def leftovers(x: tuple[str, ...], y: tuple[str, ...]) -> tuple[int, list[str], list[str]]:
    """How many words of x and y are the same, and those of either that the other lacks; split words are put together."""
    used, same, left = set(), 0, []
    for w in x:
        j = next((j for j, v in enumerate(y) if j not in used and w == v), None)
        if j is None:
            j = next((j for j, v in enumerate(y) if j not in used and word_near(w, v)), None)
        if j is None:
            left.append(w)
        else:
            used.add(j)
            same += 1
    right = [v for j, v in enumerate(y) if j not in used]
    for a, b in ((left, right), (right, left)):
        for i in range(len(a) - 1):
            whole = a[i] + a[i + 1]
            j = next((j for j, v in enumerate(b) if word_near(whole, v)), None)
            if j is not None:
                same += 1
                a[i : i + 2] = []
                del b[j]
                break
    return same, left, right


def within(x: Address, y: Address) -> bool:
    """Whether x says nothing that y doesn't: all its words, its number and its postcode are in y."""
    return x.house == y.house and (x.post is None or x.post == y.post) and not leftovers(x.words, y.words)[1]


SAME, OTHER, PERHAPS = 1, 0, 2


def compare(x: Address, y: Address) -> int:
    """Whether two addresses with a high cosine can be one building: a compatible house number and suffix, no two postcodes, at least
    the street in common, and no words on both sides that the other lacks unless the postcode settles the place. PERHAPS: only
    the street is in common, and one side has a postcode where the other has further words, which may be its city or not."""
    if x.house is None or y.house is None or not same_house(x.house, y.house):
        return OTHER
    if x.post and y.post and x.post != y.post:
        return OTHER
    if x.kinds and y.kinds and not (x.kinds & y.kinds):
        return OTHER
    same, left, right = leftovers(x.words, y.words)
    if not same:
        return OTHER
    left, right = [w for w in left if len(w) > 2], [w for w in right if len(w) > 2]
    if x.post and x.post == y.post:
        return SAME if len(left) + len(right) <= 2 or not (left and right) else OTHER
    if left and right:
        return OTHER
    if same >= 2:
        return SAME
    return PERHAPS if (x.post and right and not y.post) or (y.post and left and not x.post) else OTHER


def same_building(x: Address, y: Address) -> bool:
    return compare(x, y) == SAME


def weights(buckets: DataFrame, n: int) -> np.ndarray:
    """The root of ln(1 + n / df) of each bucket, from all addresses; what comes to the driver are BUCKETS counts at most."""
    df = np.zeros(BUCKETS)
    for r in buckets.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r["b"]] = r["n"]
    return np.sqrt(np.log1p(n / np.maximum(df, 1))).astype(np.float32)


def parts(addresses: DataFrame) -> DataFrame:
    """(addr) with houses (one, or those of a span), post, words and buckets, those without a house number left out; place has what an
    Address is made of again, so that it is parsed once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, numbers(p.house), p.post, sorted({squeeze(w) for w in p.words}), grams(p), _packed(p)) for a in pdf["addr"] for p in [parse(a)] if p.house is not None and p.words]
            yield pd.DataFrame(rows, columns=["addr", "houses", "post", "words", "buckets", "place"])

    return addresses.mapInPandas(read, "addr string, houses array<string>, post string, words array<string>, buckets array<int>, place string")


def _packed(p: Address) -> str:
    """p as a text; none of its parts has a blank or a line's end."""
    return "\n".join((p.house or "", p.post or "", " ".join(sorted(p.kinds)), " ".join(p.words)))


def _unpacked(place: str) -> Address:
    house, post, kinds, words = place.split("\n")
    return Address((house or None, post or None, frozenset(kinds.split()), tuple(words.split())))


def address_pairs(addresses: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(aa, ab): pairs of distinct addresses, aa < ab, that denote the same building: those that pass the check, those that would but
    for a postcode that some address has with the other's city, and two that are both parts of one fuller address. addresses:
    distinct, in column addr."""
    known = staged(parts(addresses).withColumn("aid", F.monotonically_increasing_id()), "addresses")
    weight = known.sparkSession.sparkContext.broadcast(weights(known, known.count()))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ranked(list(b), weight.value, least) for b in pdf["buckets"]]
            x = pdf[["aid", "houses", "post"]].assign(g=[b for b, _ in got], rest=[m for _, m in got], total=[m[0] for _, m in got])
            yield x.explode(["g", "rest"]).dropna(subset="g").astype({"g": "int32", "rest": "float64"})

    entries = known.mapInPandas(index, "aid long, houses array<string>, post string, g int, rest double, total double")
    entries = staged(entries.select("aid", F.explode("houses").alias("house"), "post", "g", "rest", "total"), "entries")
    cols = ("aid", "post", "rest", "total")
    side = lambda x, rows: entries.where(rows).select("house", "g", *([F.col("post").alias("p")] if rows == "post is not null" else []), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    # At the first gram that two addresses share, what both have from it on bounds their cosine: pairs that can't reach least, and most
    # repetitions of a pair at later grams, never leave the join.
    bound = F.least("rest_a", "rest_b") >= F.lit(least * (1 - 1e-6)) * F.sqrt(F.col("total_a") * F.col("total_b"))
    # Two postcodes must be equal, so they are part of the key: only entries without one meet all of their house number and gram.
    placed = side("a", "post is not null").join(side("b", "post is not null"), ["house", "g", "p"]).where("aid_a < aid_b")
    open_ends = side("a", "post is null").join(side("b", "true"), ["house", "g"]).where("post_b is not null or aid_a < aid_b")
    pair = [F.least("aid_a", "aid_b").alias("ia"), F.greatest("aid_a", "aid_b").alias("ib")]
    met = reduce(DataFrame.unionByName, [staged(x.where(bound).select(*pair).distinct(), name) for x, name in ((placed, "placed_pairs"), (open_ends, "open_pairs"))])
    left, right = (known.select(F.col("aid").alias(f"i{n}"), F.col("addr").alias(f"x{n}"), F.col("place").alias(f"p{n}")) for n in "ab")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, t, x, y in zip(pdf["xa"], pdf["xb"], pdf["pa"], pdf["pb"]):
                (s, x), (t, y) = ((s, x), (t, y)) if s < t else ((t, y), (s, x))
                x, y = _unpacked(x), _unpacked(y)
                got = compare(x, y)
                if got == OTHER or cosine(grams(x), grams(y), weight.value) < least:
                    continue
                post, cities = None, []
                if got == PERHAPS:
                    post = x.post or y.post
                    _, left, right = leftovers(x.words, y.words)
                    cities = sorted({squeeze(w) for w in left + right if len(w) > 2})
                out.append((s, t, *((s, t) if within(x, y) else (t, s) if within(y, x) else (None, None)), post, cities))
            yield pd.DataFrame(out, columns=["aa", "ab", "part", "full", "post", "cities"])

    found = met.join(left, "ia").join(right, "ib").select("xa", "xb", "pa", "pb").mapInPandas(check, "aa string, ab string, part string, full string, post string, cities array<string>")
    found = staged(found, "found")
    open_ = found.where("post is not null").select("aa", "ab", "post", F.explode("cities").alias("city"))
    cities = known.where("post is not null").select("post", F.explode("words").alias("city")).distinct()
    direct = found.where("post is null").select("aa", "ab")
    parts_of = found.where("post is null and full is not null")
    both = parts_of.select("full", F.col("part").alias("aa")).join(parts_of.select("full", F.col("part").alias("ab")), "full").where("aa < ab").select("aa", "ab")
    return direct.unionByName(open_.join(cities, ["post", "city"]).select("aa", "ab")).unionByName(both).distinct()


def building_pairs(df: DataFrame, ident: str, address: str, least: float = LEAST_COSINE) -> DataFrame:
    """entity_id_a < entity_id_b: pairs of rows of df whose address denotes the same building, written alike or not.

    Addresses are compared once for each distinct pair; rows that share one are joined by it. An address without a house number is
    in no pair, nor is a null or empty one; repeated rows count once.
    """
    rows = staged(df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{address}`").alias("addr")).where("id is not null and addr is not null").distinct(), "placed")
    distinct = rows.select("addr").distinct()
    pairs = address_pairs(distinct, least)
    left, right = rows.select(F.col("id").alias("ia"), F.col("addr").alias("aa")), rows.select(F.col("id").alias("ib"), F.col("addr").alias("ab"))
    unlike = pairs.join(left, "aa").join(right, "ab").select("ia", "ib")
    houses = distinct.join(rows.groupBy("addr").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "addr")
    full = parts(houses.select("addr")).select(F.col("addr").alias("aa"))
    alike = full.join(left, "aa").join(right.withColumnRenamed("ab", "aa"), "aa").where("ia < ib").select("ia", "ib")
    both = unlike.unionByName(alike).where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("entity_id_a"), F.greatest("ia", "ib").alias("entity_id_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building_pairs(table(spark, sf_dir, "test_source1"), "entity_id", "business_address")


QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}
