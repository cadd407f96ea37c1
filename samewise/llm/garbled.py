"""Text that was decoded with the wrong character encoding: found and restored.

A stretch (sentence or line) has a latent encoding chain: none, or "written in A, read as B". What a chain explains is judged by a
model of characters between their neighbours, fitted to the corpus itself. Expectation-maximization alternates: the chains'
posteriors of every stretch, from the model, the shares of the chains in its source and field (quoted or own text) and the other
stretches of its record; then shares and model anew from the posteriors, so that weak evidence is pooled over all records, until
the shares stand still. Text that was garbled twice is repaired twice.

The corpus is read once for this: what remains of a text are the runs of characters beyond ASCII with their neighbours' classes,
alike ones of a source counted together; the rounds go over these counts. Plain ASCII texts never reach the judging pass.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.session import staged, table, width

#: Charsets that UTF-8 text is read as, and pairs of single-byte charsets (written in, read as).
UTF8_READ_AS = ("cp1252", "latin1", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "cp1250", "cp1253", "iso8859_15")
SINGLE = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"))
MULTI = ("gbk",)
LOST = "lost"
CHAINS = (*(f"utf8>{c}" for c in UTF8_READ_AS), *(f"utf8>{c}" for c in MULTI), *(f"{a}>{b}" for a, b in SINGLE), LOST)
_CYRILLIC = ("cp1251>", "koi8_r>")
_PRIOR = 1e-3  # of each chain, before any record was seen
_TEMPER = 0.5  # neighbours on both sides tell of the same character
#: The rounds end when no chain's share of all stretches moves by more than CLOSE, a tenth of the share a chain has to begin with.
CLOSE, _ROUNDS = _PRIOR / 10, 50
_LEAST_GAIN = -12.0  # a chain that makes a stretch e^12 times less likely has a posterior below 1e-5 whatever its share
_STRETCH, _PART, _FIELD = "\x1e", "\x1f", "\x1d"

_run = re.compile(r"[^\x00-\x7f]+")
#: Entities of characters beyond ASCII, other than spaces: garbled text may have been escaped after it was garbled.
_entity = re.compile(r"&(?!nbsp;|ensp;|emsp;|thinsp;)([A-Za-z]{2,8}\d{0,2});")
_stretch = re.compile(r"[^\n<\[]*?(?:[.!?…]+[\s]+|\n|(?=[<\[])|$)|[<\[]", re.S)
_quoted_line = re.compile(r"^[ \t]*>.*$", re.M)
_quote = re.compile(r"(\[quote|<blockquote)|(\[/quote\]|</blockquote>)", re.I)
#: What a text needs to be looked at by the judging pass, for Spark's regular expressions.
SUSPECT = r"[^\x00-\x7f]|&[A-Za-z]{2,8}[0-9]{0,2};"


def _table(charset: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)  # decoders that let undefined bytes pass give the control character
    return out


@lru_cache(None)
def _inverse(chain: str):
    """A function that repairs a run of non-ASCII characters; what the chain can't have made stays."""
    a, _, b = chain.partition(">")
    if chain == LOST:
        return lambda r: r
    if b == "gbk":

        def wide(r: str) -> str:
            def one(m: re.Match) -> str:
                try:
                    raw = m[0].encode("gb18030" if "�" not in m[0] else "gbk", "strict")
                    return raw.decode("utf-8")
                except UnicodeError:
                    return m[0]

            return re.sub(r"[一-鿿⺀-〿＀-￯]+", one, r)

        return wide
    there = _table(b)
    if a != "utf8":
        pairs = {}
        for c, byte in there.items():
            try:
                pairs[ord(c)] = bytes([byte]).decode(a)
            except UnicodeDecodeError:
                pass
        return lambda r: r.translate(pairs)
    of = lambda lo, hi: "".join(re.escape(c) for c, x in there.items() if lo <= x <= hi)
    more = f"[{of(0x80, 0xBF)}]"
    pattern = re.compile(f"[{of(0xC2, 0xDF)}]{more}|[{of(0xE0, 0xEF)}]{more}{{2}}|[{of(0xF0, 0xF4)}]{more}{{3}}")

    def one(m: re.Match) -> str:
        try:
            return bytes(there[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return lambda r: pattern.sub(one, r)


@lru_cache(1 << 16)
def symbol(c: str) -> str:
    """c itself, or for the large scripts the start of its block of 128: at most some 5,500 symbols."""
    o = ord(c)
    return c if o < 0x530 or 0x1E00 <= o < 0x3000 or 0xFFF0 <= o else f"U{o >> 7:x}"


@lru_cache(1 << 16)
def kind(c: str) -> str:
    """The class of a neighbour: letters by base letter and case, other characters by what they are; below 100 classes."""
    if c == "":
        return "^"
    if c.isascii():
        return c.lower() if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else c if c.isprintable() else "c"
    base = unicodedata.normalize("NFD", c)[0]
    if base.isascii() and base.isalpha():
        return base if base.islower() else "A"
    if "Ѐ" <= c <= "ӿ":
        return "я" if c.islower() else "Я"
    if "Ͱ" <= c <= "Ͽ":
        return "ω"
    return "~" + unicodedata.category(c)


class Model:
    """log P(character | class of the left neighbour) + log P(character | class of the right one), by counts, with symbols' overall
    shares for unseen pairs."""

    def __init__(self, pairs: dict[tuple[str, str, str], float], kinds: dict[str, float]):
        self.pairs, self.kinds = pairs, kinds
        self.total = max(1.0, sum(kinds.values()))
        self.share: Counter = Counter()
        for (side, _, x), n in pairs.items():
            if side == "l":
                self.share[x] += n
        self.memo: dict = {}
        self.seen: dict[tuple[str, str, str], float] = {}

    def one(self, side: str, k: str, x: str) -> float:
        if (got := self.seen.get((side, k, x))) is None:
            got = self.seen[side, k, x] = self._one(side, k, x)
        return got

    def _one(self, side: str, k: str, x: str) -> float:
        base = (self.share.get(x, 0.0) + 0.02) / (self.total + 1)
        return math.log((self.pairs.get((side, k, x), 0.0) + 20 * base) / (self.kinds.get(k, 0.0) + 20))

    def score(self, left: str, run: str, right: str) -> float:
        out, before = 0.0, left
        for i, c in enumerate(run):
            if c.isascii():
                before = kind(c)
                continue
            after = kind(run[i + 1]) if i + 1 < len(run) else right
            x = symbol(c)
            out += self.one("l", before, x) + self.one("r", after, x)
            before = kind(c)
        return _TEMPER * out

    def gains(self, left: str, run: str, right: str) -> list[tuple[int, float, str]]:
        """Of each chain that changes run: its number, how much likelier it makes the run, and the repaired run."""
        key = (left, run, right)
        if key not in self.memo:
            if len(self.memo) > 1 << 18:
                self.memo.clear()
            plain, seen, out = None, {}, []
            for j, fixed in changes(run):
                if CHAINS[j] == LOST:
                    out.append((j, 60.0, run))
                    continue
                plain = self.score(left, run, right) if plain is None else plain
                if fixed not in seen:
                    seen[fixed] = self.score(left, fixed, right) - plain
                out.append((j, seen[fixed], fixed))
            self.memo[key] = out
        return self.memo[key]


@lru_cache(1 << 17)
def changes(run: str) -> tuple[tuple[int, str], ...]:
    """Of each chain that changes run and can have made it, its number and the repaired run. No model is needed for that, so a worker
    keeps them from round to round."""
    out = []
    for j, chain in enumerate(CHAINS):
        if chain == LOST:
            if "\ufffd" in run:
                out.append((j, run))
            continue
        fixed = _inverse(chain)(run)
        if chain.startswith(_CYRILLIC) and not any("Ѐ" <= c <= "ӿ" for c in fixed):
            continue  # who writes in a Cyrillic charset writes Cyrillic letters
        if fixed != run and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs") for c in fixed if c not in run):
            out.append((j, fixed))
    return tuple(out)


def unescape(t: str) -> str:
    """Named entities beyond ASCII as characters."""
    return _entity.sub(lambda m: c if (c := html.unescape(m[0])) and not c.isascii() else m[0], t) if "&" in t else t


def stretches(t: str) -> list[str]:
    """Sentences and lines of t; joined they are t."""
    return [m[0] for m in _stretch.finditer(t) if m[0]] if t else []


def quoted(t: str, parts: list[str]) -> list[bool]:
    """Of each stretch of t whether it begins in a quotation: a line after >, or between the tags of one, however nested."""
    spans = [m.span() for m in _quoted_line.finditer(t)]
    depth = start = 0
    for m in _quote.finditer(t):
        if m[1]:
            start, depth = (m.start() if not depth else start), depth + 1
        elif depth:
            depth -= 1
            if not depth:
                spans.append((start, m.start()))
    if depth:
        spans.append((start, len(t)))
    if not spans:
        return [False] * len(parts)
    out, at, k = [], 0, 0
    spans.sort()
    for s in parts:
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        out.append(any(lo <= at < hi for lo, hi in spans[k : k + 2]))
        at += len(s)
    return out


def _runs(s: str) -> list[tuple[str, str, str]]:
    return [(kind(s[m.start() - 1]) if m.start() else " ", m[0], kind(s[m.end()]) if m.end() < len(s) else " ") for m in _run.finditer(s)]


Priors = tuple[list[float], list[float]]  # of own and of quoted text


def posteriors(parts: list[list[tuple[str, str, str]]], fields: list[bool], model: Model, priors: Priors) -> list[dict[int, float]]:
    """Of each stretch (its runs), the posterior of each chain with weight. A second pass lets the record's stretches share their
    chains: one that stands in the record is likelier in its other stretches."""
    gains = []
    for runs in parts:
        g: Counter = Counter()
        for r in runs:
            for j, gain, _ in model.gains(*r):
                g[j] += gain
        gains.append(g)
    n = sum(1 for g in gains if g) + 3
    gains = [{j: x for j, x in g.items() if x > _LEAST_GAIN} for g in gains]
    if not any(gains):
        return [{}] * len(parts)
    own, out = priors, []
    for _ in range(2):
        out, mass = [], Counter()
        for g, f in zip(gains, fields):
            if not g:
                out.append({})
                continue
            w = {j: math.log(own[f][j]) + x for j, x in g.items()}
            top = max([0.0, *w.values()])
            z = math.exp(-top) + sum(math.exp(x - top) for x in w.values())
            p = {j: math.exp(x - top) / z for j, x in w.items()}
            out.append({j: x for j, x in p.items() if x > 1e-3})
            for j, x in p.items():
                mass[j] += x
        every = 1 + sum(mass.values()) / n
        own = tuple([(prior[j] + mass[j] / n) / every for j in range(len(prior))] for prior in priors)
    return out


def repair_runs(s: str, j: int, model: Model) -> str:
    """s with the runs repaired that chain j changes for the better."""

    def one(m: re.Match) -> str:
        left = kind(s[m.start() - 1]) if m.start() else " "
        right = kind(s[m.end()]) if m.end() < len(s) else " "
        return next((f for i, gain, f in model.gains(left, m[0], right) if i == j and gain > 0), m[0])

    return _run.sub(one, s)


def restore(text: str, model: Model, priors: Priors) -> tuple[str, float, list[str]]:
    """The repaired text, the probability that some stretch of text is garbled, and the chains undone, outermost first. Repairs go on
    while there are any: each makes the text likelier, so they end."""
    t, clean, chains, first = unescape(text), 1.0, [], True
    escaped = t != text
    while not t.isascii():
        parts = stretches(t)
        post = posteriors([_runs(s) for s in parts], quoted(t, parts), model, priors)
        new, now = [], []
        for s, p in zip(parts, post):
            if first:
                clean *= max(0.0, 1 - sum(p.values()))
            j = max(p, key=p.get, default=None)
            if j is None or p[j] <= 1 - sum(p.values()):
                new.append(s)
                continue
            now.append(CHAINS[j])
            new.append(repair_runs(s, j, model))
        first = False
        chains += list(dict.fromkeys(now))
        if (done := "".join(new)) == t:
            break
        t = done
    return (text if escaped and not chains else t), 1 - clean, list(dict.fromkeys(chains))


_NO_GAIN = [_PRIOR] * len(CHAINS)


def signature(t: str) -> str:
    """The stretches of t that have runs, each with its field and its runs between their neighbours' classes, as one string."""
    parts = stretches(t)
    out = []
    for s, q in zip(parts, quoted(t, parts)):
        if runs := _runs(s):
            out.append(("q" if q else "o") + _PART.join(x for r in runs for x in r))
    return _STRETCH.join(out)


def _read(sig: str) -> tuple[list[list[tuple[str, str, str]]], list[bool]]:
    parts, fields = [], []
    for s in sig.split(_STRETCH):
        x = s[1:].split(_PART)
        parts.append([(x[i], x[i + 1], x[i + 2]) for i in range(0, len(x), 3)])
        fields.append(s[0] == "q")
    return parts, fields


def _expected(rows: Iterator[tuple[str, str, float, Priors]], model: Model | None) -> Counter:
    """Expected counts of (side, class, character), and of stretches and chains by source and field, from signatures with their numbers."""
    n: Counter = Counter()
    for source, sig, k, priors in rows:
        parts, fields = _read(sig)
        post = posteriors(parts, fields, model, priors) if model else [{}] * len(parts)
        for runs, q, p in zip(parts, fields, post):
            name = source + _FIELD + ("q" if q else "o")
            n["n", name, ""] += k
            for j, x in p.items():
                n["c", name, str(j)] += k * x
            rest = 1 - sum(p.values())
            for left, run, right in runs:
                fixed = {j: f for j, _, f in model.gains(left, run, right)} if p else {}
                for weight, text in [(rest, run), *((x, fixed[j]) for j, x in p.items() if j in fixed and CHAINS[j] != LOST)]:
                    if weight < 1e-3:
                        continue
                    before = left
                    for i, c in enumerate(text):
                        if not c.isascii():
                            n["l", before, symbol(c)] += k * weight
                            n["r", kind(text[i + 1]) if i + 1 < len(text) else right, symbol(c)] += k * weight
                        before = kind(c)
    return n


def gathered(rows: DataFrame) -> DataFrame:
    """(what, source, sig, n) of rows (text, source): how often each class of character occurs (what k, sig the class), and each signature
    in each source (what s). The corpus is read once; equal ones are added up before the shuffle."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            chars: Counter = Counter()
            for source, raw in zip(pdf["source"], pdf["text"]):
                t = unescape(raw)
                chars.update(t)
                if not t.isascii() and (sig := signature(t)):
                    n["s", source, sig] += 1
            for c, k in chars.items():
                n["k", "", kind(c)] += k
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["what", "source", "sig", "n"]).astype({"n": "int64"})

    return rows.mapInPandas(read, "what string, source string, sig string, n long").groupBy("what", "source", "sig").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str, source: str, rounds: int = _ROUNDS, close: float = CLOSE) -> tuple[Model, DataFrame]:
    """The character model and (source, own, quoted), the chains' shares by source and field, from all rows of df, by rounds until no
    chain's overall share moves by more than close.

    What comes to the driver are sums over the corpus by class and symbol (below 100 classes and 5,500 symbols, so at most some
    10^6 pairs, in practice some 10^4, however large the corpus) and by chain. What is known of each source stays in a table.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text}`").alias("text")).where("text is not null")
    all_ = staged(gathered(rows).repartition(width(spark)), "signatures")  # small, and every round's work: spread evenly
    kinds = {r["sig"]: float(r["n"]) for r in all_.where("what = 'k'").select("sig", "n").collect()}  # below 100 classes
    sigs = all_.where("what = 's'").select("source", "sig", F.col("n").cast("double").alias("n"))
    model, priors, shares = None, None, None
    chain = list(range(len(CHAINS)))
    for _ in range(rounds + 1):
        held = spark.sparkContext.broadcast(model)
        with_priors = sigs.withColumns({"own": F.lit(None).cast("array<double>"), "quoted": F.lit(None).cast("array<double>")}) if priors is None else sigs.join(priors, "source", "left")

        def count(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            m = held.value
            for pdf in batches:
                own = [_NO_GAIN if x is None else list(x) for x in pdf["own"]]
                quoted_ = [_NO_GAIN if x is None else list(x) for x in pdf["quoted"]]
                n = _expected(zip(pdf["source"], pdf["sig"], pdf["n"], zip(own, quoted_)), m)
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["what", "a", "x", "n"]).astype({"n": float})

        sums = with_priors.mapInPandas(count, "what string, a string, x string, n double").groupBy("what", "a", "x").agg(F.sum("n").alias("n"))
        sums = staged(sums, "sums")
        got = sums.where("what in ('l', 'r')").toPandas().sort_values(["what", "a", "x"])  # bounded, see above
        pairs = dict(zip(zip(got["what"], got["a"], got["x"]), got["n"].tolist()))
        if model is not None:
            every = (sums.where("what = 'n'").agg(F.sum("n")).first()[0] or 0.0) or 1.0
            got = {int(r["x"]): r["n"] for r in sums.where("what = 'c'").groupBy("x").agg(F.sum("n").alias("n")).collect()}  # one row a chain
            now = [(got.get(j, 0.0) + _PRIOR) / (every + 1) for j in chain]
            by = sums.where("what in ('n', 'c')").groupBy("a").agg(F.sum(F.when(F.col("what") == "n", F.col("n"))).alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("what") == "c", F.struct("x", "n")))).alias("c"))  # chains of one source and field
            p = F.array(*[F.greatest(F.lit(1e-6), (F.coalesce(F.col("c")[str(j)], F.lit(0.0)) + 50 * now[j]) / (F.col("n") + 50)) for j in chain])
            by = by.select(F.substring_index("a", _FIELD, 1).alias("source"), F.substring_index("a", _FIELD, -1).alias("field"), p.alias("p"))
            priors = staged(by.groupBy("source").agg(F.max(F.when(F.col("field") == "o", F.col("p"))).alias("own"), F.max(F.when(F.col("field") == "q", F.col("p"))).alias("quoted")), "priors")
            still = shares is not None and max(abs(x - y) for x, y in zip(now, shares)) <= close
            shares = now
        model = Model(pairs, kinds)
        if priors is not None and still:
            break
    if priors is None:
        priors = spark.createDataFrame([], "source string, own array<double>, quoted array<double>")
    return model, priors


def repair(df: DataFrame, ident: str, text: str, source: str, least: float = 0.5) -> DataFrame:
    """ident, garbled (P(some stretch is garbled) > least), probability, chains undone (joined by a blank), restored (the text with
    all repairs, the text itself where nothing is garbled) and whole (no lost character is left in a garbled text).

    Null and empty texts aren't garbled and come back as they are; a lost character (U+FFFD) always counts as garbled. Rows are
    judged one by one with a model of all rows, so repeated rows get equal results.
    """
    rows = staged(df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")), "texts")
    model, priors = fit(rows, "text", "source")
    held = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, own, quoted_ in zip(pdf["id"], pdf["text"], pdf["own"], pdf["quoted"]):
                new, p, chains = restore(t, held.value, (_NO_GAIN if own is None else list(own), _NO_GAIN if quoted_ is None else list(quoted_)))
                out.append((i, p > least, p, " ".join(chains), new if p > least else t, "\ufffd" not in new))
            yield pd.DataFrame(out, columns=[ident, "garbled", "probability", "chains", "restored", "whole"])

    kind_ = dict(df.dtypes)[ident]
    suspect = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
    judged = rows.where(suspect).join(priors, "source", "left").select("id", "text", "own", "quoted").mapInPandas(judge, f"`{ident}` {kind_}, garbled boolean, probability double, chains string, restored string, whole boolean")
    plain = rows.where(~suspect).select(F.col("id").alias(ident), F.lit(False).alias("garbled"), F.lit(0.0).alias("probability"), F.lit("").alias("chains"), F.col("text").alias("restored"), F.lit(True).alias("whole"))
    return judged.unionByName(plain)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("garbled").select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their chains and restored texts."""
    return repair(table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("garbled").drop("garbled")


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
ORACLES: dict[str, str] = {}
