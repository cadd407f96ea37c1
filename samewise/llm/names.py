"""Names of people and organisations: one form for tokens, and whether two names mean the same.

Used by the name and linkage operators; everything here works on single values and pairs of values.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from samewise.functions.translit import has_indic, romanize
from samewise.llm.visual import form, look

# Legal forms by the token they come down to, short and long forms, nicknames by full name.
LEGAL = {
    "llc": "llc", "llp": "llp", "lp": "lp", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd", "private": "pvt", "pvt": "pvt", "plc": "plc",
    "gmbh": "gmbh", "gesmbh": "gmbh", "kg": "kg", "ag": "ag", "ek": "ek", "ug": "ug", "ohg": "ohg", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sci": "sci", "eurl": "eurl", "sa": "sa", "snc": "snc",
    "eood": "eood", "ood": "ood", "ad": "ad", "srl": "srl", "spa": "spa", "bv": "bv", "nv": "nv", "ltda": "ltda",
}
SHORT = {
    "co": "company", "cie": "compagnie", "engg": "engineering", "eng": "engineering", "prods": "products", "svcs": "services", "svc": "services", "trans": "transport", "transp": "transport", "assoc": "associates",
    "intl": "international", "mfg": "manufacturing", "tech": "technologies", "agcy": "agency", "trdrs": "traders", "tex": "textiles", "inds": "industries", "ets": "etablissements", "frs": "freres",
    "bros": "brothers", "mgmt": "management", "dept": "department", "ctr": "centre", "center": "centre", "intern": "international", "hosp": "hospital", "univ": "university", "natl": "national", "bldg": "building",
}
NICKNAMES = {
    "michael": "mike mick mickey mikey", "katherine": "kate kathy katie cathy kitty kat", "catherine": "cathy cathie kate cath kathy", "elizabeth": "liz beth betty eliza lizzie betsy", "margaret": "maggie meg peg peggy marge greta", "robert": "bob rob bobby robbie",
    "william": "bill will billy willy", "james": "jim jimmy jamie", "theodore": "ted theo teddy", "frederic": "fred freddy fredo", "alexandre": "alex alexis sacha", "friedrich": "fritz fred friedel", "wilhelmine": "minna mina helmi willa",
    "johannes": "hans johann jo", "krishnan": "kris krish krishna", "venkatesh": "venky venkat", "rajendra": "raju raj rajen", "mohammed": "mohd md mohammad muhammad mohamed", "lakshmi": "laxmi lakhi", "francois": "franck fran fanfan", "richard": "dick rick rich",
    "charles": "charlie chuck", "thomas": "tom tommy", "joseph": "joe joey", "edward": "ed eddie ted", "patricia": "pat patty tricia", "jennifer": "jen jenny", "susan": "sue susie", "anthony": "tony", "daniel": "dan danny", "suresh": "suri", "subramaniam": "subbu mani",
}
_dba = re.compile(r"^.+\b(?:t/a|d/b/a|a/k/a|o/a|dba|aka|trading as|doing business as)\s+(.+)$", re.I | re.S)
_junk = re.compile(r"\(\s*id\s*:?\s*\d+\s*\)|\bid\s*:\s*\d+|#\s*\d+|(?:[-–]\s*\+?\d[\d\s]{6,}\d\W*)+$", re.I)
_web = re.compile(r"^\W*(?:https?://)?(?:www\.)?([\w-]{3,})\.(?:example|com|net|org|in|co|fr|de|us|biz|info|shop|site|io)\b[\w./-]*\W*$", re.I)
_spaced = re.compile(r"\b(?:[^\W\d_] ){1,}[^\W\d_]\b")
_LEET = str.maketrans("0134578", "oleastb")


def plain(s: str) -> str:
    """Lower case without accents, in Latin letters where they can be given."""
    s = romanize(form(s).casefold())
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c))


@lru_cache(1 << 16)
def fold(t: str) -> str:
    """A token by its sound: spellings that one hears alike, and doubled letters, fall together."""
    if not t.isascii() or t.isdigit():
        return t
    for a, b in (("zh", "j"), ("ph", "f"), ("oo", "u"), ("ee", "i"), ("ck", "k"), ("sch", "s"), ("ae", "a"), ("ou", "u")):
        t = t.replace(a, b)
    t = t.replace("w", "v").replace("c", "k").replace("q", "k").replace("y", "i")
    return re.sub(r"(.)\1+", r"\1", t)


_NICK = {(fold(full), fold(n)) for full, ns in NICKNAMES.items() for n in ns.split()}
#: The full names of each nickname.
FULL: dict[str, set[str]] = {}
for _full, _nick in _NICK:
    FULL.setdefault(_nick, set()).add(_full)


#: Words before a name that one may leave out.
TITLES = frozenset(fold(t) for t in ("shri", "sri", "shree", "smt", "sai", "om", "new", "messrs", "m", "dr", "mr", "mrs", "ms"))


class Name(tuple):
    """(tokens in order, without legal forms; legal forms; whether it was written in an Indic script; whether it is a web name; the
    first letters of all words, legal forms included; the first word as it is written)."""

    __slots__ = ()
    tokens = property(lambda self: self[0])
    legal = property(lambda self: self[1])
    indic = property(lambda self: self[2])
    web = property(lambda self: self[3])
    initials = property(lambda self: self[4])
    word = property(lambda self: self[5])


@lru_cache(1 << 14)
def parse(raw: str | None) -> Name:
    """The Name of raw; a null or empty one has no tokens."""
    if not raw:
        return Name(((), frozenset(), False, False, "", ""))
    s = look(raw)
    web = _web.match(s)
    if web:
        return Name(((re.sub(r"^the(?=\w{6})", "", fold_word(plain(web[1]).replace("-", ""))),), frozenset(), False, True, "", ""))
    s = _junk.sub(" ", s)
    if m := _dba.match(s):
        s = m[1]
    indic = has_indic(s)
    s = re.sub(r"(?<=[^\W\d_])&|&(?=[^\W\d_])", " & ", s)
    s = re.sub(r"(?<=[a-zß-ÿ]{3})(?=[A-ZÀ-Þ][^\W\d_])", " ", s)  # words run together
    s = plain(s)
    s = re.sub(r"^\W*m\s*/\s*s\b\.?", " ", s)
    s = s.replace("&", " and ").replace("'", "").replace("’", "")
    s = re.sub(r"\(\s*p\s*\)", " pvt ", s)
    s = " ".join(re.findall(r"[^\W_]+", s))
    s = _spaced.sub(lambda m: m[0].replace(" ", "") if m[0].replace(" ", "") in LEGAL or len(m[0]) > 3 else m[0], s)
    s = re.sub(r"\blimited liability (?:co|company)\b", "llc", s)
    s = re.sub(r"\blimited liability partnership\b", "llp", s)
    s = re.sub(r"\bges(?:ellschaft)? mbh\b", "gmbh", s)
    s = re.sub(r"\bp ltd\b", "pvt ltd", s)
    tokens, legal, initials, word = [], set(), "", ""
    for t in s.split():
        if any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) >= 2:
            t = t.translate(_LEET)
        if t not in ("the", "and", "of", "et", "und"):
            initials, word = initials + t[0], word or t
        if t in LEGAL:
            legal.add(LEGAL[t])
        elif t not in ("the", "and", "of", "et", "und"):
            tokens.append(fold_word(SHORT.get(t, t)))
    return Name((tuple(tokens), frozenset(legal), indic, False, initials, word))


def fold_word(t: str) -> str:
    return fold(t)


def damerau(a: str, b: str, most: int) -> int:
    """The number of insertions, deletions, changes and swaps of neighbours from a to b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    far = most + 1
    before, last = None, [min(far, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [far] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):  # outside this band there are more edits than most
            y = b[j - 1]
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return far
        before, last = last, now
    return min(last[-1], far)


def edits_allowed(n: int) -> int:
    """Edits between two writings of a token of n letters."""
    return 0 if n < 4 else 1 if n < 8 else 2


@lru_cache(1 << 15)
def near(a: str, b: str, slack: int = 0) -> bool:
    """Whether a and b can be one token mistyped. Two changed letters side by side are another syllable, not two slips. slack: further
    edits that may lie between two writings of a third one."""
    most = edits_allowed(min(len(a), len(b)))
    d = damerau(a, b, most + (slack if most else 0))
    if d > most:
        return d <= most + slack and most > 0
    if d == 2:
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        j = 0
        while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
            j += 1
        la, lb = len(a) - i - j, len(b) - i - j
        return not (la == lb and la <= 3)
    return True


def abbreviates(a: str, b: str) -> bool:
    """Whether a shortens b: its beginning, or its first letter and later ones in order."""
    if not 2 <= len(a) < len(b) or a[0] != b[0] or len(a) > 0.75 * len(b):
        return False
    it = iter(b)
    return b.startswith(a) or (len(a) >= 3 and all(c in it for c in a))


@lru_cache(1 << 16)
def token_cost(a: str, b: str, slack: int = 0) -> float:
    """0 for equal tokens, up to 0.5 for writings of one, 1 for others."""
    if a == b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if (b, a) in _NICK or (a, b) in _NICK:
        return 0.2
    if near(a, b, slack):
        return 0.25
    if len(a) == 1:
        return 0.45 if b.startswith(a) or any(n == b and full.startswith(a) for full, n in _NICK) else 1.0
    return 0.4 if abbreviates(a, b) else 1.0


def assign(cost: list[list[float]]) -> list[int]:
    """For each row its column in an assignment of least total cost (rows not more than columns); shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    way = [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        low, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if of[j0] == 0:
                break
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def _merge(a: list[str], b: list[str]) -> list[str]:
    """a with two or three neighbours joined where together they are a token of b."""
    i, out = 0, []
    while i < len(a):
        for k in (3, 2):
            if i + k <= len(a):
                w = fold("".join(a[i : i + k]))
                if len(w) >= 5 and w not in a and any(near(w, t) for t in b if t not in a) and not any(near(p, t) for p in a[i : i + k] if len(p) >= 5 for t in b):
                    out.append(w)
                    i += k
                    break
        else:
            out.append(a[i])
            i += 1
    return out


def align(a: Name, b: Name, slack: int = 0) -> tuple[list[tuple[str, str, float]], list[str], list[str]]:
    """Pairs of tokens with their cost, and the tokens without partner of either."""
    x, y = list(a.tokens), list(b.tokens)
    x, y = _merge(x, y), _merge(y, x)
    if not x or not y:
        return [], x, y
    swap = len(x) > len(y)
    if swap:
        x, y = y, x
    cost = [[token_cost(s, t, slack) for t in y] for s in x]
    got = assign(cost)
    pairs = [(x[i], y[j], cost[i][j]) for i, j in enumerate(got) if cost[i][j] < 1]
    left = [x[i] for i, j in enumerate(got) if cost[i][j] >= 1]
    used = {j for i, j in enumerate(got) if cost[i][j] < 1}
    right = [t for j, t in enumerate(y) if j not in used]
    return (pairs, right, left) if swap else (pairs, left, right)


def _own(a: Name, common) -> str:
    return fold("".join(t for t in a.tokens if t not in common and t not in TITLES))


def same_organisation(a: Name, b: Name, common: frozenset[str] | set[str], slack: int = 0) -> bool:
    """Whether a and b are ways of writing one organisation's name. common: tokens that many names have (trades, titles): one side
    may lack them. Every other token needs its partner, and two names whose leftovers differ are two organisations."""
    if not a.tokens or not b.tokens:
        return False
    if a.legal and b.legal and not (a.legal <= b.legal or b.legal <= a.legal):
        return False
    if a.indic != b.indic or a.web != b.web:
        return _same_core(a, b, common) or _same_core(b, a, common)
    pairs, left, right = align(a, b, slack)
    left, right = ([t for t in side if t not in TITLES] for side in (left, right))
    if any(t not in common for t in left + right) or any(c == 0.4 and s not in common and t not in common for s, t, c in pairs):
        # the proper words may be split at different places
        x, y = _own(a, common), _own(b, common)
        if not (len(x) >= 8 and len(y) >= 8 and x[:1] == y[:1] and near(x, y, slack)):
            return False
        rest_a, rest_b = [t for t in a.tokens if t in common], [t for t in b.tokens if t in common]
        _, left, right = align(Name((tuple(rest_a), frozenset(), False, False, "", "")), Name((tuple(rest_b), frozenset(), False, False, "", "")))
        return not (left and right)
    if left and right:
        return False
    if any(c >= 0.4 for s, t, c in pairs if s not in common and t not in common and len(min(s, t, key=len)) > 1):
        return False  # an abbreviated proper word could be any
    own = [c for s, t, c in pairs if s not in common or t not in common]
    if own:
        return min(own) < 0.4
    return not left and not right and all(c < 0.4 for *_, c in pairs)


def _same_core(a: Name, b: Name, common) -> bool:
    """Whether the proper words of b, run together, are the first word of a (a transcribed or web name, whose trade may be left out)."""
    if not (a.indic or a.web):
        return False
    own = [t for t in b.tokens if t not in common and t not in TITLES]
    first = [t for t in a.tokens if t not in common][:1] or list(a.tokens[:1])
    whole = fold("".join(own))
    return bool(own) and any(len(w) >= 5 and (near(w, whole) or (a.web and whole and near(w, fold("".join(b.tokens))))) for w in first)
