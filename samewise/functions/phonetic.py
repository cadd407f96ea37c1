"""The primary code of Double Metaphone: English spelling as consonants by sound, with the exceptions of names of other languages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("AEIOUY")
_SLAVIC = re.compile(r"W|K|CZ|WITZ")
_GERMAN = re.compile(r"^(?:VAN |VON |SCH)")


def code(word: str) -> str:
    """The code of a word of letters a-z, "" of others. A vowel is told at the start alone, as A."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    n, i, out = len(w), 0, []
    slavic, german = bool(_SLAVIC.search(w)), bool(_GERMAN.match(w))

    def at(k: int, *options: str) -> bool:
        return k >= 0 and any(w.startswith(o, k) for o in options)

    def vowel(k: int) -> bool:
        return 0 <= k < n and w[k] in _VOWELS

    def same(c: str, by: int = 1) -> int:
        return by + 1 if at(i + by, c) else by

    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    elif at(0, "X"):
        out.append("S")
        i = 1
    while i < n:
        c, step, add = w[i], 1, ""
        if c in _VOWELS:
            add = "A" if i == 0 else ""
        elif c == "B":
            add, step = "P", same("B")
        elif c == "C":
            add, step = _c(w, i, at, vowel, german)
        elif c == "D":
            if at(i, "DG"):
                add, step = ("J", 3) if at(i + 2, "I", "E", "Y") else ("TK", 2)
            else:
                add, step = "T", 2 if at(i, "DT", "DD") else 1
        elif c == "G":
            add, step = _g(w, i, at, vowel, slavic)
        elif c == "H":
            add, step = ("H", 2) if (i == 0 or vowel(i - 1)) and vowel(i + 1) else ("", 1)
        elif c == "J":
            if at(i, "JOSE") or at(0, "SAN"):
                add = "H"
            elif i == 0 or (vowel(i - 1) and not slavic and at(i + 1, "A", "O")):
                add = "J"
            elif not at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, "S", "K", "L"):
                add = "J"
            step = same("J")
        elif c == "L":
            add, step = "L", same("L")
        elif c == "M":
            add, step = "M", 2 if at(i + 1, "M") or (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) else 1
        elif c in "FKNQ":
            add, step = {"Q": "K"}.get(c, c), same(c)
        elif c == "P":
            add, step = ("F", 2) if at(i + 1, "H") else ("P", 2 if at(i + 1, "P", "B") else 1)
        elif c == "R":
            add, step = "" if i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA") else "R", same("R")
        elif c == "S":
            add, step = _s(w, i, at, n, slavic)
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add, step = "X", 3
            elif at(i, "TH", "TTH"):
                add, step = ("T" if at(i + 2, "OM", "AM") or german else "0"), 2
            else:
                add, step = "T", 2 if at(i + 1, "T", "D") else 1
        elif c == "V":
            add, step = "F", same("V")
        elif c == "W":
            if at(i, "WR"):
                add, step = "R", 2
            elif i == 0 and (vowel(1) or at(0, "WH")):
                add = "A"
            elif (i == n - 1 and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
                add = ""
            elif at(i, "WICZ", "WITZ"):
                add, step = "TS", 4
        elif c == "X":
            add = "" if i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU")) else "KS"
            step = 2 if at(i + 1, "C", "X") else 1
        elif c == "Z":
            add, step = ("J", 2) if at(i + 1, "H") else ("S", same("Z"))
        out.append(add)
        i += step
    return "".join(out)


def _c(w, i, at, vowel, german) -> tuple[str, int]:
    if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and not at(i + 2, "I") and (not at(i + 2, "E") or at(i - 2, "BACHER", "MACHER")):
        return "K", 2
    if i == 0 and at(0, "CAESAR"):
        return "S", 2
    if at(i, "CHIA"):
        return "K", 2
    if at(i, "CH"):
        if i > 0 and at(i, "CHAE"):
            return "K", 2
        if i == 0 and at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not at(0, "CHORE"):
            return "K", 2
        hard = german or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, "T", "S")
        if hard or ((i == 0 or at(i - 1, "A", "O", "U", "E")) and (i + 2 >= len(w) or at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W"))):
            return "K", 2
        return ("K" if i > 0 and at(0, "MC") else "X"), 2
    if at(i, "CZ") and not at(i - 2, "WICZ"):
        return "S", 2
    if at(i + 1, "CIA"):
        return "X", 3
    if at(i, "CC") and not (i == 1 and w[0] == "M"):
        if at(i + 2, "I", "E", "H") and not at(i + 2, "HU"):
            return ("KS" if (i == 1 and w[0] == "A") or at(i - 1, "UCCEE", "UCCES") else "X"), 3
        return "K", 2
    if at(i, "CK", "CG", "CQ"):
        return "K", 2
    if at(i, "CI", "CE", "CY"):
        return "S", 2
    return "K", 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1


def _g(w, i, at, vowel, slavic) -> tuple[str, int]:
    if at(i + 1, "H"):
        if i > 0 and not vowel(i - 1):
            return "K", 2
        if i == 0:
            return ("J" if at(2, "I") else "K"), 2
        if at(i - 2, "B", "H", "D") or at(i - 3, "B", "H", "D") or at(i - 4, "B", "H"):
            return "", 2
        if i > 2 and at(i - 1, "U") and at(i - 3, "C", "G", "L", "R", "T"):
            return "F", 2
        return ("K" if i > 0 and not at(i - 1, "I") else ""), 2
    if at(i + 1, "N"):
        if i == 1 and vowel(0) and not slavic:
            return "KN", 2
        return ("N" if not at(i + 2, "EY") and not slavic else "KN"), 2
    if at(i + 1, "LI") and not slavic:
        return "KL", 2
    if i == 0 and at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
        return "K", 2
    if (at(i + 1, "ER") or at(i + 1, "Y")) and not at(0, "DANGER", "RANGER", "MANGER") and not at(i - 1, "E", "I", "RGY", "OGY"):
        return "K", 2
    if at(i + 1, "E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
        return ("K" if at(0, "VAN", "VON", "SCH") or at(i + 1, "ET") else "J"), 2
    return "K", 2 if at(i + 1, "G") else 1


def _s(w, i, at, n, slavic) -> tuple[str, int]:
    if at(i - 1, "ISL", "YSL"):
        return "", 1
    if i == 0 and at(0, "SUGAR"):
        return "X", 1
    if at(i, "SH"):
        return ("S" if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
    if at(i, "SIO", "SIA"):
        return "S", 3
    if (i == 0 and at(1, "M", "N", "L", "W")) or at(i + 1, "Z"):
        return "S", 2 if at(i + 1, "Z") else 1
    if at(i, "SC"):
        if at(i + 2, "H"):
            if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X" if at(i + 3, "ER", "EN") else "SK"), 3
            return "X", 3
        return ("S" if at(i + 2, "I", "E", "Y") else "SK"), 3
    if i == n - 1 and at(i - 2, "AI", "OI"):
        return "", 1
    return "S", 2 if at(i + 1, "S", "Z") else 1


@F.pandas_udf(T.StringType())
def udf_code(s: pd.Series) -> pd.Series:
    """The codes of the first two words, a word itself where it has none, joined by a blank."""
    return s.map(lambda x: " ".join(code(t) or t for t in x.split()[:2]), na_action="ignore")
