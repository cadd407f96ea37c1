"""Letters of Indic scripts and Cyrillic as Latin ones, by rule."""

from __future__ import annotations

import re

#: The nine Indic blocks from U+0900 on are laid out alike, 128 code points each: one table of offsets serves all.
_FIRST, _LAST = 0x0900, 0x0D7F
# Sounds by offset in a block.
VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j z n t th d dh n t th d dh n n p f b bh m y r r l l l v sh sh s h".split()))
SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
NUKTA, VIRAMA = 0x3C, 0x4D
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыэюяії", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh sht a y e yu ya i yi".split())) | {"ь": ""}

_indic = re.compile("[ऀ-ൿ]+")
_cyrillic = re.compile("[а-яёії]", re.I)


def has_indic(s: str) -> bool:
    return bool(_indic.search(s))


def _run(m: re.Match) -> str:
    out, bare = [], False  # bare: a consonant without a vowel so far
    for c in m[0]:
        o = (ord(c) - _FIRST) % 0x80
        if o in CONSONANTS:
            out.append(("a" if bare else "") + CONSONANTS[o])
            bare = True
        elif o in SIGNS:
            out.append(SIGNS[o])
            bare = False
        elif o == VIRAMA:
            bare = False
        elif o in VOWELS or o in NASALS:
            out.append(("a" if bare else "") + (VOWELS.get(o) or NASALS[o]))
            bare = False
        elif 0x66 <= o <= 0x6F:
            out.append(("a" if bare else "") + str(o - 0x66))
            bare = False
        elif o != NUKTA:
            out.append(" ")
            bare = False
    return "".join(out)  # the vowel of a last bare consonant is silent


def romanize(s: str) -> str:
    """s with its Indic and Cyrillic letters in Latin; other characters stay."""
    s = _indic.sub(_run, s)
    return _cyrillic.sub(lambda m: CYRILLIC[m[0].lower()], s)
