"""Porter's algorithm letter by letter, to compare the column functions with."""

import re

from voxtide.functions.stemming import STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """The word as a string of v (vowel) and c (consonant)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table, least: int) -> str:
    for ending, new in sorted(table, key=lambda pair: -len(pair[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + new if _measure(stem) > least else word
    return word


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-1:] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"

    word = _swap(word, STEP2, 0)
    word = _swap(word, STEP3, 0)

    for ending in sorted(STEP4, key=lambda e: -len(e)):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break

    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
