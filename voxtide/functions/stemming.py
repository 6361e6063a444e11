"""Porter's suffix-stripping algorithm (1980) over token arrays, as column functions.

A word's measure is the number of vowel-consonant sequences in it. `y` is a consonant at the
beginning of a word and after a vowel; a first `y` is written `Y` while a word is worked on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix tables of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
    "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
)

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_1_UP = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
MEASURE_2_UP = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
MEASURE_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT_END = "(?:^[^aeiou]|[^aeiouy]|[aeiouy][^aeiou])[aeiouy][^aeiouwxy]$"
DOUBLE_END = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
OPEN = "\u0001"  # marks a word that lost -ed or -ing


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plurals(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)
    )


def _past(w: Column) -> Column:
    eed = F.when(_cut(w, 3).rlike(MEASURE_1_UP), _cut(w, 1)).otherwise(w)
    out = F.when(w.endswith("eed"), eed)
    for ending in ("ed", "ing"):
        stem = _cut(w, len(ending))
        out = out.when(w.endswith(ending) & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit(OPEN)))
    return out.otherwise(w)


def _close(w: Column) -> Column:
    stem = _cut(w, 1)
    closed = (
        F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(stem.rlike(DOUBLE_END), _cut(w, 2))
        .when(stem.rlike(MEASURE_1) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e"))).otherwise(stem)
    )
    return F.when(w.endswith(OPEN), closed).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _swap(table: tuple) -> Callable[[Column], Column]:
    def step(w: Column) -> Column:
        out = None
        for ending, new in sorted(table, key=lambda pair: -len(pair[0])):
            stem = _cut(w, len(ending))
            swapped = F.when(stem.rlike(MEASURE_1_UP), F.concat(stem, F.lit(new))).otherwise(w)
            out = F.when(w.endswith(ending), swapped) if out is None else out.when(w.endswith(ending), swapped)
        return out.otherwise(w)

    return step


def _endings(w: Column) -> Column:
    out = None
    for ending in sorted(STEP4, key=lambda e: -len(e)):
        stem = _cut(w, len(ending))
        fits = stem.rlike(MEASURE_2_UP) & stem.rlike("[st]$") if ending == "ion" else stem.rlike(MEASURE_2_UP)
        cut = F.when(fits, stem).otherwise(w)
        out = F.when(w.endswith(ending), cut) if out is None else out.when(w.endswith(ending), cut)
    return out.otherwise(w)


def _last_e(w: Column) -> Column:
    stem = _cut(w, 1)
    drop = stem.rlike(MEASURE_2_UP) | (stem.rlike(MEASURE_1) & ~stem.rlike(SHORT_END))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _cut(w, 1).rlike(MEASURE_2_UP), _cut(w, 1)).otherwise(w)


def _first_y(w: Column) -> Column:
    return F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)


def _plain_y(w: Column) -> Column:
    return F.when(w.startswith("Y"), F.concat(F.lit("y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)


STEPS = (_first_y, _plurals, _past, _close, _last_y, _swap(STEP2), _swap(STEP3), _endings, _last_e, _last_l, _plain_y)


def stem_tokens(tokens: Column) -> Column:
    """The stem of each lower-case token; tokens of one or two characters are stems."""
    stems = tokens
    for step in STEPS:  # one pass each, so that a word is built once per step
        stems = F.transform(stems, step)
    return F.zip_with(tokens, stems, lambda word, stem: F.when(F.length(word) > 2, stem).otherwise(word))
