"""Licence notices: phrases, optional and replaceable wording."""

import random
import re

import pytest

from voxtide.llm.common import plain_words
from voxtide.llm.licenses import MARK, MIT_BODY, TEMPLATES, Automaton, pattern, scan_licenses

SCHEMA = "doc_id bigint, text string, labels string, n_words int"


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return [r.asDict() for r in scan_licenses(df).orderBy("doc_id").collect()]


def test_phrases(spark):
    rows = scan(
        spark, "Released under the MIT License. And under the mit-license, under the MIT lice nse", "Apache License, Version 2.0",
        "CC BY-NC 4.0 cc by ncx", "under the mit license " * 3, "ccby nc", "UNDER THE MIT LICENSÉ",
    )
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows] == [
        (2, 1, 6, "mit"), (1, 0, 0, "apache-2"), (1, 0, 0, "cc-by-nc"), (3, 0, 8, "mit"), (0, None, None, ""), (0, None, None, ""),
    ]


@pytest.mark.parametrize(("template", "text", "hit"), [
    ("a [[ b c ]] d", "x a d", True), ("a [[ b c ]] d", "a b c d", True), ("a [[ b c ]] d", "a b d", False),
    ("a {{1..2}} d", "a d", False), ("a {{1..2}} d", "a q d", True), ("a {{1..2}} d", "a q q d", True), ("a {{1..2}} d", "a q q q d", False),
    ("a {{0..1}} [[ b ]] [[ c ]] d", "a d", True), ("a {{0..1}} [[ b ]] [[ c ]] d", "a z b c d", True), ("a a b", "a a a b", True),
    ("[[ x ]] a", "a", True), ("a [[ b ]]", "a", True), ("a << b c | d >> e", "a b c e", True), ("a << b c | d >> e", "a d e", True),
    ("a << b c | d >> e", "a b d e", False), ("a << b c | d >> e", "a e", False), ("a << b | >> e", "a e", True),
    ("a << b | b c >> << | d >> {{0..1}} e", "a b c d z e", True), ("a << b | b c >> << d | >>", "a b", True), ("a << b | c >> a", "a b c a", False),
])
def test_automaton(template, text, hit):
    assert Automaton.of(template).matches(plain_words(text.encode())) is hit


def test_template_without_mandatory_words():
    with pytest.raises(ValueError):
        Automaton.of("[[ a ]] {{0..3}}")


def test_templates_add_labels(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = scan(spark, gpl, gpl.replace("version ", ""), gpl.replace("Public", "Private"), gpl + " cc by nc")
    assert [r["labels"] for r in rows] == ["gpl-3", "gpl-3", "", "cc-by-nc,gpl-3"]
    assert [r["base_labels"] for r in rows] == ["", "", "", "cc-by-nc"]
    assert [r["score"] for r in rows] == [0.5, 0.5, 0.0, 1 - 1 / 3]


def some_wording(template, rng):
    """One of the texts that a template stands for."""
    out = []
    for optional, low, high, either, word in MARK.findall(template):
        if word:
            out.append(word)
        elif high:
            out += [rng.choice(["jane", "doe", "2024", "the"]) for _ in range(rng.randint(int(low), int(high)))]
        elif either:
            out += rng.choice(either.split("|")).split()
        else:
            out += rng.choice(["", optional]).split()
    return out


def test_automata_and_patterns_agree():
    """Every template takes its own wordings; with one mandatory word changed, both forms say the same."""
    rng = random.Random(5)
    for _, template in TEMPLATES:
        automaton, regex = Automaton.of(template), re.compile(pattern(template))
        for _ in range(6):
            words = some_wording(template, rng)
            assert automaton.matches(plain_words(" ".join(["x", *words, "y"]).encode()))
            assert regex.search(f" x {' '.join(words)} y ")
            at = rng.randrange(len(words))
            other = [*words[:at], rng.choice(["qq", "", words[at - 1]]), *words[at + 1 :]]
            other = " ".join(" ".join(other).split())
            assert automaton.matches(plain_words(other.encode())) is bool(regex.search(f" {other} "))


NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by"
    " the Free Software Foundation{} version {} of the License, or (at your option) any later version."
)


def test_whole_notices(spark):
    bsd = " ".join(some_wording(next(t for label, t in TEMPLATES if label == "bsd-3"), random.Random(1)))
    cc = "This work is licensed under a Creative Commons Attribution{} License."
    rows = scan(
        spark, NOTICE.format("General", ", either", "3"), NOTICE.format("General", "; either", "2"), NOTICE.format("Lesser General", "; either", "2.1"),
        NOTICE.format("Affero General", ", either", "3"), NOTICE.format("Private", ", either", "3"),
        cc.format(" 4.0 International"), cc.format("-NonCommercial 4.0 International"), cc.format("-NonCommercial-ShareAlike 3.0 Unported"),
        cc.format("-Whatever 4.0"), bsd, bsd.replace("binary form must", "binary form may"), "Copyright me. " + " ".join(some_wording(MIT_BODY, random.Random(2))),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in it.",
    )
    assert [r["labels"] for r in rows] == [
        "gpl-3", "gpl-2", "lgpl-2.1", "agpl-3", "", "cc-by", "cc-by-nc", "cc-by-nc-sa", "", "bsd-3", "", "mit", "",
    ]


def test_odd_texts(spark):
    long = "word " * 300_000 + "cc by nc"
    rows = scan(spark, None, "", " \n!", long, long)
    assert [(r["n_words"], r["n_base"], r["labels"], r["score"]) for r in rows] == [
        (0, 0, "", 0.0), (0, 0, "", 0.0), (0, 0, "", 0.0), (300_003, 1, "cc-by-nc", 0.5), (300_003, 1, "cc-by-nc", 0.5),
    ]
    assert rows[3]["first_word"] == 300_000
    assert scan(spark) == []
