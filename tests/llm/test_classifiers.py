"""Ordinal quality classifier and language identification: accuracy, exactness and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.llm import langid, quality, queries
from voxtide.llm.langid import Automaton, Languages, letters_of

DATA = "/root/testdata/sf0.1"


def toy(n, seed=1):
    """Grade 0 holds bad words, grade 1 is in capitals, grade 2 is plain."""
    rng = random.Random(seed)
    rows, grades = [], []
    for _ in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))]
        if grade == 0:
            words[3:3] = rng.sample(["awful", "dreadful", "nasty"], 2)
        text = " ".join(words)
        rows.append(text.upper() if grade == 1 else text)
        grades.append(grade)
    return rows, np.array(grades)


def buckets(texts):
    return [np.array(sorted({quality.bucket(f) for f in quality.features(t.encode())})) for t in texts]


def test_ordinal_regression_tells_grades_apart():
    texts, grades = toy(600)
    model = quality.fit_ordinal(buckets(texts), grades, steps=20_000)
    assert (np.diff(model.thresholds) >= 0).all() and model.grades == [0, 1, 2]
    fresh, truth = toy(300, 2)
    tails = model.tails(np.array([model.weights[b].sum() for b in buckets(fresh)]))
    assert ((tails > 0.5).sum(1) == truth).mean() > 0.97
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_models_of_few_grades():
    assert quality.fit_ordinal([], np.array([], dtype=int)).grades == []
    one = quality.fit_ordinal([np.array([1, 2])], np.array([2]))
    assert one.grades == [2] and not one.weights.any()


def test_slopes_of_the_loss():
    """The step along the score follows the log likelihood of the cumulative-link model."""
    cut, eps = np.array([-1.0, 0.5]), 1e-6
    def loss(s, y):
        high = 1 if y == 2 else quality._sigmoid(cut[y] - s)
        low = 0 if y == 0 else quality._sigmoid(cut[y - 1] - s)
        return -np.log(high - low), 1 - high - low
    for y in (0, 1, 2):
        numeric = (loss(0.3 + eps, y)[0] - loss(0.3 - eps, y)[0]) / (2 * eps)
        assert abs(numeric - loss(0.3, y)[1]) < 1e-5


def test_grades(spark):
    rows = [(1, 0, 2), (0, 0, 1), (1, 1, 0), (0, 1, 0), (None, 1, 0), (None, 0, None), (1, None, None)]
    df = spark.createDataFrame(rows, "quality int, toxic int, want int")
    assert df.where(~quality.grade_of(F.col("quality"), F.col("toxic")).eqNullSafe(F.col("want"))).count() == 0


def test_held_out_ratings(spark):
    """Fitted on half of the rated documents, judged on the other half."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").withColumn("odd", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1)
    model = queries.quality_model(docs, labels.where("odd"))
    graded = quality.grade_texts(docs, model).join(labels.where("not odd"), "doc_id")
    rates = {
        (r["quality"], r["toxic"]): r["kept"]
        for r in graded.groupBy("quality", "toxic").agg(F.avg((F.col("grading.tail") >= queries.KEEP_TAIL).cast("int")).alias("kept")).collect()
    }
    assert rates[1, 0] > 0.98 and rates[1, 1] < 0.05 and rates[0, 0] < 0.15


def test_odd_rated_rows(spark):
    texts, grades = toy(200)
    docs = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, "", "x", 1), (None, "a b", "x", 1), (3, texts[3], "x", 1)]
    docs += [(902, "word " * 100_000, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, grade string, rated_id int")
    rated = [(i, int(g)) for i, g in enumerate(grades)] + [(900, 2), (901, None), (None, 1), (5, 0), (5, 0), (10_000, 1)]
    model = quality.train(df, spark.createDataFrame(rated, "doc_id bigint, grade int"))
    out = quality.grade_texts(df, model)
    assert out.columns == [*df.columns, "grading"] and out.count() == len(docs)
    assert out.where("grading.tail is null or grading.tail < 0 or grading.tail > 1 or grading.expected_grade < 0 or grading.expected_grade > 2").count() == 0
    same = [r["tail"] for r in out.where("doc_id = 3").select("grading.tail").collect()]
    assert len(same) == 2 and same[0] == same[1]
    with pytest.raises(ValueError):
        quality.grade_texts(df, model, column="grade")
    nothing = quality.train(df, spark.createDataFrame([], "doc_id bigint, grade int"))
    assert quality.grade_texts(df, nothing).where("grading.tail < 1").count() == 0
    assert quality.grade_texts(df.limit(0), model).count() == 0


def test_sample_does_not_depend_on_partitions(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    a, b = queries.quality_model(docs, labels), queries.quality_model(docs.repartition(7), labels.repartition(5))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def parse(text, sample):
    """Phrases of a greedy parse, by looking substrings up."""
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n] in sample and text[i : i + n + 1] in sample:
            n += 1
        phrases, i = phrases + 1, i + n
    return phrases


@pytest.mark.parametrize("stride", [1, 2, 7, 50, 400])
@pytest.mark.parametrize("dense", [langid.DENSE, 0])
def test_phrases_are_those_of_one_parse(monkeypatch, stride, dense):
    """Whole texts, wherever they are cut into pieces; some hold runs of the samples, so that parses fall into step late."""
    monkeypatch.setattr(langid, "STRIDE", stride)
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 6)))
    samples = {"a": " ".join(word("abcd") for _ in range(80)), "b": " ".join(word("cdef") for _ in range(80)), "c": "abc " * 100}
    made = Languages([(k, [v.encode()]) for k, v in samples.items()])
    texts = [" ".join(word("abcdefz") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [samples["a"][20:260] + samples["b"][7:190], samples["c"][1:] * 3, "ab" * 150, "z" * 120, "abc " * 130 + "d", ""]
    texts = [t.strip() for t in texts]
    got = made.phrases([letters_of(t.encode()) for t in texts])
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == [parse(text, own.strip()) for own in samples.values()]


def test_prediction_is_that_of_plain_parses(spark, data):
    """Labels and scores of whole documents, with texts of more than one piece, against substring look-ups."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    samples = [(k, own[:3]) for k, own in langid.learn(docs)]
    plain = {k: "\0".join("".join(map(chr, letters_of(t))) for t in own) for k, own in samples}
    some = docs.where(F.length("text") > 1000).limit(6).unionByName(docs.where(F.length("text") < 400).limit(10))
    some = spark.createDataFrame(some.collect(), docs.schema)
    for r in langid.predict_language(some, samples).collect():
        letters = "".join(map(chr, letters_of(r["text"].encode())))
        (first, best), (second, _) = sorted((parse(letters, own), k) for k, own in plain.items())[:2]
        assert (r["language"]["lang_pred"], r["language"]["score"]) == (best, 1 - first / second)


def test_samples_are_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGE_LETTERS", 100)
    ids = [i for i in range(400) if not langid.is_held_out(i)]
    texts = {i: f"w{'x' * (10 + i % 40)} {i}" for i in ids[:60]} | {i: "y" * (101 + i) for i in ids[60:80]}
    rows = [(i, t, "aa") for i, t in texts.items()] + [(i, texts[i], "bb") for i in ids[60:80]] + [(ids[0], texts[ids[0]], "aa")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = dict(langid.learn(df))
    assert got == dict(langid.learn(df.repartition(5)))
    assert {t.decode() for t in got["aa"]} <= set(texts.values()) and 60 < sum(map(len, got["aa"])) <= 100
    assert len(got["aa"]) == len(set(got["aa"]))
    assert got["bb"] == [texts[ids[60]].encode()]


def test_automaton_knows_every_substring():
    rng = random.Random(4)
    symbols = [rng.randint(1, 3) for _ in range(60)]
    table = Automaton(symbols, 4).table

    def known(some):
        state = 0
        for s in some:
            state = table[state + s]
            if not state:
                return False
        return True

    inside = {tuple(symbols[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        some = tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 8)))
        assert known(some) == (some in inside)


def test_letters():
    assert "".join(map(chr, letters_of("Ä, b--C1\n日".encode()))) == "ä b c 日"
    assert len(letters_of(b"")) == len(letters_of(b"12 !")) == 0


def test_held_out_accuracy(spark):
    rows = queries.op9_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 1500 and r["right"] > 0.97
    wrong = rows.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count()
    assert wrong == 0 and langid.is_held_out(17) == (zlib.crc32(b"17") % 5 == 0)


def test_odd_language_rows(spark):
    en, de = "the cat sat on the mat " * 20, "der hund lief über die straße " * 20
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "x") for i in range(20)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 !?", "de", "x"), (103, "the mat", None, "x"), (None, "die straße", "de", "x"),
             (104, "ж" * 10, None, "x"), (105, en * 300, "en", "x"), (105, en * 300, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    samples = langid.learn(df)
    assert [name for name, _ in samples] == ["de", "en"]
    got = {r["doc_id"]: (r["language"]["lang_pred"], r["language"]["score"]) for r in langid.predict_language(df, samples).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[None][0] == "de" and got[105][0] == "en" and got[104] == ("de", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.predict_language(df, langid.learn(df.limit(0)))
    assert {r[0] for r in nothing.select("language.lang_pred").distinct().collect()} == {"und"}
    assert langid.predict_language(df.limit(0), samples).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.learn(docs) == langid.learn(other)


def test_every_label_is_learned(spark):
    """More labels than one group holds, the rarest with one text of many letters."""
    rng, rows, n = random.Random(7), [], 70
    told = {}
    for k in range(n):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(60)]
        text = lambda m: " ".join(rng.choice(words) for _ in range(m))  # noqa: B023, E731
        ids = [i for i in range(k * 100, k * 100 + 100) if not langid.is_held_out(i)][: 1 if k > 64 else 2]
        rows += [(i, text(300), f"l{k:02}") for i in ids]
        told[k * 100 + 99_000] = f"l{k:02}"
        rows.append((k * 100 + 99_000, text(30), None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    samples = langid.learn(df)
    assert len(samples) == n > langid.GROUP
    got = langid.predict_language(df, samples)
    assert got.columns == [*df.columns, "language"]
    right = {r["doc_id"]: r["language"]["lang_pred"] for r in got.where("lang is null").collect()}
    assert right == told
    # as all languages at once would
    made = Languages(samples)
    for r in got.where("lang is null").limit(10).collect():
        row = sorted(made.phrases([letters_of(r["text"].encode())])[0].tolist())
        assert r["language"]["score"] == 1 - row[0] / row[1]


def test_more_labels_do_not_shorten_the_samples():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij") for _ in range(2_000)).encode()
    few, many = Languages([("a", [text])]), Languages([(f"l{k:03}", [text]) for k in range(100)])
    probe = [letters_of(text)]
    assert set(many.phrases(probe)[0].tolist()) == set(few.phrases(probe)[0].tolist())


def test_sparse_table_is_the_full_one():
    rng = random.Random(6)
    symbols = [rng.randint(0, 40) for _ in range(3000)]
    full, some = Automaton(symbols, 41).table, Automaton(symbols, 41, 0).table
    assert (some[np.arange(len(full))] == full).all() and not full[::41].any()


def test_no_letter_of_a_sample_is_left_out():
    """A language of thousands of letters beside a small one in a script of its own."""
    rng = random.Random(5)
    han = "".join(chr(0x4E00 + i % 3000) for i in rng.sample(range(9000), 9000))
    thai = "กขคงจฉชซฌญ ดตถทธนบปผฝ"
    made = Languages([("ja", [han[i : i + 1500].encode() for i in range(0, 9000, 1500)]), ("th", [thai.encode()]), ("zz", [b"plain words"])])
    names, firsts, seconds = made.nearest(["ดตถทธ".encode(), han[700:760].encode(), "日本".encode(), b"words"])
    assert names == ["th", "ja", "ja", "zz"] and firsts[0] == firsts[1] == firsts[3] == 1 and seconds[:2] == [5, 60]


def test_long_texts_are_learned_from_any_place(spark):
    """Texts with one opening, longer than what is learned of a text, and texts that begin without a letter."""
    rng = random.Random(10)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(2, 7)))
    opening = " ".join(word("klmnop") for _ in range(900))
    own = {k: [word("abcdefgh") for _ in range(50)] for k in ("aa", "bb")}
    text = lambda k, n: " ".join(rng.choice(own[k]) for _ in range(n))
    rows = [(i, f"{opening} {text(k, 4000)}", k) for i, k in enumerate(["aa", "bb"] * 20)]
    rows += [(1000 + i, "1 2 " * 2000 + "жук лес дом река", "cc") for i in range(20)]
    told = {2000 + i: k for i, k in enumerate(["aa", "bb"] * 5)} | {3000: "cc"}
    rows += [(i, text(k, 40) if k != "cc" else "лес река дом", None) for i, k in told.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.predict_language(df, langid.learn(df)).where("lang is null").collect()
    assert {r["doc_id"]: r["language"]["lang_pred"] for r in got} == told
