from pyspark.sql import functions as F

from voxtide.functions import text as tx
from voxtide.functions.lexicon import score_sentiment
from tests.porter import stem_word
from voxtide.functions.stemming import stem_tokens
from voxtide.operators import features, stats

SENTENCES = [
    (1, "The mathematics course was excellent. I learned a lot!"),
    (2, "The teaching quality was poor and difficult to follow."),
    (3, "The course content was adequate."),
]


def frame(spark, rows=SENTENCES):
    return spark.createDataFrame(rows, "id bigint, text string")


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_preprocess(spark):
    rows = tx.preprocess(frame(spark), "text").orderBy("id").collect()
    first = rows[0]["processed_text"]
    assert len(rows) == 3
    assert "the" not in first.split() and "." not in first and first == first.lower()
    assert "mathematics" not in first  # the noun rule drops a plural s
    assert first == "mathematic course excellent learned lot"
    again = tx.preprocess(frame(spark).withColumn("processed_text", F.lit("kept")), "text")
    assert {r["processed_text"] for r in again.collect()} == {"kept"}


def test_empty_and_null_texts(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "...!"), (4, "don't")])
    rows = {r["id"]: r["processed_text"] for r in tx.preprocess(df, "text").collect()}
    assert rows == {1: "", 2: "", 3: "", 4: "dont"}


def test_switches(spark):
    text = F.lit("The Cats, sat")
    kept = tx.normalized_tokens(text, lowercase=False, remove_punctuation=False, remove_stopwords=False, lemmatized=False)
    assert one(spark, kept) == ["The", "Cats", ",", "sat"]
    assert one(spark, tx.normalized_tokens(text)) == ["cat", "sat"]
    assert one(spark, tx.normalized_tokens(text, lexicon={"sat": "sit"})) == ["cat", "sit"]


def test_lemmas(spark):
    pairs = {"classes": "class", "boxes": "box", "cities": "city", "women": "woman", "churches": "church",
             "glass": "glass", "bus": "bus", "gas": "gas", "wolves": "wolf", "exams": "exam", "analysis": "analysis",
             "series": "series", "gives": "give", "sizes": "size", "movies": "movie", "buses": "bus", "specimen": "specimen",
             "women": "woman", "knives": "knife", "species": "species", "quizzes": "quiz", "children": "child"}
    for word, expected in pairs.items():
        assert one(spark, tx.lemma(F.lit(word))) == expected, word


def test_porter_stems(spark):
    # Examples from the published description of the algorithm.
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubling": "troubl", "sized": "size",
             "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
             "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
             "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
             "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr",
             "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
             "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate",
             "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: stem_word(w) for w in pairs} == pairs
    words = [*pairs, "yes", "yy", "by", "say", "saying", "toying", "ying", "syzygy", "a", "is", "", "ied", "eed", "agreed", "été", "ünique", "hoed", "bowing"]
    assert one(spark, stem_tokens(F.lit(words))) == [stem_word(w) for w in words]


def test_porter_on_a_table(spark, data):
    tokens = tx.split_words(tx.clean(F.col("text")))
    words = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select(F.explode(tokens)).distinct().limit(20_000).collect()]
    stems = spark.createDataFrame([(words,)], "w array<string>").select(stem_tokens(F.col("w"))).first()[0]
    assert [(w, s) for w, s in zip(words, stems) if s != stem_word(w)] == []


def test_processed_stems(spark):
    df = tx.preprocess(frame(spark), "text", lemmatized=False, stemmed=True)
    assert df.where("id = 1").first()["processed_text"] == "mathemat cours excel learn lot"


def test_lexicon(spark):
    df = frame(spark, [(1, "Great and helpful"), (2, "good bad"), (3, "poor poor"), (4, None),
                       (5, "excellent great good helpful outstanding enjoyed useful")])
    rows = {r["id"]: (r["predicted_sentiment"], round(r["confidence"], 6)) for r in score_sentiment(df, "text").collect()}
    assert rows == {1: ("Positive", 0.7), 2: ("Neutral", 0.5), 3: ("Negative", 0.6), 4: ("Neutral", 0.5), 5: ("Positive", 0.9)}


def test_word_counts(spark):
    df = frame(spark, [(1, "b a b"), (2, "a c")])
    out = stats.word_counts(df, tx.split_words(F.col("text")), 2).collect()
    assert [tuple(r) for r in out] == [("a", 2), ("b", 2)]


def test_features(spark):
    df = frame(spark, [(1, "red blue red"), (2, "blue x green"), (3, "!!")])
    counts = features.long_features(df, "id", "text", "count")
    found = {(r["id"], r["term"]): r["value"] for r in counts.collect()}
    assert found == {(1, "red"): 2, (1, "blue"): 1, (1, "red blue"): 1, (1, "blue red"): 1,
                     (2, "blue"): 1, (2, "green"): 1, (2, "blue green"): 1}
    assert {r["value"] for r in features.long_features(df, "id", "text", "binary").collect()} == {1.0}
    norms = features.long_features(df, "id", "text", "tfidf").groupBy("id").agg(F.sum(F.col("value") ** 2).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in norms.collect())
    vocabulary = features.fit_vocabulary(df, "text", "tfidf", 3)
    assert len(vocabulary.terms) == 3
    unseen = features.vectorize(frame(spark, [(9, "nothing known")]), "id", "text", vocabulary)
    assert unseen.first()["features"].numNonzeros() == 0
    try:
        features.fit_vocabulary(df, "text", "hashing")
    except ValueError:
        pass
    else:
        raise AssertionError("unknown method was accepted")


def test_frequent_terms_with_pruning(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = features.term_totals(docs, "text", (1, 2)).orderBy(F.desc("total"), "term")
    for n in (50, 400):
        want = [(r["term"], r["total"]) for r in plain.limit(n).collect()]
        assert features.most_frequent(docs, "text", n, (1, 2)) == want


def test_same_result_for_any_partitioning(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    results = []
    for n in (1, 7):
        long = features.long_features(docs.repartition(n), "doc_id", "text", "tfidf", 300)
        results.append(sorted((r[0], r[1], round(r[2], 9)) for r in long.collect()))
    assert results[0] == results[1]


def test_vectors_count_the_ngrams_of_each_text(spark):
    """Terms of one to three words, some only the beginning of others, in texts that follow each other in a batch."""
    texts = ["aa bb cc aa bb", "cc", None, "", "bb cc aa bb cc", "ab a aa  bb\u00e9 bb", "aa"]
    terms = ["aa", "aa bb", "ab aa", "bb cc", "bb cc aa", "cc", "cc aa bb"]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    for method in ("count", "binary"):
        vocabulary = features.Vocabulary(terms, (1, 3), method)
        for r in features.vectorize(docs, "id", "text", vocabulary).collect():
            words = [w for w in (texts[r["id"]] or "").split() if len(w) > 1]
            grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
            want = [float(grams.count(t)) for t in terms]
            assert list(r["features"].toArray()) == (want if method == "count" else [min(v, 1.0) for v in want])


def test_best_pairs_break_ties_by_term(spark):
    texts = ["b\u00e9ta alpha beta", "alpha beta", "b\u00e9ta alpha", "beta gamma beta", "zeta zeta zeta"]
    words = sorted({w for t in texts for w in t.split()})
    found = features._best_grams(frame(spark, list(enumerate(texts))).repartition(3), "text", 2, words, 4)
    assert found == [(-2, "alpha beta"), (-2, "b\u00e9ta alpha"), (-2, "zeta zeta"), (-1, "beta gamma")]
