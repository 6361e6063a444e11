"""Queries on the relational store's joins and on scored texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions.lexicon import score_sentiment
from voxtide.operators import metrics, stats, store
from voxtide.operators.inference import score_with_model
from voxtide.plans.registry import query, rounded
from voxtide.sources.tables import labelled_documents, table

# Frequent words stand in for the default lists, which hardly occur in these texts.
POSITIVE = ["with", "that", "for", "les", "und"]
NEGATIVE = ["was", "on", "by", "des", "der"]


def _feedback(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("feedback_text"))


def _analysis(spark, folder, label: str):
    name = F.when(F.col("quality") == 1, "Positive").otherwise("Negative") if label == "sentiment" else (
        F.when(F.col("toxic") == 1, "Toxic").otherwise("Clean")
    )
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("feedback_id"), name.alias(label), F.lit(0.5).alias("confidence"),
        F.lit("given").alias("model"), (F.col("doc_id") % 50).alias("created_at"),
    )


def _labelled_sql(case: str, label: str) -> str:
    return f"""SELECT d.doc_id AS id, text AS feedback_text, {case} AS {label}, CAST(0.5 AS DOUBLE) AS confidence, 'given' AS model,
 l.doc_id % 50 AS created_at FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY created_at DESC, id LIMIT 100"""


@query("sentiment_of_feedback", "J1 L3", _labelled_sql("CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END", "sentiment"))
def sentiment_of_feedback(spark, folder):
    return store.labelled_feedback(_feedback(spark, folder), _analysis(spark, folder, "sentiment"), "sentiment")


@query("category_of_feedback", "J2 L3", _labelled_sql("CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Clean' END", "category"))
def category_of_feedback(spark, folder):
    return store.labelled_feedback(_feedback(spark, folder), _analysis(spark, folder, "category"), "category")


@query("topics_of_feedback", "J3 L3", """
SELECT o_orderkey AS id, o_orderpriority AS feedback_text, s_name AS topic_name, 'nation ' || s_nationkey AS top_words,
       l_discount AS probability
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
ORDER BY l_discount DESC, o_orderkey, l_suppkey LIMIT 100""")
def topics_of_feedback(spark, folder):
    feedback = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("feedback_text")
    )
    analysis = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("feedback_id"), F.col("l_suppkey").alias("topic_id"), F.col("l_discount").alias("probability")
    )
    topics = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("top_words"),
    )
    return store.topic_feedback(feedback, analysis, topics)


RESOLVED = """results AS (SELECT d.doc_id, text, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
ids AS (SELECT text, max(doc_id) AS feedback_id FROM documents GROUP BY text)"""


def _results(spark, folder):
    return labelled_documents(spark, folder).where("quality is not null")


@query("store_sentiment_rows", "J4", f"""WITH {RESOLVED}
SELECT feedback_id, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS sentiment, CAST(0.25 + 0.5 * toxic AS DOUBLE) AS confidence,
 'given' AS model FROM results JOIN ids USING (text)""")
def store_sentiment_rows(spark, folder):
    label = F.when(F.col("quality") == 1, "Positive").otherwise("Negative")
    results = _results(spark, folder).select(
        "text", label.alias("predicted_sentiment"), (0.25 + 0.5 * F.col("toxic")).alias("confidence")
    )
    return store.label_rows(results, _feedback(spark, folder), "sentiment", "given")


@query("store_category_rows", "J4", f"""WITH {RESOLVED}
SELECT feedback_id, CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Clean' END AS category, CAST(0 AS DOUBLE) AS confidence, 'given' AS model
FROM results JOIN ids USING (text)""")
def store_category_rows(spark, folder):
    label = F.when(F.col("toxic") == 1, "Toxic").otherwise("Clean")
    results = _results(spark, folder).select("text", label.alias("predicted_category"))
    return store.label_rows(results, _feedback(spark, folder), "category", "given")


@query("store_topic_analysis_rows", "J4 C8", f"""WITH {RESOLVED}
SELECT feedback_id, CAST(t AS BIGINT) AS topic_id, CAST(CASE t WHEN 1 THEN 0.25 + 0.5 * quality ELSE 0.75 - 0.5 * quality END AS DOUBLE) AS probability,
 'given' AS model FROM results JOIN ids USING (text), (SELECT unnest([1, 2]) AS t)""")
def store_topic_analysis_rows(spark, folder):
    first = 0.25 + 0.5 * F.col("quality")
    distribution = _results(spark, folder).select("text", F.array(first, 1 - first).alias("probabilities"))
    return store.topic_analysis_rows(distribution, _feedback(spark, folder), "given")


@query("known_texts", "J5", """SELECT doc_id AS id, md5(text) AS text_md5 FROM documents
WHERE text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def known_texts(spark, folder):
    out = store.known_texts(_feedback(spark, folder), _results(spark, folder).select("text"))
    return out.select("id", F.md5("feedback_text").alias("text_md5"))


@query("labels_joined_by_key", "J6 C18 A8", """
SELECT lang, label, count(*) AS count FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY ALL""")
def labels_joined_by_key(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return stats.pair_counts(table(spark, folder, "documents").select("doc_id", "lang").join(labels, "doc_id"), "lang", "label")


@query("topic_names", "X16 C7", """
SELECT row_number() OVER (ORDER BY lang) AS id, 'Topic ' || id AS name, 'Automatically generated topic ' || id AS description,
 string_agg(source, ', ' ORDER BY source) AS top_words, 'given' AS model FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang""")
def topic_names(spark, folder):
    docs = table(spark, folder, "documents")
    langs = {lang: i for i, lang in enumerate(stats.label_values(docs, "lang"))}
    number = F.create_map(*[F.lit(x) for pair in langs.items() for x in pair])
    # Sources are few per language: the arrays stay short.
    words = docs.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("words"))
    return store.topic_rows(words.select(number[F.col("lang")].alias("topic"), "words"), "given")


def _hits_sql(words) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


LEXICON = f"""lead AS (SELECT doc_id, lang, ({_hits_sql(POSITIVE)}) - ({_hits_sql(NEGATIVE)}) AS d FROM documents),
scored AS (SELECT doc_id, lang, CASE WHEN d > 0 THEN 'Positive' WHEN d < 0 THEN 'Negative' ELSE 'Neutral' END AS predicted_sentiment,
 CASE WHEN d = 0 THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(0.5 AS DOUBLE) + abs(d) * CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)) END AS confidence FROM lead)"""


def _scored(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return score_sentiment(docs, "text", POSITIVE, NEGATIVE)


@query("lexicon_sentiment", "N1 X15", f"WITH {LEXICON} SELECT doc_id, predicted_sentiment, round(confidence, 6) AS confidence FROM scored")
def lexicon_sentiment(spark, folder):
    return rounded(_scored(spark, folder).select("doc_id", "predicted_sentiment", "confidence"), "confidence")


@query("default_lexicon_sentiment", "N1", """
WITH s AS (SELECT doc_id, list_sum(list_transform(['excellent','great','good','helpful','outstanding','enjoyed','useful'], lambda w: CAST(contains(lower(text), w) AS INTEGER)))
 - list_sum(list_transform(['poor','bad','disappointing','inadequate','below','difficult','struggled'], lambda w: CAST(contains(lower(text), w) AS INTEGER))) AS d FROM documents)
SELECT doc_id, CASE WHEN d > 0 THEN 'Positive' WHEN d < 0 THEN 'Negative' ELSE 'Neutral' END AS predicted_sentiment,
 CAST(CASE WHEN d = 0 THEN 0.5 ELSE least(0.5 + abs(d) * 0.1, 0.9) END AS DOUBLE) AS confidence FROM s""")
def default_lexicon_sentiment(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rounded(score_sentiment(docs, "text").drop("text"), "confidence")


@query("scored_table_report", "N3 E4", f"""WITH {LEXICON},
x AS (SELECT CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS t, predicted_sentiment AS p FROM scored s JOIN labels l ON s.doc_id = l.doc_id),
c AS (SELECT label, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS claimed,
      count(*) FILTER (WHERE t = label AND p = label) AS hits FROM x, (SELECT t AS label FROM x UNION SELECT p FROM x) GROUP BY label)
SELECT label, round(CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END, 6) AS precision,
 round(CASE WHEN support = 0 THEN 0 ELSE hits / support END, 6) AS recall,
 round(CASE WHEN support + claimed = 0 THEN 0 ELSE 2.0 * hits / (support + claimed) END, 6) AS f1, support FROM c""")
def scored_table_report(spark, folder):
    truth = F.when(F.col("quality") == 1, "Positive").otherwise("Negative")
    rows = _scored(spark, folder).join(table(spark, folder, "labels"), "doc_id").withColumn("truth", truth)
    report = metrics.class_report(rows, "truth", "predicted_sentiment")
    return rounded(report.drop("claimed", "hits"), "precision", "recall", "f1")


@query("confidence_histogram", "A12 N1", f"""WITH {LEXICON}, c AS (SELECT round((confidence - 0.5) * 10) AS step, count(*) AS count FROM scored GROUP BY 1)
SELECT CAST(step AS INTEGER) AS step, count FROM c""")
def confidence_histogram(spark, folder):
    found = stats.histogram(_scored(spark, folder), "confidence", 0.45, 0.95, 5)
    return found.select((F.col("bin") - 1).alias("step"), "count")


def _load_word_model():
    """A stand-in for a model: the label follows from the number of blanks in the text."""

    def model(texts):
        labels = ("POSITIVE", "NEGATIVE", "MIXED")
        return [(labels[t.count(" ") % 3], 0.5 + 0.1 * (t.count(" ") % 5)) for t in texts]

    return model


@query("model_inference", "N2", """
WITH b AS (SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS n FROM documents)
SELECT doc_id, ['Positive', 'Negative', 'Neutral'][n % 3 + 1] AS predicted_sentiment, CAST(0.5 + 0.1 * (n % 5) AS DOUBLE) AS confidence FROM b""")
def model_inference(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rounded(score_with_model(docs, "text", _load_word_model).drop("text"), "confidence")
