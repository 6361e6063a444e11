"""Queries on text normalisation and bag-of-words features."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions import stemming, text as tx
from voxtide.functions.text import STOP_WORDS
from voxtide.operators import features
from voxtide.operators.topics import dominant_topic, pair_npmi, window_counts
from voxtide.operators.stats import word_counts, word_counts_by
from voxtide.plans.registry import query, rounded, sql_list
from voxtide.plans.stats_queries import KEPT_WORDS_SQL, WORDS_SQL
from voxtide.sources.tables import table


def _docs(spark, folder, *columns):
    return table(spark, folder, "documents").select("doc_id", "text", *columns)


def _lemma_sql(t: str) -> str:
    cases = [f"WHEN {t} = '{many}' THEN '{one}'" for many, one in tx.IRREGULAR.items()]
    cases += [f"WHEN length({t}) <= 3 THEN {t}"]
    cases += [f"WHEN suffix({t}, '{e}') THEN {t}" for e in tx.KEEPS_S]
    cases += [f"WHEN suffix({t}, '{e}') THEN substr({t}, 1, length({t}) - {len(e)}) || '{s}'" for e, s in tx.NOUN_ENDINGS]
    return "CASE " + " ".join(cases) + f" ELSE {t} END"


LEMMAS_SQL = f"list_transform({KEPT_WORDS_SQL}, lambda w: {_lemma_sql('w')})"
MARKS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\s\p{Z}\p{L}\p{N}_]')"
TOPIC_TOKENS_SQL = f"""list_transform(list_filter({MARKS_SQL}, lambda t: regexp_matches(t, '^\\p{{L}}+$') AND t NOT IN ({sql_list(STOP_WORDS)})),
 lambda w: {_lemma_sql('w')})"""


@query("lower_case_without_punctuation", "X1 X2 X8", r"""
SELECT doc_id, md5(translate(lower(coalesce(text, '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS cleaned_md5 FROM documents""")
def lower_case_without_punctuation(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(tx.clean(F.col("text"))).alias("cleaned_md5"))


@query("tokenize", "X3 X7", f"SELECT doc_id, CAST(len({WORDS_SQL}) AS INTEGER) AS n_tokens, md5(array_to_string({WORDS_SQL}, ' ')) AS tokens_md5 FROM documents")
def tokenize(spark, folder):
    tokens = tx.split_words(tx.clean(F.col("text")))
    return _docs(spark, folder).select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


@query("tokenize_with_punctuation", "X3", f"SELECT doc_id, CAST(len({MARKS_SQL}) AS INTEGER) AS n_tokens, md5(array_to_string({MARKS_SQL}, ' ')) AS tokens_md5 FROM documents")
def tokenize_with_punctuation(spark, folder):
    tokens = tx.split_words(F.lower("text"), punctuation_removed=False)
    return _docs(spark, folder).select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


@query("remove_stop_words", "X4 X9", f"SELECT doc_id, array_to_string({KEPT_WORDS_SQL}, ' ') AS processed_text FROM documents")
def remove_stop_words(spark, folder):
    return tx.preprocess(_docs(spark, folder), "text", lemmatized=False).select("doc_id", "processed_text")


@query("lemmatize", "X5 X9 P2", f"SELECT doc_id, array_to_string({LEMMAS_SQL}, ' ') AS processed_text FROM documents")
def lemmatize(spark, folder):
    return tx.preprocess(_docs(spark, folder), "text").select("doc_id", "processed_text")


def _stems_sql(tokens: str) -> str:
    """Porter's steps in SQL, one list pass each; measures are told by regular expressions."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    one, two, exactly = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}", f"^({c})?{v}{c}({v})?$"
    vowel, short = f"^({c})?[aeiouy]", "(^[^aeiou]|[^aeiouy]|[aeiouy][^aeiou])[aeiouy][^aeiouwxy]$"
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda what, pattern: f"regexp_matches({what}, '{pattern}')"

    def swaps(pairs) -> str:
        cases = [
            f"WHEN suffix(w, '{e}') THEN CASE WHEN {has(cut(len(e)), one)} THEN {cut(len(e))} || '{new}' ELSE w END"
            for e, new in sorted(pairs, key=lambda pair: -len(pair[0]))
        ]
        return f"CASE {' '.join(cases)} ELSE w END"

    ends = " ".join(
        f"WHEN suffix(w, '{e}') THEN CASE WHEN {has(cut(len(e)), two)}{' AND ' + has(cut(3), '[st]$') if e == 'ion' else ''} THEN {cut(len(e))} ELSE w END"
        for e in sorted(stemming.STEP4, key=lambda e: -len(e))
    )
    steps = [
        "CASE WHEN w[1] = 'y' THEN 'Y' || w[2:] ELSE w END",
        f"CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {has(cut(3), one)} THEN {cut(1)} ELSE w END "
        f"WHEN suffix(w, 'ed') AND {has(cut(2), vowel)} THEN {cut(2)} || '~' WHEN suffix(w, 'ing') AND {has(cut(3), vowel)} THEN {cut(3)} || '~' ELSE w END",
        f"CASE WHEN NOT suffix(w, '~') THEN w WHEN {has(cut(1), '(at|bl|iz)$')} THEN {cut(1)} || 'e' "
        f"WHEN w[-2] = w[-3] AND {has('w[-2]', '[bcdfghjkmnpqrtvwx]')} THEN {cut(2)} "
        f"WHEN {has(cut(1), exactly)} AND {has(cut(1), short)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN suffix(w, 'y') AND {has(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE w END",
        swaps(stemming.STEP2), swaps(stemming.STEP3), f"CASE {ends} ELSE w END",
        f"CASE WHEN suffix(w, 'e') AND ({has(cut(1), two)} OR ({has(cut(1), exactly)} AND NOT {has(cut(1), short)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {has(cut(1), two)} THEN {cut(1)} ELSE w END",
        "CASE WHEN w[1] = 'Y' THEN 'y' || w[2:] ELSE w END",
    ]
    out = tokens
    for step in steps:
        out = f"list_transform({out}, lambda w: {step})"
    return f"list_transform(list_zip({tokens}, {out}), lambda p: CASE WHEN length(p[1]) > 2 THEN p[2] ELSE p[1] END)"


@query("stem", "X6 UD1", f"SELECT doc_id, array_to_string({_stems_sql(KEPT_WORDS_SQL)}, ' ') AS processed_text FROM documents")
def stem(spark, folder):
    return tx.preprocess(_docs(spark, folder), "text", lemmatized=False, stemmed=True).select("doc_id", "processed_text")


@query("topic_tokens", "X10", f"SELECT doc_id, array_to_string({TOPIC_TOKENS_SQL}, ' ') AS tokens FROM documents")
def topic_tokens(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(tx.topic_tokens(F.col("text")), " ").alias("tokens"))


def gram_sql(limit: int, high: int = 2) -> str:
    grams = "t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])" if high == 2 else "t"
    return f"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
gram AS (SELECT doc_id, unnest({grams}) AS term FROM tok),
alltf AS (SELECT doc_id, term, count(*) AS n FROM gram GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM alltf GROUP BY term ORDER BY total DESC, term LIMIT {limit}),
tf AS (SELECT doc_id, term, n FROM alltf WHERE term IN (SELECT term FROM vocab))"""


def tfidf_sql(limit: int, high: int = 2) -> str:
    return gram_sql(limit, high) + """,
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, n * idf AS w FROM tf JOIN idf USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM w)"""


@query("term_counts", "V1 V4", f"WITH {gram_sql(5000)} SELECT doc_id, term, CAST(n AS DOUBLE) AS value FROM tf")
def term_counts(spark, folder):
    return features.long_features(_docs(spark, folder), "doc_id", "text", "count")


@query("term_presence", "V2", f"WITH {gram_sql(5000)} SELECT doc_id, term, CAST(1 AS DOUBLE) AS value FROM tf")
def term_presence(spark, folder):
    return features.long_features(_docs(spark, folder), "doc_id", "text", "binary")


@query("tfidf", "V3", f"WITH {tfidf_sql(5000)} SELECT doc_id, term, round(value, 6) AS value FROM tfidf")
def tfidf(spark, folder):
    return rounded(features.long_features(_docs(spark, folder), "doc_id", "text", "tfidf"), "value")


@query("vocabulary", "V4", f"WITH {gram_sql(5000)} SELECT term, total FROM vocab")
def vocabulary(spark, folder):
    return features.top_terms(_docs(spark, folder), "text", 5000)


@query("tfidf_of_new_texts", "V5", f"""WITH {tfidf_sql(5000)},
newtok AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM conversations),
newgram AS (SELECT conv_id, turn, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM newtok),
newtf AS (SELECT conv_id, turn, term, count(*) * any_value(idf) AS w FROM newgram JOIN idf USING (term) GROUP BY ALL)
SELECT conv_id * 100000 + turn AS id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM newtf""")
def tfidf_of_new_texts(spark, folder):
    fitted = features.fit_vocabulary(_docs(spark, folder), "text", "tfidf", 5000)
    talk = table(spark, folder, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return rounded(features.long_terms(talk, "id", "text", fitted), "value")


@query("sparse_vectors", "V6", f"""WITH {gram_sql(5000)} SELECT d.doc_id, coalesce(count(term), 0) AS n_terms,
 coalesce(CAST(sum(n) AS DOUBLE), 0) AS total FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id GROUP BY d.doc_id""")
def sparse_vectors(spark, folder):
    docs = _docs(spark, folder)
    rows = features.vectorize(docs, "doc_id", "text", features.fit_vocabulary(docs, "text", "count", 5000))
    values = F.unwrap_udt("features")["values"]
    return rows.select(
        "doc_id", F.size(values).cast("bigint").alias("n_terms"),
        F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("total"),
    )


@query("dominant_topic", "C4", """
SELECT vec_id, 'Topic_' || list_position(embedding, list_max(embedding)) AS dominant_topic FROM embeddings""")
def dominant(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", dominant_topic(F.col("embedding")).alias("dominant_topic"))


@query("documents_per_topic", "A20 C4", """
SELECT 'Topic_' || list_position(embedding, list_max(embedding)) AS dominant_topic, count(*) AS count FROM embeddings GROUP BY 1""")
def documents_per_topic(spark, folder):
    return dominant(spark, folder).groupBy("dominant_topic").count()


TOPIC_WORDS = 20  # of each topic; the topic of a document is its language here, so that SQL knows it as well
WINDOW_SQL = f"""toks AS (SELECT doc_id, {TOPIC_TOKENS_SQL} AS t FROM documents),
occ AS (SELECT doc_id, len(t) AS n, unnest(t) AS word, unnest(range(0, len(t))) AS p FROM toks),
ranked AS (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
  FROM occ JOIN documents USING (doc_id) GROUP BY lang, word),
top AS (SELECT DISTINCT word FROM ranked WHERE r <= {TOPIC_WORDS}),
hit AS (SELECT doc_id, word, greatest(p - 109, 0) AS lo, least(p, greatest(n - 110, 0)) AS hi FROM occ WHERE word IN (SELECT word FROM top)),
win AS (SELECT DISTINCT doc_id, word, unnest(range(lo, hi + 1)) AS s FROM hit),
counts AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS windows FROM win a JOIN win b
  ON a.doc_id = b.doc_id AND a.s = b.s AND a.word <= b.word GROUP BY ALL),
total AS (SELECT CAST(sum(greatest(len(t) - 109, 1)) AS BIGINT) AS n FROM toks WHERE len(t) > 0)"""


def _window_counts(spark, folder):
    """Windows with the top words of all topics."""
    docs = _docs(spark, folder, "lang")
    tokens = tx.topic_tokens(F.col("text"))
    words = word_counts_by(docs, "lang", tokens, TOPIC_WORDS).select("word").distinct().orderBy("word").collect()
    return window_counts(docs, tokens, [row["word"] for row in words])


@query("window_pair_counts", "C6", f"WITH {WINDOW_SQL} SELECT word_a, word_b, windows FROM counts UNION ALL SELECT NULL, NULL, n FROM total")
def window_pair_counts(spark, folder):
    return _window_counts(spark, folder)


@query("pair_npmi", "C6", f"""WITH {WINDOW_SQL}, x AS (SELECT c.word_a, c.word_b, c.windows, c.windows / n AS p, a.windows / n AS pa, b.windows / n AS pb
 FROM counts c JOIN counts a ON a.word_a = c.word_a AND a.word_b = c.word_a JOIN counts b ON b.word_a = c.word_b AND b.word_b = c.word_b, total)
SELECT word_a, word_b, windows, round(ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12), 6) AS npmi FROM x""")
def npmi(spark, folder):
    return rounded(pair_npmi(_window_counts(spark, folder)), "npmi")


@query("top_terms_per_topic", "L4", f"""WITH {gram_sql(5000, 1)}, t AS (SELECT lang AS topic, term, CAST(sum(n) AS DOUBLE) AS weight FROM tf
 JOIN documents d ON d.doc_id = tf.doc_id GROUP BY ALL)
SELECT topic, term, weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS rank FROM t) WHERE rank <= 10""")
def top_terms(spark, folder):
    from voxtide.operators.topics import top_terms_per_topic

    docs = _docs(spark, folder, "lang")
    vocab = features.fit_vocabulary(docs, "text", "count", 5000, (1, 1))
    long = features.long_terms(docs, "doc_id", "text", vocab)
    weights = long.join(table(spark, folder, "documents").select("doc_id", F.col("lang").alias("topic")), "doc_id")
    return top_terms_per_topic(weights.groupBy("topic", "term").agg(F.sum("value").alias("weight")), 10)
