"""Queries on sources, projections, row edits, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators import rows
from voxtide.operators.edits import KeptTable
from voxtide.operators.store import Store, import_feedback
from voxtide.plans.registry import query, rounded, sql_list
from voxtide.schemas import COLLECTED, require_columns
from voxtide.session import scratch_path
from voxtide.sources import files
from voxtide.sources.tables import FEEDBACK_SQL, feedback_from_orders, labelled_documents, table

WITH_FB = "WITH " + FEEDBACK_SQL
TODAY = "2024-06-30"
SEED = 42


def _documents_as_feedback(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.format_string("%08d", "doc_id").alias("student_id"), F.col("source").alias("course_id"),
        F.col("lang").alias("subject"), F.col("text").alias("feedback_text"),
        (1 + F.pmod("doc_id", F.lit(5))).cast("int").alias("rating"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("date"),
        F.lit(None).cast("string").alias("true_category"), F.lit(None).cast("string").alias("true_sentiment"),
    )


@query("csv_round_trip", "S1 S2 S2b", """
SELECT printf('%08d', doc_id) AS student_id, source AS course_id, lang AS subject, md5(text) AS text_md5,
       CAST(1 + doc_id % 5 AS INTEGER) AS rating, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date
FROM documents""")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "csv")
    files.write_csv(_documents_as_feedback(spark, folder), path)
    back = files.read_csv(spark, path)
    require_columns(back, ["feedback_text"])
    return back.select("student_id", "course_id", "subject", F.md5("feedback_text").alias("text_md5"), "rating", "date")


def _h(key: str, what: str, seed: object = SEED) -> str:
    """Key hash of the generator in SQL."""
    tag = f"{seed}:{what}" if what else f"{seed}"
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{tag}'), 1, 8)) AS BIGINT)"


def _sql_array(items) -> str:
    return "[" + sql_list(items) + "]"


def _generated_sql() -> str:
    k = "o_orderkey"
    text = "CASE " + " ".join(
        f"WHEN true_sentiment = '{s}' THEN {_sql_array(t)}[1 + {_h(k, 'template')} % {len(t)}]"
        for s, t in files.TEMPLATES.items()
    ) + " END"
    rating = "CASE " + " ".join(
        f"WHEN true_sentiment = '{s}' THEN {lo} + {_h(k, 'rating')} % {hi - lo + 1}"
        for s, (lo, hi) in files.RATINGS.items()
    ) + " END"
    return f"""
drawn AS (
  SELECT {k}, {_sql_array(files.SUBJECTS)}[1 + {_h(k, 'subject')} % {len(files.SUBJECTS)}] AS subject,
         {_sql_array(files.CATEGORIES)}[1 + {_h(k, 'category')} % {len(files.CATEGORIES)}] AS true_category,
         CASE WHEN {_h(k, 'sentiment')} % 100 < 60 THEN 'Positive'
              WHEN {_h(k, 'sentiment')} % 100 < 85 THEN 'Neutral' ELSE 'Negative' END AS true_sentiment
  FROM orders),
generated AS (
  SELECT {k}, 'S' || (10000 + {_h(k, 'student')} % 90000) AS student_id,
         upper(substr(subject, 1, 3)) || (100 + {_h(k, 'course')} % 900) AS course_id, subject,
         replace(replace({text}, '{{subject}}', subject), '{{category}}', true_category) AS feedback_text,
         CAST({rating} AS INTEGER) AS rating,
         CAST(DATE '{TODAY}' - CAST({_h(k, 'day')} % 366 AS INTEGER) AS DATE) AS date,
         true_category, true_sentiment
  FROM drawn)"""


@query("generated_feedback", "S4 X14", f"WITH {_generated_sql()} SELECT * FROM generated")
def generated_feedback(spark, folder):
    return files.generate(table(spark, folder, "orders"), "o_orderkey", TODAY, SEED)


@query("load_or_generate", "S5", f"""WITH {_generated_sql()}
SELECT subject, true_sentiment, count(*) AS n, round(avg(rating), 6) AS mean_rating,
       min(date) AS first_date, max(length(feedback_text)) AS longest
FROM generated GROUP BY ALL""")
def load_or_generate(spark, folder):
    path = scratch_path(spark, "sample")

    def make():
        return generated_feedback(spark, folder).drop("o_orderkey")

    files.load_or_generate(spark, path, make)  # made and stored
    df = files.load_or_generate(spark, path, make)  # found
    out = df.groupBy("subject", "true_sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"), F.min("date").alias("first_date"),
        F.max(F.length("feedback_text")).cast("bigint").alias("longest"),
    )
    return rounded(out, "mean_rating")


@query("literal_table_join", "S6", WITH_FB + """
SELECT sentiment, score, count(*) AS n FROM fb
JOIN (VALUES ('Positive', 1), ('Neutral', 0), ('Negative', -1)) AS v(sentiment, score) USING (sentiment)
GROUP BY ALL""")
def literal_table_join(spark, folder):
    scores = spark.createDataFrame([("Positive", 1), ("Neutral", 0), ("Negative", -1)], "sentiment string, score int")
    joined = feedback_from_orders(spark, folder).join(scores, "sentiment")
    return joined.groupBy("sentiment", "score").agg(F.count(F.lit(1)).alias("n"))


@query("import_feedback", "S8 S10", f"""
SELECT row_number() OVER (ORDER BY doc_id) AS id, CAST(NULL AS VARCHAR) AS student_id, source AS course_id,
       lang AS subject, md5(text) AS text_md5, CAST(NULL AS INTEGER) AS rating, DATE '{TODAY}' AS date
FROM documents""")
def import_documents(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("course_id"), F.col("lang").alias("subject"), F.col("text").alias("feedback_text")
    )
    out = import_feedback(docs, ["doc_id"], TODAY)
    return out.select("id", "student_id", "course_id", "subject", F.md5("feedback_text").alias("text_md5"), "rating", "date")


@query("store_sql", "S7 S9 U2", """
SELECT d.lang AS subject, CASE WHEN r.quality = 1 THEN 'Positive' ELSE 'Negative' END AS sentiment, count(*) AS n
FROM labels r JOIN documents x ON x.doc_id = r.doc_id
JOIN (SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text) m ON m.text = x.text
JOIN documents d ON d.doc_id = m.doc_id GROUP BY ALL""")
def store_sql(spark, folder):
    store = Store(spark, scratch_path(spark, "store"))
    store.create_tables()
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("subject"), F.col("text").alias("feedback_text")
    )
    store.import_feedback(docs, ["doc_id"], TODAY)
    labelled = labelled_documents(spark, folder).where("quality is not null")
    label = F.when(F.col("quality") == 1, "Positive").otherwise("Negative")
    store.store_sentiment(labelled.select("text", label.alias("predicted_sentiment")), "given")
    return store.query(
        "SELECT f.subject, s.sentiment, count(*) AS n FROM feedback f "
        "JOIN sentiment_analysis s ON f.id = s.feedback_id GROUP BY f.subject, s.sentiment"
    )


@query("table_shape", "S11", """
SELECT CAST(position AS INTEGER) AS position, column_name, n_rows FROM
 (SELECT unnest(range(0, 5)) AS position, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name),
 (SELECT count(*) AS n_rows FROM documents)""")
def table_shape(spark, folder):
    return rows.table_shape(table(spark, folder, "documents"))


@query("projection", "P1", WITH_FB + " SELECT id, rating, sentiment, category FROM fb")
def projection(spark, folder):
    return feedback_from_orders(spark, folder).select("id", "rating", "sentiment", "category")


@query("derived_column", "P2 X14", WITH_FB + """
SELECT id, 'category_' || replace(category, ' ', '_') AS column_label, upper(substr(subject, 1, 3)) || (id % 900 + 100) AS course_id FROM fb""")
def derived_column(spark, folder):
    from voxtide.functions.text import course_code

    fb = feedback_from_orders(spark, folder, subject=True)
    label = F.concat(F.lit("category_"), F.replace("category", F.lit(" "), F.lit("_")))
    return fb.select("id", label.alias("column_label"), course_code(F.col("subject"), F.col("id") % 900 + 100).alias("course_id"))


@query("date_range", "P3", WITH_FB + """
SELECT id, date, rating FROM fb WHERE date BETWEEN DATE '1997-02-01' AND DATE '1997-04-30'""")
def date_range(spark, folder):
    return rows.between_dates(feedback_from_orders(spark, folder), "date", "1997-02-01", "1997-04-30").select("id", "date", "rating")


@query("equality_filter", "P4", WITH_FB + " SELECT id, category, rating FROM fb WHERE sentiment = 'Negative'")
def equality_filter(spark, folder):
    return feedback_from_orders(spark, folder).where(F.col("sentiment") == "Negative").select("id", "category", "rating")


@query("drop_missing", "P5", """
SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""")
def drop_missing(spark, folder):
    return labelled_documents(spark, folder).dropna(subset=["quality"]).select("doc_id", "lang", "quality", "toxic")


@query("all_null_columns", "P6", """
WITH j AS (SELECT quality, lang, CAST(NULL AS VARCHAR) AS reviewer FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'quality' AS column_name, count(quality) = 0 AS all_null FROM j UNION ALL
SELECT 'lang', count(lang) = 0 FROM j UNION ALL SELECT 'reviewer', count(reviewer) = 0 FROM j""")
def all_null_columns(spark, folder):
    df = labelled_documents(spark, folder).withColumn("reviewer", F.lit(None).cast("string"))
    return rows.all_null(df, ["quality", "lang", "reviewer"])


@query("missing_values", "P7", """
WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS missing FROM j UNION ALL
SELECT 'lang', count(*) - count(lang) FROM j UNION ALL
SELECT 'quality', count(*) - count(quality) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j""")
def missing_values(spark, folder):
    return rows.missing_counts(labelled_documents(spark, folder).select("doc_id", "lang", "quality", "toxic"))


@query("case_label", "P8", WITH_FB + """
SELECT id, CASE WHEN rating >= 4 THEN 'High Volume' WHEN rating <= 2 THEN 'Low Volume' ELSE 'Normal' END AS kind FROM fb""")
def case_label(spark, folder):
    kind = F.when(F.col("rating") >= 4, "High Volume").when(F.col("rating") <= 2, "Low Volume").otherwise("Normal")
    return feedback_from_orders(spark, folder).select("id", kind.alias("kind"))


@query("submission_defaults", "P9", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' || conv_id ELSE 'anonymous' END AS student_id, 'unknown' AS course_id,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS sentiment FROM conversations""")
def submission_defaults(spark, folder):
    talk = table(spark, folder, "conversations")
    student = F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("conv_id").cast("string"))).otherwise("")
    out = rows.fill_defaults(talk.select("conv_id", "turn", student.alias("student_id")))
    return out.select("conv_id", "turn", "student_id", "course_id", "category", "sentiment")


@query("bulk_update", "P10", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END END AS lang,
       source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def bulk_update(spark, folder):
    base = table(spark, folder, "documents").select("doc_id", "lang", "source")
    changed = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    updates = table(spark, folder, "labels").select("doc_id", changed.alias("lang"), F.lit(1).alias("not_a_column"))
    return rows.update_rows(base, updates, "doc_id")


@query("unknown_update_keys", "P10 P11", """
SELECT doc_id, 'error' AS status, 'Feedback with ID ' || doc_id || ' not found' AS message
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unknown_update_keys(spark, folder):
    return rows.unknown_keys(table(spark, folder, "labels"), table(spark, folder, "documents"), "doc_id")


@query("bulk_delete", "P11", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def bulk_delete(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return rows.delete_rows(docs, table(spark, folder, "labels"), "doc_id")


KEPT = """WITH e AS (SELECT event_id, user_id, event_type, value FROM events), u AS (
  SELECT user_id AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id)"""


@query("edits_are_kept", "P10 P11", f"""{KEPT}
SELECT e.event_id, e.user_id, coalesce(u.event_type, e.event_type) AS event_type, e.value
FROM e LEFT JOIN u ON u.event_id = e.event_id WHERE e.event_id NOT IN (SELECT c_custkey * 7 FROM customer)""")
def edits_are_kept(spark, folder):
    """Events are stored, changed by each user's last event, some deleted, and read back by another handle."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "kept")
    kept = KeptTable(spark, path)
    kept.replace(events.select("event_id", "user_id", "event_type", "value"))
    last = F.struct("ts", "event_id")
    newest = events.select(F.col("user_id").alias("event_id"), "event_type", last.alias("told"))
    kept.update(newest, "event_id", "told")
    kept.delete(table(spark, folder, "customer").select((F.col("c_custkey") * 7).alias("event_id")), "event_id")
    return KeptTable(spark, path).table()


@query("series_round_trip", "S2b T3", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS count FROM events GROUP BY 1""")
def series_round_trip(spark, folder):
    path = scratch_path(spark, "series")
    days = table(spark, folder, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").alias("period")).count()
    files.write_series(days, path)
    return spark.read.schema("period date, count bigint").csv(path, header=True)


@query("preview", "P12", WITH_FB + " SELECT id, rating, sentiment, category FROM fb ORDER BY id LIMIT 5")
def preview(spark, folder):
    return feedback_from_orders(spark, folder).select("id", "rating", "sentiment", "category").orderBy("id").limit(5)


@query("random_sample", "P13", f"""{WITH_FB}
SELECT id, rating, sentiment FROM fb ORDER BY {_h('id', '')}, id LIMIT 50""")
def random_sample(spark, folder):
    return rows.sample_rows(feedback_from_orders(spark, folder).select("id", "rating", "sentiment"), "id", 50, SEED)


@query("train_test_split", "P14", f"""{WITH_FB}
SELECT CASE WHEN {_h('id', '')} < {int(0.7 * 2**32)} THEN 'train' ELSE 'test' END AS part, sentiment, count(*) AS n,
       CAST(sum(id) AS BIGINT) AS id_sum FROM fb GROUP BY ALL""")
def train_test_split(spark, folder):
    train, test = rows.split_rows(feedback_from_orders(spark, folder), "id", 0.7, SEED)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "sentiment").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("latest_feedback", "L1", WITH_FB + " SELECT id, date, rating FROM fb ORDER BY date DESC NULLS LAST, id LIMIT 100")
def latest_feedback(spark, folder):
    return rows.latest(feedback_from_orders(spark, folder).select("id", "date", "rating"), "date", "id", 100)


@query("oldest_feedback", "L1", """
SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
ORDER BY quality ASC NULLS LAST, d.doc_id LIMIT 500""")
def oldest_feedback(spark, folder):
    return rows.latest(labelled_documents(spark, folder).select("doc_id", "quality"), "quality", "doc_id", 500, ascending=True)


@query("latest_in_store", "L2", """
SELECT o_orderkey AS id, o_orderpriority AS feedback_text, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY date DESC, id LIMIT 100""")
def latest_in_store(spark, folder):
    store = Store(spark, scratch_path(spark, "store"))
    store.create_tables()
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("feedback_text"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    store.append("feedback", orders)
    return store.feedback(100).select("id", "feedback_text", "date")


@query("first_rows_per_group", "L5", """
SELECT lang, doc_id, text, rank FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 3""")
def first_rows_per_group(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "doc_id", "text")
    return rows.first_per_group(docs, "lang", [F.asc("doc_id")], 3)


@query("append_submissions", "S3 U1 U2 X12 X13", f"""
WITH base AS (SELECT printf('F%06d', doc_id + 1) AS feedback_id, lang AS subject, md5(text) AS text_md5 FROM documents),
     top AS (SELECT max(doc_id) + 1 AS n FROM documents)
SELECT feedback_id, CAST(NULL AS VARCHAR) AS student_id, subject, text_md5, CAST(NULL AS DATE) AS date FROM base UNION ALL
SELECT printf('F%06d', (SELECT n FROM top) + row_number() OVER (ORDER BY conv_id, turn)), 'anonymous', role, md5(text), DATE '{TODAY}'
FROM conversations""")
def append_submissions(spark, folder):
    path = scratch_path(spark, "collected")
    files.ensure_collection(spark, path)
    docs = table(spark, folder, "documents").select(
        F.format_string("F%06d", F.col("doc_id") + 1).alias("feedback_id"), F.col("lang").alias("subject"),
        F.col("text").alias("feedback_text"),
    )
    full = docs.select(
        *[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in COLLECTED.fields]
    )
    full.write.mode("append").parquet(path)
    talk = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("role").alias("subject"), F.col("text").alias("feedback_text")
    )
    out = rows.append_feedback(files.ensure_collection(spark, path), talk, ["conv_id", "turn"], TODAY)
    return out.select("feedback_id", "student_id", "subject", F.md5("feedback_text").alias("text_md5"), "date")


@query("distinct_values", "U3", WITH_FB + " SELECT DISTINCT category FROM fb")
def distinct_values(spark, folder):
    return feedback_from_orders(spark, folder).select("category").distinct()


@query("parse_dates", "X11 X12", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS parsed, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later,
       CAST(NULL AS DATE) AS bad FROM orders""")
def parse_dates(spark, folder):
    from voxtide.functions.dates import parse_date

    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), "o_orderpriority"
    )
    parsed = orders.withColumn("parsed", parse_date(F.col("text")))
    return parsed.select("id", "parsed", F.date_add("parsed", 30).alias("later"),
                         parse_date(F.col("o_orderpriority")).alias("bad"))


@query("feedback_codes", "X13", "SELECT doc_id, printf('F%06d', doc_id) AS feedback_id FROM documents")
def feedback_codes(spark, folder):
    from voxtide.functions.text import feedback_code

    return table(spark, folder, "documents").select("doc_id", feedback_code(F.col("doc_id")).alias("feedback_id"))
