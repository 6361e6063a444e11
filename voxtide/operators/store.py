"""The relational store: feedback, analysis results and topics as Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators.numbering import number_rows
from voxtide.schemas import STORE, require_columns
from voxtide.session import materialize


def text_key(text: Column) -> Column:
    """Join key for texts: 32 bytes move through the shuffle instead of whole texts."""
    return F.unhex(F.sha2(text, 256))


def prepare_import(df: DataFrame, today: str) -> DataFrame:
    """Feedback rows with all store columns: missing ones null, a missing date column today."""
    require_columns(df, ["feedback_text"])
    out = []
    for field in STORE["feedback"].fields:
        if field.name in ("id", "created_at"):
            continue
        if field.name in df.columns:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == "date":
            out.append(F.lit(today).cast("date").alias("date"))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)


def import_feedback(df: DataFrame, order_by: Sequence[str], today: str, start: int = 1) -> DataFrame:
    """Import rows with integer ids that follow the given total order.

    Order columns outside the store's columns number the rows and are dropped.
    """
    extra = [c for c in order_by if c not in STORE["feedback"].fieldNames()]
    prepared = prepare_import(df, today)
    if extra:
        require_columns(df, extra)
        kept = [F.col(c) for c in extra]
        fields = [f.name for f in STORE["feedback"].fields if f.name not in ("id", "created_at")]
        given = [F.col(c).cast(STORE["feedback"][c].dataType).alias(c) for c in fields if c in df.columns]
        missing = [
            (F.lit(today).cast("date") if c == "date" else F.lit(None).cast(STORE["feedback"][c].dataType)).alias(c)
            for c in fields
            if c not in df.columns
        ]
        prepared = df.select(*kept, *given, *missing)
    return number_rows(prepared, list(order_by), start).drop(*extra)


def ids_by_text(feedback: DataFrame, key: str = "id", text: str = "feedback_text") -> DataFrame:
    """The id each text resolves to: the last one when a text occurs more than once."""
    keyed = feedback.select(text_key(F.col(text)).alias("_text"), F.col(key).alias("feedback_id"))
    return keyed.where(F.col("_text").isNotNull()).groupBy("_text").agg(
        F.max("feedback_id").alias("feedback_id")
    )


def resolve(results: DataFrame, feedback: DataFrame, key: str = "id", text: str = "feedback_text") -> DataFrame:
    """Attach feedback ids to result rows by text; rows with unknown texts are dropped.

    The ids have one row per text, so a text repeated in the results is hot on one side
    only. They are written out first: the planner then knows their size, and the
    adaptive skew join, which splits plain shuffles only, can split the hot text.
    """
    require_columns(results, ["text"])
    keyed = results.withColumn("_text", text_key(F.col("text"))).drop("text")
    return keyed.join(materialize(ids_by_text(feedback, key, text), "ids"), "_text").drop("_text")


def known_texts(feedback: DataFrame, results: DataFrame, text: str = "feedback_text") -> DataFrame:
    """Feedback rows whose text occurs in the results."""
    wanted = results.select(text_key(F.col("text")).alias("_text")).where("_text is not null").distinct()
    keyed = feedback.withColumn("_text", text_key(F.col(text)))
    return keyed.join(materialize(wanted, "texts"), "_text", "left_semi").drop("_text")


def label_rows(
    results: DataFrame, feedback: DataFrame, label: str, model: str,
    key: str = "id", text: str = "feedback_text",
) -> DataFrame:
    """Rows for the sentiment or category table (`label` names which) from scored texts."""
    require_columns(results, ["text", f"predicted_{label}"])
    if "confidence" not in results.columns:
        results = results.withColumn("confidence", F.lit(0.0))
    wanted = results.select("text", f"predicted_{label}", "confidence")
    return resolve(wanted, feedback, key, text).select(
        "feedback_id", F.col(f"predicted_{label}").alias(label),
        F.col("confidence").cast("double").alias("confidence"), F.lit(model).alias("model"),
    )


def topic_rows(topics: DataFrame, model: str, start: int = 1) -> DataFrame:
    """Topic table from (topic, words): 0-based topic numbers become 1-based names."""
    number = F.col("topic") + 1
    return topics.select(
        (F.col("topic") + start).cast("bigint").alias("id"),
        F.concat(F.lit("Topic "), number.cast("string")).alias("name"),
        F.concat(F.lit("Automatically generated topic "), number.cast("string")).alias("description"),
        F.array_join("words", ", ").alias("top_words"),
        F.lit(model).alias("model"),
    )


def topic_analysis_rows(
    distribution: DataFrame, feedback: DataFrame, model: str, start: int = 1,
    key: str = "id", text: str = "feedback_text",
) -> DataFrame:
    """(feedback, topic, probability) rows from texts with an array of probabilities."""
    resolved = resolve(distribution.select("text", "probabilities"), feedback, key, text)
    return resolved.select("feedback_id", F.posexplode("probabilities").alias("_t", "probability")).select(
        "feedback_id", (F.col("_t") + start).cast("bigint").alias("topic_id"), "probability",
        F.lit(model).alias("model"),
    )


def _with_text(best: DataFrame, feedback: DataFrame, key: str, text: str) -> DataFrame:
    """Fetch texts for the chosen rows; they are written first, so that the planner knows their size."""
    return materialize(best, "chosen").join(feedback.select(F.col(key).alias("id"), text), "id")


def labelled_feedback(
    feedback: DataFrame, analysis: DataFrame, label: str, limit: int = 100, newest: str = "created_at",
    key: str = "id", text: str = "feedback_text",
) -> DataFrame:
    """Feedback with its analysis rows, newest first.

    The rows are chosen on narrow columns first; texts are read for the chosen ones
    only, so that no text passes a shuffle.
    """
    ids = feedback.select(F.col(key).alias("id"))
    narrow = analysis.select(
        F.col("feedback_id").alias("id"), label, "confidence", "model", F.col(newest).alias("created_at"),
    )
    order = [F.desc_nulls_last("created_at"), F.asc("id"), F.asc(label), F.asc("confidence"), F.asc("model")]
    best = ids.join(narrow, "id").orderBy(*order).limit(limit)
    return _with_text(best, feedback, key, text).orderBy(*order).select(
        "id", text, label, "confidence", "model", "created_at"
    )


def topic_feedback(
    feedback: DataFrame, analysis: DataFrame, topics: DataFrame, limit: int = 100,
    key: str = "id", text: str = "feedback_text",
) -> DataFrame:
    """Feedback with topics, highest probability first."""
    ids = feedback.select(F.col(key).alias("id"))
    narrow = analysis.select(F.col("feedback_id").alias("id"), "topic_id", "probability")
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), "top_words")
    order = [F.desc_nulls_last("probability"), F.asc("id"), F.asc("topic_id")]
    best = narrow.join(ids, "id", "left_semi").join(names, "topic_id").orderBy(*order).limit(limit)
    return _with_text(best, feedback, key, text).orderBy(*order).select(
        "id", text, "topic_name", "top_words", "probability"
    )


class Store:
    """Five Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        if name not in STORE:
            raise ValueError(f"unknown table: {name}")
        return f"{self.folder}/{name}"

    def create_tables(self) -> None:
        """Create the tables that do not exist yet."""
        for name, schema in STORE.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(STORE[name]).parquet(self.path(name))

    def register_views(self) -> None:
        for name in STORE:
            self.table(name).createOrReplaceTempView(name)

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def append(self, name: str, rows: DataFrame, order_by: Sequence[str] = ()) -> int:
        """Append rows (numbered unless they bring ids); returns how many.

        Rows are counted before and after in the file footers. An observation of the write would
        stay in the session, and fitted two-class models, which hold the session, could no longer be
        sent to executors.
        """
        if "id" not in rows.columns:
            rows = number_rows(rows, list(order_by), self.next_id(name))
        schema = STORE[name]
        rows = rows.withColumn("created_at", F.current_timestamp())
        full = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        before = self.table(name).count()
        full.write.mode("append").parquet(self.path(name))
        return self.table(name).count() - before

    def import_feedback(self, df: DataFrame, order_by: Sequence[str], today: str) -> int:
        return self.append("feedback", import_feedback(df, order_by, today, self.next_id("feedback")))

    def store_sentiment(self, results: DataFrame, model: str) -> int:
        return self.append("sentiment_analysis", label_rows(results, self.table("feedback"), "sentiment", model))

    def store_category(self, results: DataFrame, model: str) -> int:
        return self.append("category_analysis", label_rows(results, self.table("feedback"), "category", model))

    def store_topics(self, topics: DataFrame, model: str) -> int:
        """Store topics; returns the id of the first one."""
        start = self.next_id("topics")
        self.append("topics", topic_rows(topics, model, start))
        return start

    def store_topic_analysis(self, distribution: DataFrame, model: str, first_topic: int) -> int:
        rows = topic_analysis_rows(distribution, self.table("feedback"), model, first_topic)
        return self.append("topic_analysis", rows)

    def feedback(self, limit: int = 100) -> DataFrame:
        return self.table("feedback").orderBy(F.desc_nulls_last("date"), "id").limit(limit)

    def sentiment(self, limit: int = 100) -> DataFrame:
        return labelled_feedback(self.table("feedback"), self.table("sentiment_analysis"), "sentiment", limit)

    def category(self, limit: int = 100) -> DataFrame:
        return labelled_feedback(self.table("feedback"), self.table("category_analysis"), "category", limit)

    def topics(self, limit: int = 100) -> DataFrame:
        return topic_feedback(
            self.table("feedback"), self.table("topic_analysis"), self.table("topics"), limit
        )

    def query(self, sql: str) -> DataFrame:
        """Run SQL over the store's tables."""
        self.register_views()
        return self.spark.sql(sql)


def exists(spark: SparkSession, path: str, reader: str = "parquet") -> bool:
    try:
        spark.read.format(reader).load(path)
    except AnalysisException:
        return False
    return True
