"""Feedback files: CSV in and out, empty collections, generated samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.functions.hashing import hash_pick
from voxtide.functions.text import course_code
from voxtide.schemas import COLLECTED, FEEDBACK
from voxtide.sources.csv_ranges import read_quoted_csv

# Fixed values of generated feedback.
SUBJECTS = ["Mathematics", "Computer Science", "Physics", "Chemistry", "Biology", "History", "Literature",
            "Economics", "Psychology"]
CATEGORIES = ["Course Content", "Teaching Quality", "Assessment Methods", "Learning Resources", "Facilities",
              "Support Services"]
SHARES = {"Positive": 60, "Neutral": 25, "Negative": 15}  # percent
RATINGS = {"Positive": (4, 5), "Neutral": (3, 4), "Negative": (1, 3)}
TEMPLATES = {
    "Positive": [
        "I really enjoyed the {subject} course. The {category} was excellent.",
        "The {category} in the {subject} class exceeded my expectations.",
        "Great {category} in the {subject} course, very helpful for my learning.",
        "The instructor's {category} approach in {subject} was outstanding.",
        "I found the {category} in {subject} to be very well organized and useful.",
    ],
    "Neutral": [
        "The {category} in the {subject} course was adequate.",
        "I think the {category} in {subject} was average, nothing special.",
        "The {subject} course had reasonable {category}, but could be improved.",
        "The {category} in {subject} met the basic requirements.",
        "Neither good nor bad {category} in the {subject} course.",
    ],
    "Negative": [
        "I was disappointed with the {category} in the {subject} course.",
        "The {category} in {subject} needs significant improvement.",
        "Poor {category} made the {subject} course difficult to follow.",
        "I struggled with {subject} due to inadequate {category}.",
        "The {category} in the {subject} class was below standard.",
    ],
}
DAYS_BACK = 365


def read_csv(spark: SparkSession, path: str, schema: T.StructType = FEEDBACK) -> DataFrame:
    """Feedback from CSV files with a header; texts may hold quotes and line breaks.

    Files are read by ranges, so that a large file is the work of many tasks.
    """
    return read_quoted_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; texts are written as they are, blanks at their ends included."""
    df.write.mode("errorifexists").csv(
        path, header=True, quote='"', escape='"', dateFormat="yyyy-MM-dd",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_series(series: DataFrame, path: str, period: str = "period") -> None:
    """A period series as CSV, its period in the first column (as a date), rows in order of time within files."""
    ordered = series.select(F.col(period).cast("date").alias(period), *[c for c in series.columns if c != period])
    write_csv(ordered.repartitionByRange(period).sortWithinPartitions(period), path)


def ensure_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collected feedback, created empty with its columns if it does not exist."""
    spark.createDataFrame([], COLLECTED).write.mode("ignore").parquet(path)
    return spark.read.schema(COLLECTED).parquet(path)


def _choose(items: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(i) for i in items]), at)


def generate(keys: DataFrame, key: str, end_date: str, seed: int = 42) -> DataFrame:
    """One feedback row per key, drawn from the key and the seed alone."""
    k = F.col(key)

    def pick(what: str, n: int) -> Column:
        return hash_pick(k, f"{seed}:{what}", n)

    positive, neutral = SHARES["Positive"], SHARES["Positive"] + SHARES["Neutral"]
    draw = pick("sentiment", 100)
    drawn = keys.select(
        key,
        _choose(SUBJECTS, pick("subject", len(SUBJECTS))).alias("subject"),
        _choose(CATEGORIES, pick("category", len(CATEGORIES))).alias("true_category"),
        F.when(draw < positive, "Positive").when(draw < neutral, "Neutral").otherwise("Negative").alias("true_sentiment"),
    )
    text = rating = F.lit(None)
    for name, (low, high) in RATINGS.items():
        here = F.col("true_sentiment") == name
        text = F.when(here, _choose(TEMPLATES[name], pick("template", len(TEMPLATES[name])))).otherwise(text)
        rating = F.when(here, low + pick("rating", high - low + 1)).otherwise(rating)
    text = F.replace(F.replace(text, F.lit("{subject}"), F.col("subject")), F.lit("{category}"), F.col("true_category"))
    return drawn.select(
        key,
        F.concat(F.lit("S"), (10000 + pick("student", 90000)).cast("string")).alias("student_id"),
        course_code(F.col("subject"), 100 + pick("course", 900)).alias("course_id"),
        "subject",
        text.alias("feedback_text"),
        rating.cast("int").alias("rating"),
        F.date_sub(F.lit(end_date).cast("date"), pick("day", DAYS_BACK + 1)).alias("date"),
        "true_category",
        "true_sentiment",
    )


def generate_sample(spark: SparkSession, n: int, end_date: str, seed: int = 42) -> DataFrame:
    """n generated rows."""
    return generate(spark.range(n), "id", end_date, seed).drop("id")


def load_or_generate(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The feedback stored at the path; if there is none, make it, store it and return it."""
    try:
        spark.read.text(path).schema
    except AnalysisException:
        write_csv(make(), path)
    return read_csv(spark, path)
