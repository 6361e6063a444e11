"""Declared schemas of feedback tables and of the relational store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


FEEDBACK = _struct(
    "student_id string, course_id string, subject string, feedback_text string, "
    "rating int, date date, true_category string, true_sentiment string"
)

COLLECTED = _struct(
    "feedback_id string, student_id string, course_id string, subject string, "
    "feedback_text string, rating int, date date, category string, sentiment string"
)

STORE = {
    "feedback": _struct(
        "id bigint, student_id string, course_id string, subject string, "
        "feedback_text string, rating int, date date, created_at timestamp"
    ),
    "sentiment_analysis": _struct(
        "id bigint, feedback_id bigint, sentiment string, confidence double, "
        "model string, created_at timestamp"
    ),
    "category_analysis": _struct(
        "id bigint, feedback_id bigint, category string, confidence double, "
        "model string, created_at timestamp"
    ),
    "topic_analysis": _struct(
        "id bigint, feedback_id bigint, topic_id bigint, probability double, "
        "model string, created_at timestamp"
    ),
    "topics": _struct(
        "id bigint, name string, description string, top_words string, "
        "model string, created_at timestamp"
    ),
}


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise at plan time when a needed column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"required column(s) missing: {', '.join(missing)}")
    return df
