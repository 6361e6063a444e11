"""Sentiment from word lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default positive and negative words.
POSITIVE = ("excellent", "great", "good", "helpful", "outstanding", "enjoyed", "useful")
NEGATIVE = ("poor", "bad", "disappointing", "inadequate", "below", "difficult", "struggled")


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur anywhere in the text, each counted once."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def score_sentiment(
    df: DataFrame,
    text_column: str = "feedback_text",
    positive: Sequence[str] = POSITIVE,
    negative: Sequence[str] = NEGATIVE,
) -> DataFrame:
    """Add `predicted_sentiment` and `confidence`; more distinct hits win, a tie is neutral."""
    lowered = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    counted = df.withColumn("_lead", hits(lowered, positive) - hits(lowered, negative))
    lead = F.col("_lead")
    return counted.select(
        *df.columns,
        F.when(lead > 0, "Positive").when(lead < 0, "Negative").otherwise("Neutral").alias(
            "predicted_sentiment"
        ),
        F.when(lead == 0, F.lit(0.5))
        .otherwise(F.least(F.lit(0.5) + F.abs(lead) * 0.1, F.lit(0.9)))
        .alias("confidence"),
    )
