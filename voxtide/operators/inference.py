"""Scoring texts with a model that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Model labels and the classes they stand for; others are neutral.
CLASS_OF = {"POSITIVE": "Positive", "NEGATIVE": "Negative"}

Model = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def score_with_model(df: DataFrame, text: str, load: Callable[[], Model]) -> DataFrame:
    """Add `predicted_sentiment` and `confidence` from a model; only the text is sent to Python.

    `load` is called once per task and returns a function from texts to (label, score)
    pairs. A text the model fails on is neutral with confidence 0.
    """
    @F.pandas_udf("predicted_sentiment string, confidence double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def one_by_one(texts: list[str]) -> list[tuple[str, float]]:
            out = []
            for t in texts:
                try:
                    out.append(tuple(model([t])[0]))
                except Exception:
                    out.append(("", 0.0))
            return out

        for batch in batches:
            texts = batch.fillna("").tolist()
            try:
                found = list(model(texts))
            except Exception:
                found = one_by_one(texts)
            yield pd.DataFrame({
                "predicted_sentiment": [CLASS_OF.get(label, "Neutral") for label, _ in found],
                "confidence": [float(value) for _, value in found],
            })

    return df.withColumn("_scored", score(F.col(text))).select(*df.columns, "_scored.*")
