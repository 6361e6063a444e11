"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from voxtide.plans.catalog import QUERIES
from voxtide.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")

HEADLINE = [
    "flagship", "volume_by_week", "sentiment_trend", "combined_series", "anomalies_per_key", "collection_stats",
    "crosstab_fractions", "describe", "rating_box_plot", "value_box_plot", "word_frequencies",
    "word_frequencies_by_language", "lemmatize", "term_counts", "tfidf", "tfidf_of_new_texts", "lexicon_sentiment",
    "sentiment_of_feedback", "topics_of_feedback", "store_sentiment_rows", "classification_report",
    "generated_feedback", "import_feedback", "window_pair_counts", "naive_bayes_predictions", "clustering_scores",
    "density_clusters", "kmeans_clusters", "svd_reduction", "lda_topics", "nmf_topics", "stream_volume",
]


def main() -> None:
    spark = build_session(
        "bench", **{
            "spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rating_counts"].run(spark, FOLDER).collect()  # start the session
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
