"""Star-schema tables and their view as feedback tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feedback_from_orders(spark: SparkSession, folder: str, subject: bool = False) -> DataFrame:
    """Orders as rated, dated and labelled feedback; `subject` needs a join, so it is optional."""
    orders = table(spark, folder, "orders")
    price = F.col("o_totalprice")
    status = F.col("o_orderstatus")
    out = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("student"),
        F.col("o_orderpriority").alias("category"),
        F.when(status == "F", "Negative").when(status == "O", "Neutral").otherwise("Positive").alias(
            "sentiment"
        ),
        (1 + F.least(F.lit(4), F.floor(price / 100000))).cast("int").alias("rating"),
        price.alias("amount"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    if not subject:
        return out
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("student"), F.col("c_mktsegment").alias("subject")
    )
    return out.join(customers, "student", "left")


# The same view for SQL engines.
FEEDBACK_SQL = """fb AS (
  SELECT o_orderkey AS id, o_custkey AS student, o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN 'Negative' WHEN 'O' THEN 'Neutral' ELSE 'Positive' END AS sentiment,
         CAST(1 + least(4, floor(o_totalprice / 100000)) AS INTEGER) AS rating,
         o_totalprice AS amount, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS subject
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality and toxicity labels (null where unlabelled)."""
    labels = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(labels, "doc_id", "left")


def fingerprint(spark: SparkSession, folder: str, names: list[str]) -> tuple:
    """Name, size and time of change of the files of some tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        found = path.getFileSystem(conf).globStatus(path)
        for top in found or []:
            for f in top.getPath().getFileSystem(conf).listStatus(top.getPath()):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
