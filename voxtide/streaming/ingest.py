"""Submissions as a stream: collection, roll-up and scoring on arrival."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.operators.rows import fill_defaults
from voxtide.session import materialize, scratch_path


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Files of one table as they arrive: in the folder named {name}.parquet, or the one file of that name.

    A glob filter is held against the names of files, so it finds nothing in a table that is a folder itself.
    """
    path = f"{folder}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a column; zone-less timestamps become timestamps first."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def collect_submissions(df: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Submissions with defaults filled in; a repeated key within the delay is dropped.

    State is kept for the delay only. `collect_once` also drops what repeats later.
    """
    return event_time(fill_defaults(df), time, delay).dropDuplicatesWithinWatermark(list(keys))


def volume_per_day(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Count and mean per day and key; a day is emitted once the watermark has passed it."""
    grouped = event_time(df, time, delay).groupBy(F.window(time, "1 day"), *keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean")
    )
    return grouped.select(F.col("window.start").cast("date").alias("period"), *keys, "count", "mean")


def score_stream(df: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score rows as they arrive with a fitted scorer or the word lists; no state is kept."""
    return score(df)


def run_available(df: DataFrame, label: str) -> DataFrame:
    """Process what has arrived so far into Parquet files and return them as a table."""
    spark = df.sparkSession
    out, progress = scratch_path(spark, f"{label}-rows"), scratch_path(spark, f"{label}-progress")
    query = (
        df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def write_batches(df: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, progress: str) -> None:
    """Process what has arrived so far batch by batch; each batch has a folder of its own.

    `work` is any batch job (a fitted scorer, say) from the rows of a batch to result rows. A batch that
    is run again after a failure replaces its own folder, so that no row is there twice or missing.
    """

    def store(rows: DataFrame, batch: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    df.writeStream.foreachBatch(store).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def score_new(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], label: str = "scored") -> DataFrame:
    """Score what has arrived with a fitted scorer and return the stored rows."""
    spark = df.sparkSession
    folder, progress = scratch_path(spark, f"{label}-rows"), scratch_path(spark, f"{label}-progress")
    schema = scorer(spark.createDataFrame([], df.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/batch=-1")  # where nothing has arrived yet
    write_batches(df, scorer, folder, progress)
    return spark.read.parquet(folder).drop("batch")


ARRIVAL = "arrival"  # folder column of a store of submissions: source and batch


def collect_once(df: DataFrame, keys: Sequence[str], time: str, folder: str, progress: str, source: str = "submissions") -> None:
    """Add what has arrived to the store in `folder`, each key once, however late it repeats.

    A batch keeps the first row of a key by time (ties: smallest hash of the row) and leaves out the keys that
    other batches have stored, of this source or another one. Only the key columns of the store are read, and of
    them only those of the batch are kept. Rows with a null in a key cannot repeat and are all stored. A batch that
    runs again replaces its own rows. Where `progress` is lost, go on under another name of the source: what is stored
    stays, and nothing is stored twice. Sources of one store run one after the other.
    """
    if ARRIVAL in df.columns:
        raise ValueError(f"column {ARRIVAL} is the store's own")
    spark, keys = df.sparkSession, list(keys)
    schema = fill_defaults(df).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{ARRIVAL}={source}-start")

    def store(rows: DataFrame, batch: int) -> None:
        own = f"{source}-{batch}"
        named = F.lit(True)
        for key in keys:
            named = named & F.col(key).isNotNull()
        rows = fill_defaults(rows)
        row = F.struct(*[F.col(c) for c in schema.names])
        firsts = rows.where(named).groupBy(*keys).agg(F.min_by(row, F.struct(F.col(time), F.xxhash64(*schema.names))).alias("row"))
        firsts = materialize(firsts.select("row.*"), "arrived")  # the planner knows its size
        stored = rows.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField(ARRIVAL, T.StringType())])).parquet(folder)
        known = stored.where(F.col(ARRIVAL) != own).select(*keys).join(firsts.select(*keys), keys, "left_semi")
        fresh = firsts.join(materialize(known, "known"), keys, "left_anti").select(*schema.names)
        fresh.unionByName(rows.where(~named)).write.mode("overwrite").parquet(f"{folder}/{ARRIVAL}={own}")

    df.writeStream.foreachBatch(store).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def collected(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a store of submissions."""
    return spark.read.parquet(folder).drop(ARRIVAL)
