"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. All but the first three are Spark defaults;
# they are written out because the plans count on them (hot join keys are split
# by the adaptive skew join, small sides are broadcast by measured size only).
# Batches for Python hold so many bytes at most, however long the texts are.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def apply_settings(spark: SparkSession) -> None:
    """Set what the plans rely on in a session that was built elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def build_session(app: str = "voxtide", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ROOTS: dict[str, str] = {}  # by application; removed by its JVM when it ends


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below the one the cluster names in spark.checkpoint.dir.

    Where none is named, it lies in the warehouse, which is shared as well. The folder is
    removed when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{app}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[app] = files.makeQualified(path).toString()
    return _ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage for iterative jobs, survives the loss of executors, and
    gives the planner a true size for choosing between broadcast and shuffle.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
