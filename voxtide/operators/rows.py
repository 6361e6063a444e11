"""Row-level edits: defaults, updates, deletions, samples, splits, top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.functions.hashing import SPAN, hash_int
from voxtide.functions.text import feedback_code
from voxtide.operators.numbering import number_rows

# What a submission gets where a field is missing.
DEFAULTS = {"student_id": "anonymous", "course_id": "unknown", "category": None, "sentiment": None}


def fill_defaults(df: DataFrame) -> DataFrame:
    """Give submissions their optional fields; an empty string counts as missing."""
    out = {}
    for name, value in DEFAULTS.items():
        given = F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None)
        out[name] = F.coalesce(given.cast("string"), F.lit(value).cast("string"))
    return df.withColumns(out)


def between_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows from `start` to midnight of `end`, both included."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def missing_counts(df: DataFrame) -> DataFrame:
    """Number of nulls per column, in one pass."""
    counted = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "missing")


def all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column, whether it holds no value at all."""
    counted = df.select(*[(F.count(c) == 0).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "all_null")


def table_shape(df: DataFrame) -> DataFrame:
    """One row per column with its position and the number of rows of the table."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.posexplode(names).alias("position", "column_name"), "n_rows"
    )


def update_rows(base: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Apply a table of updates; fields unknown to the base are ignored.

    Of several updates of one key the one with the largest `order` wins (nulls are oldest, ties go by a
    hash of the values), whatever files the updates lie in. Without such a column it is the last one in
    the order the table is read, which holds for a single file only. `order` itself is not a field.
    """
    fields = [c for c in updates.columns if c not in (key, order) and c in base.columns]
    last = F.max_by(F.struct(*[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit")), "_place")
    place = F.monotonically_increasing_id() if order is None else F.struct(
        F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), F.xxhash64(*[F.col(c) for c in fields] or [F.lit(0)]).alias("tie"))
    changes = updates.withColumn("_place", place).groupBy(F.col(key).alias("_key")).agg(last.alias("_last"))
    changes = changes.select("_key", "_last.*")
    joined = base.join(changes, base[key] == changes["_key"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}").cast(base.schema[c].dataType))
            .otherwise(base[c])
            .alias(c)
            if c in fields
            else base[c]
            for c in base.columns
        ]
    )


def delete_rows(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def unknown_keys(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys of an update or deletion that the base does not hold, with an error message."""
    missing = changes.select(key).join(base.select(key), key, "left_anti")
    text = F.concat(F.lit("Feedback with ID "), F.col(key).cast("string"), F.lit(" not found"))
    return missing.select(key, F.lit("error").alias("status"), text.alias("message"))


def latest(
    df: DataFrame, by: str, key: str, limit: int | None = None, ascending: bool = False
) -> DataFrame:
    """Rows sorted by a column, nulls last, ties by key; with a limit this is a top-k."""
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    out = df.orderBy(order, F.col(key))
    return out if limit is None else out.limit(limit)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows picked by key hash: the same rows on every run and partitioning."""
    return df.orderBy(hash_int(F.col(key), seed), F.col(key)).limit(n)


def in_train(key: Column, train_share: float = 0.7, seed: int = 42) -> Column:
    return hash_int(key, seed) < F.lit(int(train_share * SPAN))


def split_rows(
    df: DataFrame, key: str, train_share: float = 0.7, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. Shares are approximate, membership depends on the key only."""
    train = in_train(F.col(key), train_share, seed)
    return df.where(train), df.where(~train)


def first_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """First n rows of each group; the planner limits groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def append_feedback(existing: DataFrame, submitted: DataFrame, order_by: list, today: str) -> DataFrame:
    """Existing rows plus numbered submissions.

    Numbers go on from the highest one in use, so that ids stay unique after deletions.
    """
    code = F.regexp_extract("feedback_id", r"(\d+)$", 1).try_cast("bigint")
    highest = existing.agg(F.max(code)).first()[0] or 0
    numbered = number_rows(fill_defaults(submitted), order_by, start=highest + 1, name="_number")
    added = numbered.withColumns(
        {"feedback_id": feedback_code(F.col("_number")), "date": F.lit(today).cast("date")}
    )
    added = added.select(*[c for c in existing.columns if c in added.columns])
    return existing.unionByName(added, allowMissingColumns=True)
