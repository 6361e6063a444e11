"""Stored tables whose rows can be changed: every edit writes a new version and swaps it in.

A version is a folder of Parquet files. It counts once its write is complete, which the committer
marks with a file of its own; readers take the highest complete version. So an edit that fails, or
whose executors are lost for good, leaves the table as it was, and readers of the version before go on.
One writer at a time: two that start from the same version write the same folder, and the second fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtide.operators.rows import delete_rows, unknown_keys, update_rows


class KeptTable:
    """A table below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        top = self._path(self.folder)
        if not self._files.exists(top):
            return []
        found = []
        for entry in self._files.listStatus(top):
            name = entry.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and self._files.exists(self._path(entry.getPath(), "_SUCCESS")):
                found.append(int(name[1:]))
        return sorted(found)

    def _version_path(self, version: int) -> str:
        return f"{self.folder}/v{version:09d}"

    def table(self, version: int | None = None) -> DataFrame:
        """The rows of the current version, or of an earlier one that is still there."""
        known = self.versions()
        wanted = known[-1:] if version is None else [v for v in known if v == version]
        if not wanted:
            raise ValueError(f"no such table or version: {self.folder}")
        return self.spark.read.parquet(self._version_path(wanted[0]))

    def replace(self, df: DataFrame) -> int:
        """Make these rows the table; returns the number of the version."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        path = self._version_path(version)
        if self._files.exists(self._path(path)):  # left by an edit that failed
            df.write.mode("overwrite").parquet(path)
        else:
            df.write.mode("errorifexists").parquet(path)
        return version

    def update(self, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
        """Change rows by key (see `update_rows`); returns the keys that are not in the table."""
        before = self.table()
        self.replace(update_rows(before, updates, key, order))
        return unknown_keys(before, updates, key)

    def delete(self, keys: DataFrame, key: str) -> DataFrame:
        """Delete rows by key; returns the keys that were not in the table."""
        before = self.table()
        self.replace(delete_rows(before, keys, key).select(*before.columns))
        return unknown_keys(before, keys, key)

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        for version in self.versions()[:-max(keep, 1)]:
            self._files.delete(self._path(self._version_path(version)), True)
