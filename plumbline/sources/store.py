"""The corpus as Parquet tables in a folder: made, read whole or by key, appended to, replaced.

A table is a folder of versions; the newest complete one counts, so that a batch can read
a version while it writes the next, and a failed write leaves the old one in place.
Tables are sorted by their key within files, so that a scan by key skips row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each table's columns and the key that its rows are looked up and sorted by.
TABLES = {
    "observations": ("obs_id long, asin string, observed_at timestamp, displayed_rating double, total_ratings long, title_hash string, histogram string", "asin"),
    "reviews": ("asin string, review_key string, rating long, review_date date, verified boolean, helpful_votes long, reviewer_hash string, word_count long, first_seen date, last_seen date", "reviewer_hash"),
    "shingles": ("shingle_hash string, asin string, sightings long, last_counted date", "shingle_hash"),
    "shingle_days": ("shingle_hash string, day date", "shingle_hash"),
    "cache": ("asin string, payload string, computed_at timestamp", "asin"),
    "meta": ("key string, value string", "key"),
}


class Store:
    """The corpus tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self) -> None:
        """Empty tables where there are none yet."""
        for name, (schema, _) in TABLES.items():
            if not self._versions(name):
                self.replace(name, self.spark.createDataFrame([], schema))

    def _versions(self, name: str) -> list[int]:
        """Numbers of the complete versions of a table."""
        if not self._fs.exists(self._path(name)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(name))]
        return sorted(int(v) for v in found if v.isdigit() and self._fs.exists(self._path(name, v, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name][0]).parquet(f"{self.root}/{name}/{self._versions(name)[-1]}")

    def scan(self, name: str, *keys: str, by: str | None = None) -> DataFrame:
        """The rows of some keys; the filter reaches the files."""
        return self.read(name).where(F.col(by or TABLES[name][1]).isin(*keys))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The next version of a table, which may be computed from the last one."""
        schema, key = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        version = max(self._versions(name), default=-1) + 1
        rows.select(*[_typed(c, schema) for c in columns]).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.root}/{name}/{version}")

    def append(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def prune(self, name: str, keep: int = 2) -> None:
        """Old versions go but the last ``keep``."""
        for v in self._versions(name)[:-keep]:
            self._fs.delete(self._path(name, str(v)), True)


def _typed(column: str, schema: str) -> Column:
    kind = next(c.split()[1] for c in schema.split(", ") if c.split()[0] == column)
    return F.col(column).cast(kind).alias(column)
