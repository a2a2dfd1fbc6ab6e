"""Tables bucketed and sorted by one hash column, kept in a folder on shared storage.

Joins on the hash read such a table bucket by bucket: it is never shuffled again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


class SortedBuckets:
    """A Parquet table at ``path`` in ``buckets`` buckets, sorted by ``key`` within files.

    The folder persists; a later session opens it with the same bucket count.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int):
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path, columns, key, buckets
        self.name = f"netweave_{hashlib.md5(f'{path}/{buckets}'.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def append(self, rows: DataFrame) -> None:
        """Add rows as one sorted file a bucket."""
        names = [c.split()[0] for c in self.columns.split(",")]
        rows.select(*names).repartition(self.buckets, self.key).write.insertInto(self.name)

    def read(self) -> DataFrame:
        """The rows with their bucketing known to the planner."""
        return self.spark.table(self.name)

    def read_plain(self) -> DataFrame:
        """The rows without bucketing: a join then shuffles both sides and can split a hot key."""
        return self.spark.read.schema(self.columns).parquet(self.path)

    def forget(self) -> None:
        """Remove the name from the catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions: set for its data size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
