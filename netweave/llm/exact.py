"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.buckets import SortedBuckets, default_buckets
from netweave.stage import stage

SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with every run of white space made one space; null is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


class DigestIndex:
    """Digests of all texts ever added, bucketed and sorted by digest.

    ``add`` groups a batch by digest, anti-joins the groups with the index (a sort-merge join
    for which the index is not shuffled) and appends those that are new. A batch is known by its name: adding it again, in
    whatever order or partitioning, gives the same result and appends nothing, so a job that failed can be repeated; what a
    job cut short had appended counts as that batch's own.

    Defined results: null text equals empty text; of equal texts in a batch the smallest id stays,
    null ids after all others, and of repeated rows exactly one; a text known from an earlier batch
    keeps nothing. An empty batch gives an empty result. Other columns of a batch are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.table = SortedBuckets(spark, path, "digest BINARY, keep_id BIGINT, batch STRING", "digest", buckets or default_buckets(spark))

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: id, keep_id, group_size (copies in this batch), kept, digest.

        Hot digests are counted map-side; the final look-up joins plain rows, so adaptive execution can split a digest that a large
        part of the batch shares. The row that stays is the first of the stored rows with the kept id.
        """
        rows = stage(docs.select(
            F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ))
        groups = rows.groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("n")
        )
        groups = stage(groups)
        new = groups.join(self.table.read().select("digest").hint("merge"), "digest", "left_anti")
        self.table.append(new.select("digest", F.col("first.id").alias("keep_id"), F.lit(batch).alias("batch")))
        # a job cut short between two files and repeated may have appended a digest twice: alike, so any row serves
        held = self.table.read().groupBy("digest").agg(F.min_by(F.struct("keep_id", "batch"), F.col("batch") != batch).alias("held"))
        resolved = stage(groups.join(held.hint("merge"), "digest").select(
            "digest", "n", F.col("held.keep_id").alias("keep_id"), F.when(F.col("held.batch") == batch, F.col("first.row")).alias("keep_row"),
        ))
        return rows.join(resolved, "digest").select(
            F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest",
        )

    def close(self) -> None:
        self.table.forget()
