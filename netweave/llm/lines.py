"""Line deduplication with levelled sorted runs of line hashes; DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.buckets import SortedBuckets, default_buckets
from netweave.stage import new_path, stage

SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


class LineRuns:
    """In how many documents each line occurs, as levelled runs sorted by line hash.

    A run covers batches lo..hi; its folder is named after them. ``add`` merge-anti-joins a batch with
    the runs (lines that no run holds are ``fresh``) and writes the batch as its own run. When
    ``fanout`` runs of equal level stand at the end they are merged into one of the next level, so
    a batch meets O(log batches) runs. A folder whose batches another finished folder covers
    is ignored and deleted: a merge cut short by a failure leaves nothing counted twice.
    """

    COLUMNS = "hash BINARY, n_docs BIGINT, fresh BOOLEAN"

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.buckets = buckets or default_buckets(spark)
        self.runs = self._open()

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (hash, n_docs), every hash once."""
        counts = stage(counts)
        fresh = counts
        for table in self.runs.values():  # the batch is dealt once; no run is shuffled
            fresh = fresh.join(table.read().select("hash").hint("merge"), "hash", "left_anti")
        fresh = stage(fresh) if self.runs else fresh
        again = counts.join(fresh.select("hash"), "hash", "left_anti").withColumn("fresh", F.lit(False))
        counts = fresh.withColumn("fresh", F.lit(True))
        if self.runs:
            counts = counts.unionByName(again)
        n = max((hi for _, hi in self.runs), default=-1) + 1
        self._write(counts, n, n)
        self._compact()

    def totals(self) -> DataFrame:
        """(hash, n_docs) over all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], "hash binary, n_docs bigint")
        return self._read(self.runs.values()).groupBy("hash").agg(F.sum("n_docs").alias("n_docs"))

    def close(self) -> None:
        """Take the runs' names out of the catalog; their folders stay."""
        for table in self.runs.values():
            table.forget()

    def _read(self, tables) -> DataFrame:
        """Rows of several runs; read without bucketing, which a union does not keep."""
        first, *rest = [table.read_plain() for table in tables]
        for other in rest:
            first = first.unionByName(other)
        return first

    def _compact(self) -> None:
        while True:
            width = next(iter(reversed(self.runs)))
            width = width[1] - width[0] + 1
            tail = [r for r in self.runs if r[1] - r[0] + 1 == width]
            if len(tail) < self.fanout:
                return
            old = {r: self.runs[r] for r in tail}
            merged = self._read(old.values()).groupBy("hash").agg(
                F.sum("n_docs").alias("n_docs"), F.max("fresh").alias("fresh")
            )
            self._write(merged, tail[0][0], tail[-1][1])
            for r, table in old.items():
                self._delete(r, table)

    def _write(self, rows: DataFrame, lo: int, hi: int) -> None:
        table = self._table(lo, hi)
        table.append(rows)
        self.runs[lo, hi] = table

    def _table(self, lo: int, hi: int) -> SortedBuckets:
        return SortedBuckets(self.spark, f"{self.path}/run-{lo:08d}-{hi:08d}", self.COLUMNS, "hash", self.buckets)

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _delete(self, run: tuple[int, int], table: SortedBuckets) -> None:
        table.forget()
        files, _ = self._files()
        files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(table.path), True)
        del self.runs[run]

    def _open(self) -> dict[tuple[int, int], SortedBuckets]:
        files, where = self._files()
        found = []
        if files.exists(where):
            for entry in files.listStatus(where):
                name = re.fullmatch(r"run-(\d+)-(\d+)", entry.getPath().getName())
                done = self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
                if name and files.exists(done):
                    found.append((int(name[1]), int(name[2])))
        covered = {r for r in found for o in found if o != r and o[0] <= r[0] and r[1] <= o[1]}
        return {r: self._table(*r) for r in sorted(set(found) - covered)}


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    runs_path: str | None = None,
) -> DataFrame:
    """Remove from every document the lines whose key occurs in ``min_docs`` documents or more.

    Returns id, text (what stays, joined by newlines), n_lines, n_dropped; one row per input row. The documents
    enter the runs in ``batches`` parts. A document is an (id, text) pair: repeated rows count once
    and each gets the same result. Null and empty texts have one empty line, which stays
    (keys shorter than ``min_chars`` are never dropped). Only the two named columns are read.

    Every shuffle is keyed by a document's digest or carries map-side sums, but for the look-up of
    frequent hashes, a plain join whose hot keys adaptive execution can split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "doc", F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))))))
    )
    lines = docs.select("doc", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars).select(
        "doc", "pos", F.unhex(F.md5("key")).alias("hash"), F.pmod(F.xxhash64("doc"), F.lit(batches)).alias("batch")
    )
    lines = stage(lines, "batch")
    runs = LineRuns(spark, runs_path or new_path(spark, "runs"))
    for k in range(batches):
        part = lines.where(F.col("batch") == k)
        runs.add(part.groupBy("hash").agg(F.countDistinct("doc").alias("n_docs")))
    frequent = stage(runs.totals().where(F.col("n_docs") >= min_docs).select("hash"))
    runs.close()
    dropped = lines.join(frequent, "hash").groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    joined = docs.join(dropped, "doc", "left").select(
        "id", lines_of(F.col("text")).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )
    # the kept lines are the stretches between neighbouring dropped positions: linear in the text
    edges = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("dropped")),
        lambda k: F.slice(
            F.col("lines"), F.element_at("edges", k + 1) + 2,
            F.element_at("edges", k + 2) - F.element_at("edges", k + 1) - 1,
        ),
    ))
    return joined.withColumn("edges", edges).select(
        F.col("id").alias(id_col), F.array_join(kept, "\n").alias(text_col),
        F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
    )
