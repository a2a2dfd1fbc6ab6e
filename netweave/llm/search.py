"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring goes down the bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.pieces import text_blocks
from netweave.llm.words import hashed_words, letters, mix
from netweave.stage import stage

_TERM = letters()
_TERM[48:58] = True
#: fixed values of the score
UNIT, LENGTH_SHARE = 1_000_000_000, 90


@dataclass(frozen=True)
class SearchConfig:
    top: int = 10
    coordinates: int = 2048  # of a sketch
    docs: int = 1024  # documents whose sketches a task holds at once
    rescored: int = 64  # candidates of an item scored exactly at once
    batch_items: int = 2048  # items answered in one pass over the documents: about so many
    batch_terms: int = 1 << 18  # and so many terms of theirs
    block_chars: int = 1_000_000


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all terms, where each text's terms end): runs of ASCII letters, digits and all beyond ASCII; A-Z as a-z."""
    return hashed_words(texts, _TERM)


@dataclass(frozen=True)
class Batch:
    """Items answered together: their terms (sorted hashes) and each item's places in them."""

    terms: np.ndarray
    items: list[np.ndarray]

    def matched(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text with repeats, distinct terms of the batch in each text, their places, their counts)."""
        hashes, ends = term_hashes(texts)
        counts = np.diff(np.concatenate([[0], ends]))
        if not len(self.terms):
            return counts, np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        owner = np.repeat(np.arange(len(texts)), counts)
        known = self.terms[at] == hashes
        cells, tf = np.unique(owner[known] * len(self.terms) + at[known], return_counts=True)
        held = np.bincount(cells // len(self.terms), minlength=len(texts))
        return counts, held, cells % len(self.terms), tf


@dataclass(frozen=True)
class Weights:
    """What the whole corpus says: documents with a term, terms with repeats, a weight for every term of the batch."""

    n_docs: int
    n_terms: int
    term: np.ndarray

    def impacts(self, sizes: np.ndarray, places: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of each (document, term): weight * (10^9 tf div (1000 tf + 8 m)), whole numbers throughout."""
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * self.n_docs) // max(1, self.n_terms)
        return self.term[places] * ((UNIT * tf) // (1000 * tf + 8 * m))


class Best:
    """The highest (score, smallest id, null ids last) of every item so far."""

    def __init__(self, items: int, top: int):
        self.score = np.zeros((items, top), dtype=np.int64)
        self.id = np.zeros((items, top), dtype=np.int64)
        self.no_id = np.ones((items, top), dtype=bool)

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = np.append(self.score[item], score), np.append(self.id[item], ids), np.append(self.no_id[item], no_id)
        order = np.lexsort((ids, no_id, -score))[: self.score.shape[1]]
        self.score[item], self.id[item], self.no_id[item] = score[order], ids[order], no_id[order]


class Sketches:
    """Documents as maxima of their impacts at hashed coordinates, and the impacts themselves for rescoring.

    A term's impact is at most its coordinate's maximum, so the sum of the maxima at an item's coordinates is at
    least the item's score. Impacts of terms that no item of the batch holds could only loosen bounds and are left out.
    """

    def __init__(self, batch: Batch, config: SearchConfig):
        self.batch, self.config = batch, config
        self.coordinate = (mix(batch.terms) % np.uint64(config.coordinates)).astype(np.int64)
        self.lookup = np.zeros((config.coordinates, len(batch.items)))
        for k, places in enumerate(batch.items):
            np.add.at(self.lookup[:, k], self.coordinate[places], 1.0)

    def search(self, ids, no_id, held, places, impacts, best: Best) -> None:
        """Add a block of documents to the best ones: ``held`` terms each, with their places (ascending) and impacts."""
        owner = np.repeat(np.arange(len(held)), held)
        sketch = np.zeros((len(held), self.config.coordinates))
        np.maximum.at(sketch, (owner, self.coordinate[places]), impacts)
        # maxima are whole numbers; the slack covers rounding of sums beyond 2^53
        bounds = np.ceil((sketch @ self.lookup) * (1 + 1e-9))
        cells = owner * len(self.batch.terms) + places
        for item, wanted in enumerate(self.batch.items):
            bound = bounds[:, item]
            order = np.flatnonzero((bound > 0) & (bound >= best.score[item, -1]))
            order = order[np.argsort(-bound[order], kind="stable")]
            for lo in range(0, len(order), self.config.rescored):
                some = order[lo:lo + self.config.rescored]
                # equal bounds may still win by id: only smaller ones end the search
                some = some[bound[some] >= best.score[item, -1]]
                if not len(some):
                    break
                score = self._exact(some, wanted, cells, impacts)
                found = score > 0
                best.add(item, score[found], ids[some[found]], no_id[some[found]])

    def _exact(self, docs: np.ndarray, wanted: np.ndarray, cells: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        asked = (docs[:, None] * len(self.batch.terms) + wanted).ravel()
        at = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
        return np.where(cells[at] == asked, impacts[at], 0).reshape(len(docs), len(wanted)).sum(axis=1)


def search(
    docs: DataFrame,
    items: DataFrame,
    config: SearchConfig = SearchConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score): every item's ``top`` documents by score, equal scores by ascending id (null last).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over all documents; a document scores the sum of its
    impacts for an item's distinct terms. Items come in batches of bounded size; a batch is one scan of the whole texts (stored: for each
    document its size and its counts of the batch's terms), one of the stored rows for document frequencies, and
    one that folds sketches, looks all items up and rescores. A task hands on its best ``top`` an item.

    Defined results: null texts have no terms; an item without terms, or whose terms no document holds, has no row,
    as have documents with score 0. Rows with equal ids are documents of their own, as are items with equal ids but different
    texts; repeated item rows count once. No documents or no items give no rows. Other columns are ignored.
    Exact but for 64-bit hashes of terms.
    """
    item_type = dict(items.dtypes)[item_col]
    asked = stage(_item_terms(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct(), item_type))
    amount = asked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    batches = max(1, -(-amount["items"] // config.batch_items), -(-amount["terms"] // config.batch_terms))
    found = []
    for b in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(batches)) == b).collect()
        if rows:
            places = [np.array(r.terms, dtype=np.int64).view(np.uint64) for r in rows]
            terms = np.unique(np.concatenate(places))
            batch = Batch(terms, [np.searchsorted(terms, p) for p in places])
            found.append(_answered(docs, batch, [r.item for r in rows], item_type, config, id_col, text_col))
    if not found:
        found = [docs.sparkSession.createDataFrame([], f"item {item_type}, rank int, id bigint, score bigint")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _item_terms(items: DataFrame, item_type: str) -> DataFrame:
    """(item, terms): the distinct term hashes of every item that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch.column(1)):
                hashes, ends = term_hashes(texts)
                terms = [np.unique(h).view(np.int64).tolist() for h in np.split(hashes, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    return items.mapInArrow(run, f"item {item_type}, terms array<bigint>").where(F.size("terms") > 0)


def _answered(docs, batch: Batch, names: list, item_type: str, config: SearchConfig, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(batch)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo, hi, texts in text_blocks(rows.column(1), config.block_chars):
                sizes, held, places, tf = shared.value.matched(texts)
                cuts = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    rows.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(places, pa.int32())),
                    pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32())),
                ], ["id", "size", "places", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = stage(rows.mapInArrow(matched, "id bigint, size bigint, places array<int>, tf array<int>"))
    whole = stored.where("size > 0").agg(F.count("*").alias("docs"), F.sum("size").alias("terms")).first()
    holders = np.zeros(len(batch.terms), dtype=np.int64)
    # one row a term of the batch: bounded by it
    for row in stored.select(F.explode("places").alias("place")).groupBy("place").count().toLocalIterator():
        holders[row.place] = row["count"]
    weight = [math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * df + 1))) for df in holders.tolist()]
    weights = spark.sparkContext.broadcast(Weights(whole.docs, whole.terms or 0, np.array(weight, dtype=np.int64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, found = Sketches(shared.value, config), Best(len(shared.value.items), config.top)
        for rows in batches:
            for lo in range(0, rows.num_rows, config.docs):
                part = rows.slice(lo, config.docs)
                ids, lists = part.column(0), part.column(2)
                held = np.asarray(lists.value_lengths())
                if not held.any():
                    continue
                places, tf = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                sizes = np.repeat(part.column(1).to_numpy(), held)
                sketches.search(
                    ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), held, places, weights.value.impacts(sizes, places, tf), found,
                )
        item, rank = np.nonzero(found.score > 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(item, pa.int32()), pa.array(found.id[item, rank], pa.int64(), mask=found.no_id[item, rank]), pa.array(found.score[item, rank], pa.int64()),
        ], ["item", "id", "score"])

    top = stored.where(F.size("places") > 0).select("id", "size", "places", "tf").mapInArrow(best, "item int, id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top)
    named = spark.createDataFrame(list(enumerate(names)), f"item int, name {item_type}")  # a batch's items: bounded
    return ranked.join(F.broadcast(named), "item").select(F.col("name").alias("item"), "rank", "id", "score")
