"""Best-fit packing under conflicts: bins know which sources and duplicate clusters they hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.stage import stage


@dataclass(frozen=True)
class PackingConfig:
    capacity: int = 16384  # length units in a bin
    per_source: int = 4  # items of one source that a bin may hold
    shard_items: int = 8192  # items packed together: about so many, dealt by hash


class Bins:
    """Open bins ordered by residual, with a search tree over residuals.

    Every bin has a bitmap of full sources and held clusters; a node of the tree has the AND of the bitmaps
    below it. A subtree whose AND shares a bit with an item's bitmap has no compatible bin, so the successor search
    from the item's length upwards skips it and ends at the tightest compatible bin.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.common: dict[int, int] = {}  # tree node -> AND of bitmaps; absent: no bin below
        self.at: dict[int, dict[int, int]] = {}  # residual -> {bin: bitmap}, in order of arrival

    def put(self, residual: int, number: int, bitmap: int) -> None:
        self.at.setdefault(residual, {})[number] = bitmap
        node = self.leaves + residual
        while node:
            self.common[node] = self.common[node] & bitmap if node in self.common else bitmap
            node >>= 1

    def take(self, residual: int, number: int) -> int:
        held = self.at[residual]
        bitmap = held.pop(number)
        node = self.leaves + residual
        if held:
            rest = -1
            for b in held.values():
                rest &= b
                if not rest:
                    break
            self.common[node] = rest
        else:
            del self.at[residual], self.common[node]
        node >>= 1
        while node:
            sides = [self.common[c] for c in (2 * node, 2 * node + 1) if c in self.common]
            if sides:
                self.common[node] = sides[0] & sides[-1]
            else:
                del self.common[node]
            node >>= 1
        return bitmap

    def tightest(self, length: int, bitmap: int) -> tuple[int, int] | None:
        """(residual, bin) of the smallest residual >= length that shares no bit with the bitmap; of ties the bin that came to it first."""
        stack = [(1, 0, self.leaves)]
        while stack:
            node, low, width = stack.pop()
            if low + width <= length or node not in self.common or self.common[node] & bitmap:
                continue
            if width == 1:
                for number, held in self.at[low].items():
                    if not held & bitmap:
                        return low, number
                continue
            half = width // 2
            stack.append((2 * node + 1, low + half, half))
            stack.append((2 * node, low, half))
        return None


def pack_shard(lengths: list[int], sources: list, clusters: list, config: PackingConfig) -> list[int]:
    """Bin number of each item, items taken as they come. Items are not longer than the capacity.

    An item may join a bin that holds fewer than ``per_source`` items of its source and none of its cluster. Null
    sources and clusters conflict with nothing.
    """
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    counts: dict = {}
    for c in clusters:
        if c is not None:
            counts[c] = counts.get(c, 0) + 1
    repeated = [c for c, n in counts.items() if n > 1]
    cluster_bit = {c: 1 << (len(source_bit) + k) for k, c in enumerate(repeated)}
    bins, out, opened = Bins(config.capacity), [], 0
    held_of: list[dict] = []
    for length, source, cluster in zip(lengths, sources, clusters):
        source_mask = source_bit.get(source, 0)
        wanted = source_mask | cluster_bit.get(cluster, 0)
        found = bins.tightest(length, wanted)
        if found is None:
            residual, number, bitmap = config.capacity, opened, 0
            held_of.append({})
            opened += 1
        else:
            residual, number = found
            bitmap = bins.take(residual, number)
        held = held_of[number]
        held[source] = held.get(source, 0) + 1
        bitmap |= cluster_bit.get(cluster, 0)
        if held[source] >= config.per_source:
            bitmap |= source_mask
        out.append(number)
        if residual > length:
            bins.put(residual - length, number, bitmap)
    return out


def pack(
    items: DataFrame,
    length: Column,
    source: Column,
    cluster: Column,
    config: PackingConfig = PackingConfig(),
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, part, start, length, shard, bin, residual) of every item, in bins of at most ``capacity``.

    An item longer than the capacity is cut: each full part is a bin of its own, the rest is packed. Null and negative
    lengths are 0; such an item still gets a bin. Shards of about ``shard_items`` items, dealt by a hash of id, length,
    source and cluster, are packed independently, longest items first (ties by id, then hash), so bins don't hang on how the
    table is stored. No task holds more than about a shard, however many items share a source or cluster; rows alike in all four of which there
    are more than a shard holds are spread over all shards. An empty table gives no rows. ``residual`` is what the item's bin has left. Ids may be null or repeat.
    """
    spark = items.sparkSession
    id_type = dict(items.dtypes)[id_col]
    rows = stage(items.select(
        F.col(id_col).alias("id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("total"),
        source.alias("source"), cluster.cast("long").alias("cluster"),
    ).withColumn("name", F.xxhash64(F.col("id").isNull(), "id", "total", F.col("source").isNull(), "source", "cluster")).withColumn("row", F.monotonically_increasing_id()))
    n_shards = max(1, -(-rows.count() // config.shard_items))
    # at most one name a shard: few, however large the table
    hot = rows.groupBy("name").count().where(F.col("count") > config.shard_items).select("name", F.lit(True).alias("hot"))
    spread = F.when(F.col("hot"), F.xxhash64("name", "row")).otherwise(F.col("name"))
    rows = stage(rows.join(hot, "name", "left").withColumn("spread", spread).drop("hot"))
    full = F.floor(F.col("total") / config.capacity)
    rest = F.col("total") - full * config.capacity
    whole = rows.where(full > 0).select("id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("part"), "row").select(
        "id", "part", (F.col("part") * config.capacity).alias("start"), F.lit(config.capacity).cast("long").alias("length"),
        F.lit(-1).cast("long").alias("shard"), F.xxhash64("row", "part").alias("bin"), F.lit(0).cast("long").alias("residual"),
    )
    packed = rows.where((rest > 0) | (full == 0)).select(
        "id", full.alias("part"), (full * config.capacity).alias("start"), rest.alias("length"),
        F.pmod(F.xxhash64("spread"), F.lit(n_shards)).alias("shard"), "source", "cluster", "name",
    )
    schema = f"id {id_type}, part bigint, start bigint, length bigint, shard bigint, bin bigint, residual bigint"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            names = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo < hi:
                    if held and names[lo] != now:
                        yield solved(pa.Table.from_batches(held))
                        held = []
                    now = names[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield solved(pa.Table.from_batches(held))

    def solved(shard: pa.Table) -> pa.RecordBatch:
        lengths = shard.column(3).to_numpy()
        bins = np.array(pack_shard(lengths.tolist(), shard.column(5).to_pylist(), shard.column(6).to_pylist(), config))
        left = config.capacity - np.bincount(bins, weights=lengths).astype(np.int64)
        columns = [shard.column(k).combine_chunks() for k in range(5)] + [pa.array(bins.astype(np.int64)), pa.array(left[bins])]
        return pa.RecordBatch.from_arrays(columns, ["id", "part", "start", "length", "shard", "bin", "residual"])

    dealt = packed.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "id", "name")
    out = dealt.mapInArrow(shards, schema).unionByName(whole)
    return out.withColumnRenamed("id", id_col)


def text_cluster(text: Column) -> Column:
    """A cluster of equal texts (white space and case of letters aside): a 64-bit hash of the text; null and empty texts are in none."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))
