"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

Exact: every pair of documents whose sets of word n-grams reach the similarity is linked, and no other.

1. *Sketch.* One scan hashes each text's n-grams and adds them up in a count-min sketch of fixed size. An n-gram
   whose estimate exceeds a share of the documents is *heavy*. All heavy n-grams are left to the end of
   the order below; nothing else depends on the estimate.
2. *Postings.* A second scan deals (n-gram, set) to buckets by n-gram hash; a bucket keeps those in two sets or
   more. N-grams in a single set can't count in any product.
3. *Size-derived bound.* Order a set's n-grams from rare to frequent. A set of n n-grams and one like it share
   an n-gram among the first n - ceil(t n) + 1. Sets whose first n-grams are all their own are done.
4. *Groups.* The remaining sets are joined into candidate groups by the n-grams at their starts: one link from each
   set to the smallest holder, never all pairs.
5. *Blocked product.* Within a group, blocks of sets are multiplied, accumulating overlap counts over column blocks;
   pairs below their bound are dropped and a block pair returns a spanning forest of its links. Large groups
   first meet one pivot block; then only what the pivot left outside the largest component meets all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.components import components
from netweave.llm.pieces import text_blocks
from netweave.llm.words import hashed_words, mix, not_space
from netweave.stage import stage

_WORD = not_space()
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64))


@dataclass(frozen=True)
class NgramConfig:
    words: int = 5
    percent: int = 75  # similarity: 100 * intersection >= percent * union
    sketch_bits: int = 19  # counters in each of two rows
    heavy_share: float = 0.001  # of the sets, beside the sketch's mean load
    heavy_least: int = 64
    block: int = 512  # sets in a block
    block_grams: int = 1_000_000  # and their n-grams
    columns: int = 8192  # n-grams multiplied at once
    flush: int = 1_000_000  # postings a task holds before it passes them on
    block_chars: int = 1_000_000


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every whole text; a shorter text is one n-gram, one without words none."""
    hashes, ends = hashed_words(texts, _WORD)
    out, start = [], 0
    for end in ends:
        h, start = hashes[start:end], end
        if len(h) == 0:
            out.append(h)
        elif len(h) < words:
            out.append(mix(np.array([(h * _FACTORS[: len(h)]).sum() + np.uint64(len(h))])))
        else:
            total = np.zeros(len(h) - words + 1, dtype=np.uint64)
            for k in range(words):
                total += h[k:len(h) - words + 1 + k] * _FACTORS[k]
            out.append(np.unique(mix(total)))
    return out


def _node(grams: np.ndarray) -> int:
    """64 bits that stand for a set (equal sets, equal nodes), as a signed integer."""
    h = mix(mix(grams) * _FACTORS[7] + np.arange(len(grams), dtype=np.uint64) * _FACTORS[8]).sum() + np.uint64(len(grams))
    return int(mix(np.array([h]))[0].astype(np.int64))


def _sketch_places(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (grams >> shift).astype(np.int64), (mix(grams) >> shift).astype(np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Integer arrays as byte planes, compressed: high bytes of small numbers cost nothing."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, lengths: list[int], kinds: list) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), [], 0
    for n, kind in zip(lengths, kinds):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _pack_postings(grams, nodes, order) -> bytes:
    """Postings sorted by n-gram: differences of hashes, places in a table of nodes, order keys."""
    by = np.argsort(grams, kind="stable")
    table, place = np.unique(nodes[by], return_inverse=True)
    return _pack([np.diff(grams[by], prepend=np.uint64(0)), place.astype(np.uint32), order[by].astype(np.uint32), table])


def _unpack_postings(data: bytes, n: int, n_nodes: int):
    steps, place, order, table = _unpack(data, [n, n, n, n_nodes], [np.uint64, np.uint32, np.uint32, np.int64])
    return np.cumsum(steps), table[place], order


def _range(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges a hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(parts: np.ndarray, grams, nodes, order) -> Iterator[pa.RecordBatch]:
    """One row (part, n, n_nodes, data) for each part."""
    by = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[by], prepend=-1, append=-2))
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = by[lo:hi]
        rows.append((int(parts[at[0]]), len(at), len(np.unique(nodes[at])), _pack_postings(grams[at], nodes[at], order[at])))
    for k in range(0, len(rows), 256):
        columns = list(zip(*rows[k:k + 256]))
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()),
        ], ["part", "n", "n_nodes", "data"])


_DEALT = "part int, n bigint, n_nodes bigint, data binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All postings of a partition, by part."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, n, n_nodes, data in zip(*[c.to_pylist() for c in batch.columns]):
            held.setdefault(part, []).append(_unpack_postings(data, n, n_nodes))
    return {part: tuple(np.concatenate(x) for x in zip(*rows)) for part, rows in held.items()}


#: order keys: the set's size travels as a posting with key SIZE; other keys count sets, heavy n-grams from HEAVY on
SIZE, HEAVY = 0, 1 << 31


def sets_of(docs: DataFrame, config: NgramConfig, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (id, n, node) of every document and the added-up sketch (chunk, counts)."""
    bits = config.sketch_bits
    chunk = 1 << 14

    def run(batches):
        counts, seen = np.zeros((2, 1 << bits), dtype=np.int32), set()
        for batch in batches:
            for lo, hi, texts in text_blocks(batch.column(1), config.block_chars):
                sets = shingles(texts, config.words)
                nodes = [_node(s) if len(s) else None for s in sets]
                fresh = []
                for s, node in zip(sets, nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        fresh.append(s)
                if fresh:
                    for row, places in enumerate(_sketch_places(np.concatenate(fresh), bits)):
                        np.add.at(counts[row], places, 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                    pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary()),
                ], ["id", "n", "node", "chunk", "counts"])
        if seen:
            parts = counts.reshape(-1, min(chunk, 1 << bits))
            used = [k for k in range(len(parts)) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()),
                pa.array(used, pa.int32()), pa.array([_pack([parts[k]]) for k in used], pa.binary()),
            ], ["id", "n", "node", "chunk", "counts"])

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpack(data, [min(chunk, 1 << bits)], [np.int32])[0].astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack([v]) for v in sums.values()], pa.binary())], ["chunk", "counts"])

    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, n bigint, node bigint, chunk int, counts binary"
    ))
    sketch = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add_up, "chunk int, counts binary")
    return rows.where("chunk is null").select("id", "n", "node"), sketch


def _heavy_test(sketch: DataFrame, nodes: int, config: NgramConfig):
    """The sketch as an array (of fixed size) and the estimate from which an n-gram is heavy."""
    size = min(1 << 14, 1 << config.sketch_bits)
    table = np.zeros(((2 << config.sketch_bits) // size, size), dtype=np.int64)
    for row in sketch.collect():
        table[row.chunk] += _unpack(bytes(row.counts), [size], [np.int64])[0]
    table = table.reshape(2, -1)
    bound = max(config.heavy_least, config.heavy_share * nodes) + 4 * table[0].mean()
    return np.minimum(table, HEAVY - 1).astype(np.uint32), bound


def live_sets(docs: DataFrame, sketch: np.ndarray, bound: float, config: NgramConfig, text_col: str) -> DataFrame:
    """Stored (node, n, starts array<bigint>, grams binary): the sets whose first n-grams others hold too.

    ``grams`` are the n-grams that other sets hold, as 64-bit integers; ``starts`` those that decide candidates.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(sketch)

    def post(batches):
        held, total, seen = [], 0, set()

        def passed_on():
            grams, nodes, order = (np.concatenate(x) for x in zip(*held))
            light = (order > SIZE) & (order < HEAVY)
            # ranges of hashes, so differences within a bucket are small; what goes on to its set is spread by set
            bucket = np.where(light, _range(grams, parts), _range(mix(nodes.view(np.uint64)), parts))
            yield from _dealt(bucket, grams, nodes, order)

        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0), config.block_chars):
                for s in shingles(texts, config.words):
                    if not len(s) or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    a, b = _sketch_places(s, config.sketch_bits)
                    estimate = np.minimum(shared.value[0][a], shared.value[1][b])
                    order = np.where(estimate >= bound, HEAVY + estimate.astype(np.int64), 1).astype(np.uint32)
                    held.append((np.append(s, np.uint64(len(s))), np.full(len(s) + 1, node), np.append(order, np.uint32(SIZE))))
                    total += len(s) + 1
                    if total > config.flush:
                        yield from passed_on()
                        held, total = [], 0
        if held:
            yield from passed_on()

    def shared_grams(batches):
        for grams, nodes, order in _gathered(batches).values():
            light = (order > SIZE) & (order < HEAVY)
            g, v = grams[light], nodes[light]
            by = np.lexsort((v, g))
            g, v = g[by], v[by]
            once = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]) if len(g) else np.zeros(0, bool)
            g, v = g[once], v[once]
            _, place, count = np.unique(g, return_inverse=True, return_counts=True)
            count = count[place] if len(g) else np.zeros(0, np.int64)
            often = count > 1
            g = np.concatenate([g[often], grams[~light]])
            v = np.concatenate([v[often], nodes[~light]])
            keys = np.concatenate([np.minimum(count[often], HEAVY - 1).astype(np.uint32), order[~light]])
            if len(g):
                yield from _dealt(_range(mix(v.view(np.uint64) + np.uint64(1)), parts), g, v, keys)

    def starts(batches):
        for grams, nodes, order in _gathered(batches).values():
            by = np.lexsort((grams, order, nodes))
            grams, nodes, order = grams[by], nodes[by], order[by]
            once = np.concatenate([[True], (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])])
            grams, nodes, order = grams[once], nodes[once], order[once]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])), len(nodes))
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                n = int(grams[lo])  # the size sorts first
                own = n - (hi - lo - 1)
                first = n - -(-config.percent * n // 100) + 1 - own
                if first > 0:
                    rows.append((int(nodes[lo]), n, grams[lo + 1:lo + 1 + first].view(np.int64), grams[lo + 1:hi].tobytes()))
            for k in range(0, len(rows), 512):
                c = list(zip(*rows[k:k + 512]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.binary()),
                ], ["node", "n", "starts", "grams"])

    posted = docs.select(F.col(text_col).alias("text")).mapInArrow(post, _DEALT)
    kept = posted.repartitionById(parts, F.col("part")).mapInArrow(shared_grams, _DEALT)
    return stage(kept.repartitionById(parts, F.col("part")).mapInArrow(starts, "node bigint, n bigint, starts array<bigint>, grams binary"))


def _forest(links: tuple[np.ndarray, np.ndarray], size: int) -> Iterator[tuple[int, int]]:
    """The links that join two parts not joined before."""
    parent = list(range(size))
    for a, b in zip(*[x.tolist() for x in links]):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def product_links(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, config: NgramConfig):
    """A spanning forest of the links between the two sides of a block pair (a set may be on both, side 2).

    Overlaps add up over blocks of n-grams held by two sets or more; a pair links at 100 * overlap >= percent * union.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = held[column] > 1
    owner, column = owner[useful], np.unique(column[useful], return_inverse=True)[1]
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    n_columns = int(column.max()) + 1 if len(column) else 0
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for lo in range(0, n_columns, config.columns):
        at = slice(*np.searchsorted(column, (lo, lo + config.columns)))
        part = np.zeros((len(sets), min(config.columns, n_columns - lo)), dtype=np.float32)
        part[owner[at], column[at] - lo] = 1
        overlap += part[left] @ part[right].T
    together = sizes[left][:, None] + sizes[right]
    a, b = np.nonzero((100 + config.percent) * overlap.astype(np.int64) >= config.percent * together)
    a, b = left[a], right[b]
    apart = a != b
    for x, y in _forest((a[apart], b[apart]), len(sets)):
        yield int(nodes[x]), int(nodes[y])


def _multiply(pairs: DataFrame, config: NgramConfig) -> DataFrame:
    """(a, b): links within block pairs (pair, side, node, n, grams), one pair at a time in a task."""

    def solved(rows):
        nodes, sizes, sets, sides = zip(*rows)
        return product_links(np.array(nodes), np.array(sizes), [np.frombuffer(s, dtype=np.uint64) for s in sets], np.array(sides), config)

    def run(batches):
        pair, rows, out = None, [], []
        for batch in batches:
            for p, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if p != pair:
                    if len(rows) > 1:
                        out += solved(rows)
                    pair, rows = p, []
                rows.append((row[1], row[2], row[3], row[0]))
            if len(out) > 10_000:
                yield edges(out)
                out = []
        if len(rows) > 1:
            out += solved(rows)
        if out:
            yield edges(out)

    def edges(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    rows = pairs.select("pair", "side", "node", "n", "grams").repartition("pair").sortWithinPartitions("pair")
    return stage(rows.mapInArrow(run, "a bigint, b bigint"))


def set_links(live: DataFrame, config: NgramConfig) -> DataFrame:
    """(a, b): links that connect the sets exactly as all pairs of the given similarity do."""
    posts = live.select("node", F.explode("starts").alias("gram"))
    least = stage(posts.groupBy("gram").agg(F.min("node").alias("least"), F.count("*").alias("holders")).where("holders > 1").select("gram", "least"))
    groups = stage(components(posts.join(least, "gram").select(F.col("node").alias("a"), F.col("least").alias("b"))))
    placed = live.select("node", "n", "grams")

    def n_blocks(rows: DataFrame, *keys: str) -> DataFrame:
        most = F.greatest(F.count("*") / config.block, F.sum("n") / config.block_grams)
        return rows.groupBy(*keys).agg(F.ceil(most).cast("long").alias("n_blocks"))

    large = stage(n_blocks(groups.join(live.select("node", "n"), "node"), "root").where("n_blocks > 1"))
    one = groups.join(large.select("root"), "root", "left_anti")
    found = _multiply(placed.join(stage(one), "node").select(F.col("root").alias("pair"), F.lit(2).alias("side"), "node", "n", "grams"), config)
    if large.isEmpty():
        return found
    # sets of size classes two or more apart can't link; a class is split by hash into blocks
    sized = stage(placed.join(stage(groups.join(large.select("root"), "root")), "node").withColumn(
        "class", F.floor(F.log("n") / F.log(F.lit(100 / config.percent) * (1 + 1e-9))).cast("long")
    ))
    sized = stage(sized.join(stage(n_blocks(sized, "root", "class")), ["root", "class"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_blocks"))))
    first = _multiply(_paired(sized, sized.where("block = 0"), own=True), config)
    found = found.unionByName(first)
    parts = components(first)
    labelled = stage(sized.withColumnRenamed("root", "g").join(parts, "node", "left").select("g", "class", "block", "node", "n", "grams", F.coalesce("root", "node").alias("label")))
    share = labelled.groupBy("g", "label").agg(F.count("*").alias("c"))
    main = stage(share.groupBy("g").agg(F.max(F.struct("c", "label")).alias("m")).select("g", F.col("m.label").alias("main")))
    rest = labelled.join(main, "g").where("label <> main").select(F.col("g").alias("root"), "class", "node", "n", "grams")
    rest = stage(rest)
    rest = stage(rest.join(stage(n_blocks(rest, "root", "class")), ["root", "class"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("n_blocks"))))
    second = _multiply(_paired(sized, rest, own=False), config)
    return found.unionByName(second)


def _paired(all_sets: DataFrame, some: DataFrame, own: bool) -> DataFrame:
    """Block pairs: every block of ``some`` (side 0) with every block of the same group and a neighbouring class (side 1).

    ``own`` adds every block with itself. Only block names meet here; sets follow them by equi-joins.
    """
    right = all_sets.select("root", "class", "block").distinct()
    left = some.select("root", "class", "block").distinct().select("root", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("other"), "class", "block")
    names = stage(left.select("root", F.col("other").alias("class"), F.col("class").alias("c0"), F.col("block").alias("b0")).join(
        right.select("root", "class", F.col("block").alias("b1")), ["root", "class"]
    ).select("root", "c0", "b0", F.col("class").alias("c1"), "b1"))
    name = F.xxhash64("root", "c0", "b0", "c1", "b1", F.lit(own)).alias("pair")
    zero = some.join(names.select("root", F.col("c0").alias("class"), F.col("b0").alias("block"), name), ["root", "class", "block"])
    one = all_sets.join(names.select("root", F.col("c1").alias("class"), F.col("b1").alias("block"), name), ["root", "class", "block"])
    shape = ["pair", "side", "node", "n", "grams"]
    out = zero.withColumn("side", F.lit(0)).select(*shape).unionByName(one.withColumn("side", F.lit(1)).select(*shape))
    if own:
        alone = all_sets.withColumn("pair", F.xxhash64("root", "class", "block", F.lit("own"))).withColumn("side", F.lit(2))
        out = out.unionByName(alone.select(*shape))
    return out


def near_duplicates(docs: DataFrame, config: NgramConfig = NgramConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach.

    Null and empty texts, and texts of white space, have no n-grams, link with nothing and are components of their own. Equal
    sets are one node however many documents hold them. A null id never names a component unless all its ids are
    null. Other columns are ignored; repeated rows give repeated rows. N-grams and sets are known by 64-bit
    hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, sketch = sets_of(docs, config, "id", "text")
    holders = stage(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least")))
    table, bound = _heavy_test(sketch, holders.count(), config)
    live = live_sets(docs, table, bound, config, "text")
    parts = components(set_links(live, config))
    named = stage(holders.join(stage(parts), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    smallest = stage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = stage(named.join(smallest, "root").select("node", "component_id"))
    out = rows.join(labels, "node", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)
