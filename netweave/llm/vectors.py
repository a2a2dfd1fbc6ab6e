"""Near-duplicate vectors by sorted projection passes; vectors too dense for their windows go through passes of their own."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.components import components
from netweave.llm.ngram_join import _forest
from netweave.stage import stage


@dataclass(frozen=True)
class VectorConfig:
    threshold: float = 0.95
    window: int = 48  # neighbours compared on either side
    passes: int | None = None  # None: as many as `recall` needs
    recall: float = 0.999  # chance that some pass brings a pair just at the threshold together
    block: int = 1024  # vectors multiplied at once when links are counted
    sort_block: int = 2048  # vectors of a pass compared in one go, besides the windows at both ends
    centres: int = 256  # dense vectors through which later passes lay their planes
    least_settled: float = 0.25  # share that a round of passes must settle to be followed by another
    rest_block: int = 4096  # vectors multiplied at once where rounds settle no more
    seed: int = 11


_RUN = 1_000_003  # a run is pass * _RUN + dimension


def passes_needed(vectors: int, config: VectorConfig) -> int:
    """Passes after which a pair at the threshold has met in a window with the chance ``recall`` if vectors lie evenly.

    Such a pair is neighbours once it agrees in the first log2(vectors / window) random signs of a pass. How far windows really
    reach is measured in every pass (``window_links``).
    """
    if config.passes:
        return config.passes
    agree = 1 - math.acos(min(1.0, config.threshold)) / math.pi
    together = agree ** max(0.0, math.log2(max(1, vectors) / config.window))
    return max(2, math.ceil(math.log(1 - config.recall) / math.log(1 - min(0.999, together))))


def _unit(batch: pa.Array) -> tuple[np.ndarray, list]:
    """(which rows are usable, their unit vectors in double precision)."""
    good, out = np.zeros(len(batch), dtype=bool), []
    for k, v in enumerate(batch.to_pylist()):
        if not v or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top > 0:
            x = x / top  # no overflow or underflow in the norm
            good[k] = True
            out.append(x / np.sqrt(x @ x))
    return good, out


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (id, key) of all rows, key null where a vector is unusable, and (key, copies, least, dim, vec)."""
    width = 8  # bytes of a component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = _unit(batch.column(1))
            raw = [u.tobytes() for u in units]
            keys = np.zeros(len(good), dtype=np.int64)
            keys[good] = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in raw]
            data = np.full(len(good), None, dtype=object)
            data[good] = raw
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, mask=~good), pa.array(data.tolist(), pa.binary())], ["id", "key", "vec"]
            )

    rows = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id bigint, key bigint, vec binary"))
    distinct = stage(rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.min("vec").alias("vec")
    ).withColumn("dim", (F.octet_length("vec") / width).cast("int")))
    return rows.select("id", "key"), distinct


def _links_in_order(runs: np.ndarray, keys: np.ndarray, vecs: list[bytes], config: VectorConfig, first: int = 0):
    """A forest of the verified links between rows at most ``window`` apart in one run, one row being at ``first`` or later."""
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2 or hi <= first:
            continue
        x = np.frombuffer(b"".join(vecs[lo:hi]), dtype=np.float64).reshape(hi - lo, -1)
        a, b = [], []
        for d in range(1, min(config.window, hi - lo - 1) + 1):
            close = np.flatnonzero(np.einsum("ij,ij->i", x[d:], x[:-d]) >= config.threshold)
            close = close[close + d + lo >= first]
            a.append(close)
            b.append(close + d)
        a, b = np.concatenate(a), np.concatenate(b)
        out += [(int(keys[lo + i]), int(keys[lo + j])) for i, j in _forest((a, b), hi - lo)]
    return out


def _shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that two arrays of 64-bit codes have in common."""
    differ = (a ^ b).view(np.uint64)
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    return 64 - np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])


def _depths(runs: np.ndarray, codes: np.ndarray, own: range, window: int) -> np.ndarray:
    """For each row of ``own``: how many leading signs a row must share with it to be sure to lie in its window.

    That is one more than the row just outside the window shares, on the side where it shares more; 0 where the run ends before.
    """
    at, out = np.arange(own.start, own.stop), np.zeros(len(own), dtype=np.int64)
    for outside in (at - window - 1, at + window + 1):
        there = (outside >= 0) & (outside < len(runs))
        there[there] = runs[outside[there]] == runs[at[there]]
        out[there] = np.maximum(out[there], 1 + _shared_signs(codes[outside[there]], codes[at[there]]))
    return out


def _together(heights: np.ndarray, offsets: np.ndarray, depths: np.ndarray, threshold: float) -> np.ndarray:
    """The chance that a vector at the threshold from a row shares its first ``depths`` signs, given the row's heights along the planes' normals.

    A height h along a Gaussian normal says nothing of its slope across the row: at the angle a, the other vector's height is cos(a) h + sin(a) z with a
    normal z, so it stays on the row's side of a plane with offset c with the chance Phi(side (cos(a) h - c) / sin(a)). This holds wherever the other
    rows lie; the average over all planes would not, as planes that cut a dense cone also cut its pairs.
    """
    side = np.where(heights > offsets, 1.0, -1.0)
    z = side * (threshold * heights - offsets) / math.sqrt(max(1e-18, 1 - threshold * threshold)) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * np.abs(z))  # Abramowitz and Stegun 7.1.26, within 2e-7
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    shared = np.cumprod(np.where(z >= 0, 1 - tail, tail), axis=1)
    shared = np.concatenate([np.ones((len(z), 1)), shared, np.zeros((len(z), 1))], axis=1)  # 65 signs: equal codes fill the window
    return shared[np.arange(len(z)), depths]


def _placed(order: DataFrame) -> DataFrame:
    """Stored (run, code, key, place): ``order`` with the position of every row in the sort by run, code and key.

    However few rows a sort partition holds, positions go on over its borders; the driver sees one count a partition.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), place], ["run", "code", "key", "part", "place"]
            )

    parts = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(order.repartitionByRange(parts, "run", "code", "key").sortWithinPartitions("run", "code", "key").mapInArrow(
        number, "run bigint, code bigint, key bigint, part int, place bigint"
    ))
    before, starts = 0, {}
    for r in sorted(rows.groupBy("part").count().collect()):
        starts[r["part"]] = before
        before += r["count"]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([starts[p] for p in batch.column(3).to_numpy()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(batch.column(4).to_numpy() + start)], ["run", "code", "key", "place"])

    return rows.mapInArrow(shift, "run bigint, code bigint, key bigint, place bigint")


def _pass_links(vectors: DataFrame, dims: list[int], passes: int, again: int, config: VectorConfig, centres: dict[int, np.ndarray]) -> DataFrame:
    """Stored (a, b, gain): verified links (a, b) of neighbours in ``passes`` sorts, and for every key (a) and pass the log of the
    chance (gain) that the pass keeps a pair just at the threshold apart.

    All passes are one sort: rows go by (pass, dimension, concatenated random signs). Every plane of a sign runs through the origin or,
    where there are ``centres``, through one of them: so it cuts the dense place where that one lies. The sort is cut by position into equal
    blocks, and every block also gets the ``window + 1`` rows on either side.
    """
    seed, w, size = [config.seed, again], config.window, max(config.sort_block, 2 * config.window)

    def drawn() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Normals (passes, dimension, 64) and offsets (passes, 64) of the planes, by dimension."""
        out = {}
        for d in dims:
            rng = np.random.default_rng([*seed, d])
            normals, through = rng.standard_normal((passes, d, 64)), centres.get(d, np.zeros((1, d)))
            out[d] = normals, np.einsum("pkd,pdk->pk", through[rng.integers(0, len(through), (passes, 64))], normals)
        return out

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = drawn()
        weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        for batch in batches:
            dim, vecs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                for lo in range(0, len(at), 2048):
                    some = at[lo:lo + 2048]
                    x = np.frombuffer(b"".join(vecs[k] for k in some), dtype=np.float64).reshape(len(some), -1)
                    normals, offsets = planes[d]
                    for p in range(passes):
                        code = ((x @ normals[p] > offsets[p]) * weights).sum(axis=1, dtype=np.uint64)
                        order = (code ^ np.uint64(1 << 63)).view(np.int64)  # signed order as unsigned
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(some), p * _RUN + int(d), dtype=np.int64)), pa.array(order),
                            batch.column(0).take(pa.array(some)),
                        ], ["run", "code", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = drawn()
        for rows in _grouped(batches):
            number = rows.column("block")[0].as_py()
            place, runs, codes, keys = (rows.column(c).to_numpy() for c in ("place", "run", "code", "key"))
            own = range(*np.searchsorted(place, [number * size, (number + 1) * size]).tolist())
            vecs = rows.column("vec").to_pylist()[:own.stop]
            links = _links_in_order(runs[:own.stop], keys[:own.stop], vecs, config, own.start)
            depths, gain = _depths(runs, codes, own, w), np.zeros(len(own))
            for run in np.unique(runs[own.start:own.stop]).tolist():
                at = np.flatnonzero(runs[own.start:own.stop] == run)
                p, d = divmod(run, _RUN)
                x = np.frombuffer(b"".join(vecs[own.start + k] for k in at), dtype=np.float64).reshape(len(at), d)
                with np.errstate(divide="ignore"):
                    gain[at] = np.log1p(-_together(x @ planes[d][0][p], planes[d][1][p], depths[at], config.threshold))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([
                pa.array([*a, *keys[own.start:own.stop].tolist()], pa.int64()), pa.array([*b, *[None] * len(own)], pa.int64()),
                pa.array([*[None] * len(a), *gain.tolist()], pa.float64()),
            ], ["a", "b", "gain"])

    order = _placed(vectors.select("key", "dim", "vec").mapInArrow(signs, "run bigint, code bigint, key bigint"))
    first, last = (F.floor((F.col("place") + d) / size).cast("long") for d in (-w - 1, w + 1))
    places = order.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    dealt = places.join(vectors.select("key", "vec"), "key").select("block", "place", "run", "code", "key", "vec")
    return stage(dealt.repartition("block").sortWithinPartitions("block", "place").mapInArrow(compare, "a bigint, b bigint, gain double"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, one table after the other; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                if held and held[0].column(0)[0].as_py() != names[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _spanning(linked: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """A forest of the links between the rows and the columns of a table of booleans; ``same``: both are the same vectors."""
    across = linked if same else np.ascontiguousarray(linked.T)
    fresh = [np.ones(linked.shape[0], dtype=bool), np.ones(linked.shape[1], dtype=bool)]
    if same:
        fresh[1] = fresh[0]
    for root in range(linked.shape[0]):
        if not fresh[0][root]:
            continue
        fresh[0][root] = False
        waiting = [(0, root)]
        while waiting:
            side, k = waiting.pop()
            found = np.flatnonzero((across if side else linked)[k] & fresh[1 - side])
            fresh[1 - side][found] = False
            for j in found.tolist():
                waiting.append((1 - side, j))
                yield (j, k) if side else (k, j)


def _all_links(vectors: DataFrame, dims: list[int], config: VectorConfig) -> DataFrame:
    """Stored (a, b): a forest of the links within each pair of blocks, so that every link's ends are joined.

    Vectors lie around their nearest pivot; two groups whose pivots are further apart than their radii and the threshold's
    angle allow have no link and don't meet. What is left meets in pairs of blocks.
    """
    spark, n = vectors.sparkSession, vectors.count()
    block = min(config.rest_block, max(256, -(-n // 12)))
    drawn = vectors.orderBy(F.xxhash64("key", F.lit(config.seed)), "key").limit(min(256, -(-n // block))).select("dim", "vec").collect()
    pivots = {d: np.array([np.frombuffer(r.vec) for r in drawn if r.dim == d]) for d in dims}

    def angles(cosines: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(cosines, -1, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, vecs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            group, angle = np.zeros(len(dim), dtype=np.int64), np.full(len(dim), math.pi)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                if len(pivots[d]):
                    to = np.frombuffer(b"".join(vecs[k] for k in at), dtype=np.float64).reshape(len(at), -1) @ pivots[d].T
                    group[at], angle[at] = to.argmax(axis=1), angles(to.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(angle)], ["key", "dim", "vec", "near", "angle"])

    near = stage(vectors.select("key", "dim", "vec").mapInArrow(deal, "key bigint, dim int, vec binary, near bigint, angle double"))
    groups = sorted(near.groupBy("dim", "near").agg(F.max("angle"), F.ceil(F.count("*") / block).cast("long")).collect())
    reach = math.acos(min(1.0, config.threshold)) + 1e-6  # rounding of angles
    meet = []
    for k, (d, g, r, m) in enumerate(groups):
        for d2, h, r2, m2 in groups[k:]:
            if d2 != d:
                break
            if h == g or float(angles(pivots[d][g] @ pivots[d][h])) <= r + r2 + reach:
                meet.append((d, g, h, m, m2))
    shape = "dim int, near bigint, other bigint, n bigint, m bigint"
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = stage(spark.createDataFrame(meet, shape).select("*", spread("n").alias("x")).select("*", spread("m").alias("y")).where(
        "near <> other or x <= y"
    ).withColumn("same", F.expr("near = other and x = y")).withColumn("pair", F.xxhash64("dim", "near", "other", "x", "y")))
    sizes = spark.createDataFrame([(d, g, m) for d, g, _, m in groups], "dim int, near bigint, n bigint")
    placed = stage(near.join(F.broadcast(sizes), ["dim", "near"]).select(
        "dim", "near", F.pmod(F.xxhash64("key"), F.col("n")).alias("x"), "key", "vec"
    ))
    shown = ["pair", "side", "key", "vec"]
    left = placed.join(pairs.select("dim", "near", "x", "pair", F.when(F.col("same"), 2).otherwise(0).alias("side")), ["dim", "near", "x"]).select(*shown)
    right = placed.join(pairs.where("not same").select(
        "dim", F.col("other").alias("near"), F.col("y").alias("x"), "pair", F.lit(1).alias("side")
    ), ["dim", "near", "x"]).select(*shown)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            side, keys = rows.column("side").to_numpy(), rows.column("key").to_numpy()
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=np.float64).reshape(len(keys), -1)
            one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(one) or not len(two):
                continue
            linked = np.concatenate([x[one[k:k + 512]] @ x[two].T >= config.threshold for k in range(0, len(one), 512)])
            same = bool((side == 2).all())
            if same:
                linked |= linked.T
            links = list(_spanning(linked, same))
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(keys[one[a]]), pa.array(keys[two[b]])], ["a", "b"])

    dealt = left.unionByName(right).repartition("pair").sortWithinPartitions("pair")
    return stage(dealt.mapInArrow(solve, "a bigint, b bigint"))


def window_links(distinct: DataFrame, config: VectorConfig) -> DataFrame:
    """Stored (a, b): verified links that join the ends of every link, each with at least the chance ``recall``.

    A round of passes over all vectors comes first. Each measures for every vector how many leading signs its windows really cover; a pair is
    settled once the chance that all passes kept it apart is at most 1 - ``recall`` for either vector. Vectors that lie too
    densely for that go on among themselves, in rounds whose planes run through a bounded sample of them, so that they cut
    where these vectors lie. When a round settles less than ``least_settled`` of its vectors the rest meets all with all.
    """
    dims = sorted(r.dim for r in distinct.select("dim").distinct().collect())
    rest, n, last, found = distinct.select("key", "dim", "vec", F.lit(0.0).alias("gain")), distinct.count(), None, []
    centres: dict[int, np.ndarray] = {}
    while n > 1:
        if last and n > (1 - config.least_settled) * last:
            found.append(_all_links(rest, dims, config))
            break
        done = _pass_links(rest, dims, passes_needed(n, config), len(found), config, centres)
        found.append(done.where("b is not null").select("a", "b"))
        gains = done.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("gain").alias("more"))
        rest = stage(rest.join(gains, "key").withColumn("gain", F.col("gain") + F.col("more")).where(
            F.col("gain") > math.log(1 - config.recall)
        ).select("key", "dim", "vec", "gain"))
        last, n = n, rest.count()
        drawn = rest.orderBy(F.xxhash64("key", F.lit(len(found))), "key").limit(config.centres).select("dim", "vec").collect()
        centres = {d: np.array([np.frombuffer(r.vec) for r in drawn if r.dim == d]) for d in {r.dim for r in drawn}}
    if not found:
        return distinct.sparkSession.createDataFrame([], "a bigint, b bigint")
    return stage(functools.reduce(DataFrame.unionByName, found).distinct())


def count_links(members: DataFrame, config: VectorConfig) -> DataFrame:
    """(key, n_links): rows linked with each distinct vector of ``members`` (root, key, copies, vec), its own copies included.

    A component's vectors meet in pairs of blocks; a task multiplies two blocks and returns counts, not pairs.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / config.block).cast("long").alias("n_blocks"))
    placed = stage(members.join(stage(sizes), "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks"))))
    blocks = placed.select("root", "n_blocks", "block").distinct()
    names = stage(blocks.select("root", F.col("block").alias("b0"), F.explode(F.sequence(F.col("block"), F.col("n_blocks") - 1)).alias("b1")).withColumn(
        "pair", F.xxhash64("root", "b0", "b1")
    ))
    shape = ["pair", "side", "key", "copies", "vec"]
    sides = [
        placed.join(names.select("root", F.col(of).alias("block"), "pair", (F.col("b0") == F.col("b1")).alias("same")), ["root", "block"]).withColumn(
            "side", F.when(F.col("same"), 2).otherwise(k)
        ).where((F.col("side") != 2) | F.lit(k == 0)).select(*shape)
        for k, of in enumerate(("b0", "b1"))
    ]

    def solved(rows: list) -> pa.RecordBatch:
        side, key, copies, vec = (list(x) for x in zip(*rows))
        x = np.frombuffer(b"".join(vec), dtype=np.float64).reshape(len(rows), -1)
        side, copies = np.array(side), np.array(copies)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        linked = x[left] @ x[right].T >= config.threshold
        counts = np.zeros(len(rows), dtype=np.int64)
        counts[left] = linked @ copies[right]
        if (side == 2).all():
            counts += np.where(np.diag(linked), 0, copies)  # a copy of itself, whatever rounding says
        else:
            counts[right] = copies[left] @ linked
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(counts)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, []
        for batch in batches:
            for p, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if p != pair and rows:
                    yield solved(rows)
                    rows = []
                pair = p
                rows.append(row)
        if rows:
            yield solved(rows)

    dealt = sides[0].unionByName(sides[1]).repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, config: VectorConfig = VectorConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; links are cosines of at least the threshold, in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
    lengths never link. Equal vectors are one node with a number of copies, so a hot group of copies is one row
    in every pass. Components come from the passes; links are then counted exactly among all members of a
    component. Null ids name a component only if it has no other; repeated rows give repeated rows.
    """
    rows, distinct = distinct_vectors(vectors, id_col, vector_col)
    parts = stage(components(window_links(distinct, config)))
    members = parts.join(distinct.select("key", "copies", "vec"), parts["node"] == F.col("key")).select("root", "key", "copies", "vec")
    counts = stage(count_links(members, config))
    named = stage(distinct.select("key", "copies", "least").join(parts.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "copies", "least", F.coalesce("root", "key").alias("root")
    ))
    smallest = stage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = stage(named.join(smallest, "root").join(counts, "key", "left").select(
        "key", "component_id", (F.coalesce("n_links", "copies") - 1).alias("n_links")
    ))
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(labels, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
