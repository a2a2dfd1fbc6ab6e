"""Segmentation and thinning of long sequences by blocks: no step holds a whole sequence in one task.

Sequences are told apart by ``keys``; every sequence has one number for every position 0, 1, ..., n - 1. Work goes over pairs of
position blocks, which carry one best start for each end; the driver sees a few numbers a sequence and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

#: positions in a block
BLOCK = 512
#: differences that may be listed to settle a median; more are counted instead
LISTED = 1 << 18
#: thresholds counted in one pass
THRESHOLDS = 48


def position_blocks(signal: DataFrame, keys: list[str], size: int = BLOCK, order: str = "t", value: str = "v") -> DataFrame:
    """Stored (*keys, block, x array): the values of every block in order."""
    packed = signal.groupBy(*keys, F.expr(f"{order} div {size}").alias("block")).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("p"))
    return stage(packed.select(*keys, "block", F.col(f"p.{value}").alias("x")))


def block_pairs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, i, j, xi, xj) for all i <= j: the later block names the earlier ones, which an equi-join fetches."""
    later = blocks.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("x").alias("xj"))
    return later.join(blocks.select(*keys, F.col("block").alias("i"), F.col("x").alias("xi")), [*keys, "i"])


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _by_row(rows: DataFrame, keys: list[str], fields: str, work) -> DataFrame:
    """``work(row) -> dict of columns or None`` on every row; keys are kept."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                found = work(row)
                if found is not None:
                    yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, **found}) if _long(found) else pd.DataFrame([{**{k: getattr(row, k) for k in keys}, **found}])

    return rows.mapInPandas(run, _schema(rows, keys) + fields)


def _long(found: dict) -> bool:
    return found.pop("_rows", False)


# ---- median of the differences ------------------------------------------------------------


def median_square_difference(signal: DataFrame, keys: list[str], size: int = BLOCK, listed: int = LISTED) -> dict[tuple, float]:
    """The exact median of (x_a - x_b)^2 over all pairs of a sequence, by sequence; 0 for fewer than two values.

    Values are sorted and cut into blocks. A pass counts, for a few thresholds, the differences up to each: pairs of blocks
    whose differences are all smaller or all larger count by their sizes, others by binary search. When the
    interval that holds the middle ones has at most ``listed`` differences, or one value, those are listed. Squares
    keep the order of differences, so the middle squares are the squares of the middle differences.
    """
    n_of = {tuple(r[k] for k in keys): r["count"] for r in signal.groupBy(*keys).count().collect()}
    parts = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(signal.select(*keys, "v", "t").repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()))
    ranked = running(dealt, keys, ["v", "t"], F.col("part"), {"rank": (F.lit(1).cast("bigint"), "sum")})
    pairs = stage(block_pairs(position_blocks(ranked.withColumn("rank", F.col("rank") - 1), keys, size, "rank"), keys))
    spans = pairs.groupBy(*keys).agg(F.max(F.array_max("xj") - F.array_min("xi")).alias("w"))
    high = {tuple(r[k] for k in keys): float(r.w) for r in spans.collect()}
    # of every sequence: the middle ranks (from 0), and (low, high] that holds them, with the differences up to low
    open_ = {}
    for key, n in n_of.items():
        total = n * (n - 1) // 2
        if total:
            open_[key] = [((total - 1) // 2, total // 2), -1.0, high[key], 0, total]
    done: dict[tuple, float] = {key: 0.0 for key in n_of if key not in open_}
    while open_:
        ready = {key: (s[1], s[2]) for key, s in open_.items() if s[4] - s[3] <= listed or np.nextafter(s[1], np.inf) >= s[2]}
        for key, values in _listed(pairs, keys, {k: v for k, v in ready.items() if open_[k][4] - open_[k][3] <= listed}).items():
            (a, b), _, _, below, _ = open_.pop(key)
            values = np.sort(values)
            done[key] = float((values[a - below] ** 2 + values[b - below] ** 2) / 2)
        for key, (_, top) in ready.items():
            if key in open_:  # one value holds the middle
                open_.pop(key)
                done[key] = top * top
        if not open_:
            break
        cuts = {key: np.unique(np.linspace(s[1], s[2], THRESHOLDS + 2)[1:-1]) for key, s in open_.items()}
        counts = _counts(pairs, keys, cuts)
        for key, state in list(open_.items()):
            (a, b), low, top, below, upto = state
            points = [(low, below), *zip(cuts[key], counts[key]), (top, upto)]
            # the middle ranks a <= b may fall into two intervals: then both lie between the cuts around them
            lower = max(p for p in points if p[1] <= a)
            upper = min(p for p in points if p[1] > b)
            if (lower[0], upper[0]) == (low, top):  # nothing was gained: the two middle values lie far apart
                done[key] = _apart(pairs, keys, key, a, b, points)
                open_.pop(key)
            else:
                open_[key] = [(a, b), lower[0], upper[0], lower[1], upper[1]]
    return done


def _apart(pairs: DataFrame, keys: list[str], key: tuple, a: int, b: int, points: list) -> float:
    """The two middle differences when they lie in different intervals: the largest up to a cut, the smallest above it."""
    cut = max(p for p in points if p[1] <= b)[0] if b > a else points[-1][0]
    mine = pairs.where(" AND ".join(f"`{k}` <=> {_literal(v)}" for k, v in zip(keys, key)))

    def work(row):
        d = _differences(row)
        return {"low": float(d[d <= cut].max(initial=-1.0)), "high": float(d[d > cut].min(initial=np.inf))}

    found = _by_row(mine, [], "low double, high double", work).agg(F.max("low").alias("low"), F.min("high").alias("high")).first()
    return (found.low**2 + found.high**2) / 2


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _differences(row) -> np.ndarray:
    """All differences of a pair of sorted blocks, each pair of values once."""
    xi, xj = np.asarray(row.xi), np.asarray(row.xj)
    d = np.abs(xj[:, None] - xi)
    return d[np.tril_indices(len(xi), -1)] if row.i == row.j else d.ravel()


def _counts(pairs: DataFrame, keys: list[str], cuts: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """Differences up to each threshold, by sequence."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key not in cuts:
                    continue
                at, xi, xj = cuts[key], np.asarray(row.xi), np.asarray(row.xj)
                if row.i < row.j and xj[-1] - xi[0] <= at[0]:
                    found = np.full(len(at), len(xi) * len(xj))
                elif row.i < row.j and xj[0] - xi[-1] > at[-1]:
                    continue
                else:
                    d = np.sort(_differences(row))
                    found = np.searchsorted(d, at, side="right")
                sums[key] = sums.get(key, 0) + found
        if sums:
            yield pd.DataFrame([{**dict(zip(keys, key)), "n": v.astype("int64")} for key, v in sums.items()])

    rows = pairs.mapInPandas(run, _schema(pairs, keys) + "n array<bigint>").select(*keys, F.posexplode("n").alias("at", "n"))
    out = {key: np.zeros(len(at), dtype=np.int64) for key, at in cuts.items()}
    for r in rows.groupBy(*keys, "at").agg(F.sum("n").alias("n")).collect():
        out[tuple(r[k] for k in keys)][r["at"]] = r.n
    return out


def _listed(pairs: DataFrame, keys: list[str], spans: dict[tuple, tuple[float, float]]) -> dict[tuple, np.ndarray]:
    """The differences in (low, high] of the given sequences: few, by what was counted before."""
    if not spans:
        return {}

    def work(row):
        low, high = spans.get(tuple(getattr(row, k) for k in keys), (0.0, -1.0))
        d = _differences(row) if low < high else np.zeros(0)
        d = d[(d > low) & (d <= high)]
        return {"d": d} if len(d) else None

    out: dict[tuple, list] = {key: [] for key in spans}
    for r in _by_row(pairs, keys, "d array<double>", work).collect():
        out[tuple(r[k] for k in keys)].append(r.d)
    return {key: np.concatenate(v) for key, v in out.items()}


# ---- kernel segmentation ------------------------------------------------------------------


def _kernel(xi: np.ndarray, xj: np.ndarray, gamma: float, same: bool) -> np.ndarray:
    k = np.exp(-np.clip(gamma * (xi[:, None] - xj) ** 2, 1e-2, 1e2))
    if same:
        np.fill_diagonal(k, 1.0)
    return k


def _sums_between(pairs: DataFrame, keys: list[str], gammas: dict[tuple, float]) -> DataFrame:
    """Stored (*keys, i, j, tails, heads, middle) of all i < j, for the blocks strictly between i and j: kernel sums of the ends of block i
    with them, of the beginnings of block j with them, and of them among themselves.

    A pair of blocks gives its sums by start, by end, and in total; those add up along rows and columns of pairs, one
    group for a block with one row for each other one.
    """

    def work(row):
        k = _kernel(np.asarray(row.xi), np.asarray(row.xj), gammas[tuple(getattr(row, c) for c in keys)], row.i == row.j)
        return {"i": row.i, "j": row.j, "tails": np.cumsum(k.sum(axis=1)[::-1])[::-1], "heads": np.cumsum(k.sum(axis=0)), "total": float(k.sum())}

    kinds = _schema(pairs, keys)
    sums = stage(_by_row(pairs, keys, "i bigint, j bigint, tails array<double>, heads array<double>, total double", work))

    def by_end(pdf: pd.DataFrame) -> pd.DataFrame:
        """For block j: sums over the blocks m with i < m < j."""
        pdf = pdf.sort_values("i", ascending=False)
        own, heads, total, out = 0.0, 0.0, 0.0, []
        for row in pdf.itertuples(index=False):
            if row.i == row.j:
                own = row.total
                heads = np.zeros(len(row.heads))
            else:
                out.append((*(getattr(row, k) for k in keys), row.i, row.j, row.tails, heads, 2 * total + own))
                heads, total = heads + np.asarray(row.heads), total + row.total
        return pd.DataFrame(out, columns=[*keys, "i", "j", "tails", "heads", "grows"])

    half = stage(sums.groupBy(*keys, "j").applyInPandas(by_end, kinds + "i bigint, j bigint, tails array<double>, heads array<double>, grows double"))

    def by_start(pdf: pd.DataFrame) -> pd.DataFrame:
        """For block i: sums over the blocks m with i < m < j; ``grows`` is what block j adds to the middle for later ones."""
        pdf = pdf.sort_values("j")
        tails, middle, out = 0.0, 0.0, []
        for row in pdf.itertuples(index=False):
            tails = np.zeros(len(row.tails)) if not out else tails
            out.append((*(getattr(row, k) for k in keys), row.i, row.j, tails, row.heads, middle))
            tails, middle = tails + np.asarray(row.tails), middle + row.grows
        return pd.DataFrame(out, columns=[*keys, "i", "j", "tails", "heads", "middle"])

    return stage(half.groupBy(*keys, "i").applyInPandas(by_start, kinds + "i bigint, j bigint, tails array<double>, heads array<double>, middle double"))


def kernel_segmentation(signal: DataFrame, keys: list[str], n_frames: int, n_bkps: int, min_size: int, gamma: float | None = None, size: int = BLOCK) -> DataFrame:
    """(*keys, boundaries): exact segmentation of each sequence (*keys, t, v) under the Gaussian-kernel scatter; [] where it cannot fit.

    The kernel's bandwidth is 1 / median squared difference unless given. One round per segment: a pair of blocks computes its kernel again,
    turns it into the costs of all its segments and keeps one start for each end, so neither kernel nor costs are
    ever stored. Ties take the earliest start.
    """
    min_size, segments = max(min_size, 1), n_bkps + 1
    signal = stage(signal.select(*keys, "t", "v"))
    found = signal.select(*keys).distinct()
    if n_frames < segments * min_size:
        return found.withColumn("boundaries", F.array().cast("array<bigint>"))
    if gamma is None:
        medians = median_square_difference(signal, keys, size)
        gammas = {key: 1.0 / m if m else 1.0 for key, m in medians.items()}
    else:
        gammas = {tuple(r[k] for k in keys): gamma for r in found.collect()}
    blocks = position_blocks(signal, keys, size)
    pairs = stage(block_pairs(blocks, keys))
    between = _sums_between(pairs, keys, gammas)
    pairs = stage(pairs.join(between, [*keys, "i", "j"], "left"))

    def costs(row) -> np.ndarray:
        """Scatter of [s, e) for every start s of block i and end e of block j (ends count the positions before them)."""
        key, xi, xj = tuple(getattr(row, c) for c in keys), np.asarray(row.xi), np.asarray(row.xj)
        s, e = row.i * size + np.arange(len(xi)), row.j * size + 1 + np.arange(len(xj))
        length = e - s[:, None]
        if row.i == row.j:
            sums = np.pad(np.cumsum(np.cumsum(_kernel(xi, xj, gammas[key], True), axis=0), axis=1), ((1, 0), (1, 0)))
            own, at = np.diag(sums), np.arange(len(xi))
            inner = own[1:] + own[:-1, None] - 2 * sums[at[:, None], at + 1]
        else:
            first, last = _kernel(xi, xi, gammas[key], True), _kernel(xj, xj, gammas[key], True)
            tail = np.diag(np.cumsum(np.cumsum(first[::-1, ::-1], axis=0), axis=1))[::-1]
            head = np.diag(np.cumsum(np.cumsum(last, axis=0), axis=1))
            cross = np.cumsum(np.cumsum(_kernel(xi, xj, gammas[key], False)[::-1], axis=0)[::-1], axis=1)
            inner = tail[:, None] + head + row.middle + 2 * (np.asarray(row.tails)[:, None] + np.asarray(row.heads) + cross)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(length >= min_size, length - inner / length, np.inf)

    def best(row):
        total = np.asarray(row.totals, dtype=float)[:, None] + costs(row)
        pick = total.argmin(axis=0)
        least = total[pick, np.arange(total.shape[1])]
        at = np.flatnonzero(np.isfinite(least) & ((row.j * size + 1 + np.arange(len(least)) == n_frames) | (not row.last)))
        return {"at": row.j * size + 1 + at, "total": least[at], "start": row.i * size + pick[at], "_rows": True} if len(at) else None

    start = found.withColumn("at", F.lit(0).cast("bigint")).withColumn("total", F.lit(0.0)).withColumn("path", F.array().cast("array<bigint>"))
    state = start
    for k in range(1, segments + 1):
        state = stage(state)
        held = state.select(*keys, F.expr(f"at div {size}").alias("i"), F.expr(f"at % {size}").alias("place"), "total").groupBy(*keys, "i").agg(
            F.map_from_entries(F.collect_list(F.struct("place", "total"))).alias("m")
        )
        places = F.sequence(F.lit(0), F.size("xi") - 1)
        totals = F.transform(places, lambda p: F.coalesce(F.try_element_at("m", p.cast("bigint")), F.lit(float("inf"))))
        wanted = pairs.where(F.col("j") == (n_frames - 1) // size) if k == segments else pairs
        ready = wanted.join(held, [*keys, "i"]).withColumn("totals", totals).withColumn("last", F.lit(k == segments)).drop("m")
        ends = _by_row(ready, keys, "at bigint, total double, start bigint", best)
        least = ends.groupBy(*keys, "at").agg(F.min(F.struct("total", "start")).alias("b")).select(*keys, "at", "b.*")
        before = state.select(*keys, F.col("at").alias("start"), "path")
        path = F.col("path") if k == 1 else F.concat("path", F.array("start"))
        state = least.join(before, [*keys, "start"]).select(*keys, "at", "total", path.alias("path"))
    ended = state.where(F.col("at") == n_frames).select(*keys, F.col("path").alias("boundaries"))
    return found.join(ended, keys, "left").select(*keys, F.coalesce("boundaries", F.array().cast("array<bigint>")).alias("boundaries"))


# ---- penalised segmentation ---------------------------------------------------------------


def penalised_segmentation(signal: DataFrame, keys: list[str], n_frames: int, penalty: str, min_size: int, jump: int = 5, size: int = BLOCK) -> DataFrame:
    """(*keys, boundaries) of sequences (*keys, t, v) with a column ``penalty`` among the keys: least squares with that cost per segment, boundaries on multiples of ``jump``.

    Blocks of positions follow one another; all sequences and penalties advance together. For a block, pairs with the earlier
    blocks' starts give one best start for each end; the block itself then adds its own starts in order. A start that
    cannot win for any later end (its segment to a position costs as much as the best way to it) is dropped, so later
    blocks meet few. Of a start's way only its predecessor is kept, and the ways are read off at the end.
    """
    min_size = max(min_size, 1)
    first = max(1, -(-min_size // jump)) * jump
    regular = max(0, -(-(n_frames - first) // jump))  # ends on multiples of jump; the last end is n_frames
    ordinal = F.when(F.col("at") == n_frames, F.lit(regular)).otherwise(F.expr(f"(at - {first}) div {jump}"))
    inner = (F.col("at") >= first) & (F.col("at") % jump == 0) & (F.col("at") < n_frames)
    block_of = F.when(F.col("at") == 0, 0).otherwise(F.floor(ordinal / size) + 1)
    points = stage(_prefix(signal, keys).where((F.col("at") == 0) | inner | (F.col("at") == n_frames)).withColumn("block", block_of), "block")
    n_blocks = 1 + regular // size
    live = stage(points.where("block = 0").select(*keys, "at", "s", "q", F.lit(0.0).alias("total")))
    found = [live.select(*keys, "at", F.lit(None).cast("bigint").alias("start"))]
    for b in range(1, n_blocks + 1):
        block = points.where(F.col("block") == b)
        packed = stage(block.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "s", "q"))).alias("ends")))
        chunks = live.groupBy(*keys, F.expr(f"at div {size * jump}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "s", "q", "total"))).alias("starts"))

        def meet(row):
            """Of a chunk of starts: the best one for each end."""
            e, s, total = _columns(row.ends, "at", "s", "q"), _columns(row.starts, "at", "s", "q"), _columns(row.starts, "total")[0]
            cost = total[:, None] + _square_error(s, e, min_size) + getattr(row, penalty)
            pick = cost.argmin(axis=0)
            least = cost[pick, np.arange(cost.shape[1])]
            ok = np.isfinite(least)
            return {"at": e[0][ok].astype("int64"), "total": least[ok], "start": s[0][pick[ok]].astype("int64"), "_rows": True} if ok.any() else None

        met = _by_row(packed.join(chunks, keys), keys, "at bigint, total double, start bigint", meet)
        met = met.groupBy(*keys, "at").agg(F.min(F.struct("total", "start")).alias("b")).groupBy(*keys).agg(
            F.collect_list(F.struct("at", "b.total", "b.start")).alias("met")
        )

        def settle(row):
            """The block's own starts, in order."""
            e = _columns(row.ends, "at", "s", "q")
            total, start = np.full(len(e[0]), np.inf), np.full(len(e[0]), -1, dtype="int64")
            for x in row.met if row.met is not None else []:
                k = int(np.searchsorted(e[0], x["at"]))
                total[k], start[k] = x["total"], x["start"]
            for k in range(1, len(e[0])):
                here = [c[k:k + 1] for c in e]
                cost = total[:k] + _square_error([c[:k] for c in e], here, min_size)[:, 0] + getattr(row, penalty)
                p = int(cost.argmin())
                if cost[p] < total[k]:
                    total[k], start[k] = cost[p], e[0][p]
            ok = np.isfinite(total)
            return {"at": e[0][ok].astype("int64"), "s": e[1][ok], "q": e[2][ok], "total": total[ok], "start": start[ok], "_rows": True} if ok.any() else None

        settled = stage(_by_row(packed.join(met, keys, "left"), keys, "at bigint, s double, q double, total double, start bigint", settle))
        found.append(settled.select(*keys, "at", "start"))
        if b < n_blocks:
            next_end = first + b * size * jump if b * size < regular else n_frames
            live = stage(_pruned(live.unionByName(settled.select(*live.columns)), settled, keys, next_end, min_size))
    ways = found[0]
    for more in found[1:]:
        ways = ways.unionByName(more)
    return _read_off(stage(ways), signal, keys, n_frames)


def _prefix(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Stored (*keys, at, s, q): sums of the values and squares before every position, 0 included."""
    rows = signal.select(*keys, "t", F.col("v").cast("double").alias("v"))
    sums = running(stage(rows), keys, ["t"], F.expr(f"t div {16 * BLOCK}"), {"s": (F.col("v"), "sum"), "q": (F.col("v") * F.col("v"), "sum")})
    first = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return stage(sums.select(*keys, (F.col("t") + 1).cast("bigint").alias("at"), "s", "q").unionByName(first))


def _columns(items, *names: str) -> list[np.ndarray]:
    return [np.array([x[n] for x in items], dtype=float) for n in names]


def _square_error(starts, ends, min_size: int) -> np.ndarray:
    """Squared error of the segments from every start to every end; inf where too short."""
    (a, s, q), (e, se, qe) = starts, ends
    length = e - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length >= min_size, qe - q[:, None] - (se - s[:, None]) ** 2 / length, np.inf)


def _pruned(live: DataFrame, settled: DataFrame, keys: list[str], next_end: int, min_size: int) -> DataFrame:
    """Starts that may still win: at the last end at least ``min_size`` before the next block's first, their segment costs less than the best way there."""
    last = settled.where(F.col("at") <= next_end - min_size).groupBy(*keys).agg(F.max_by(F.struct("at", "s", "q", "total"), "at").alias("e"))
    length = F.col("e.at") - F.col("at")
    cost = F.col("total") + F.col("e.q") - F.col("q") - (F.col("e.s") - F.col("s")) * (F.col("e.s") - F.col("s")) / length
    beaten = F.coalesce((length >= min_size) & (cost > F.col("e.total") + 1e-9 * F.abs(F.col("e.total"))), F.lit(False))
    return live.join(last, keys, "left").where(~beaten).drop("e")


def _read_off(ways: DataFrame, signal: DataFrame, keys: list[str], n_frames: int) -> DataFrame:
    """Boundaries from predecessors: one look-up for each segment of the longest way."""
    found = signal.select(*keys).distinct()
    path = stage(found.withColumn("at", F.lit(n_frames).cast("bigint")).withColumn("boundaries", F.array().cast("array<bigint>")))
    while True:
        step = path.join(ways, [*keys, "at"], "left")
        on = F.col("start") > 0
        path = stage(step.select(
            *keys, F.when(on, F.col("start")).otherwise(0).cast("bigint").alias("at"),
            F.when(on, F.concat(F.array("start"), "boundaries")).otherwise(F.col("boundaries")).alias("boundaries"),
        ))
        if path.where("at > 0").isEmpty():
            return path.select(*keys, "boundaries")


# ---- thinning by distance -----------------------------------------------------------------


def thinned(candidates: DataFrame, min_distance: float, chunk: float | None = None) -> DataFrame:
    """Of (cond, point, score): the points kept when taken by falling score (the smaller point on ties), each at least ``min_distance`` from all kept before.

    The axis is cut into chunks. A task decides the points of its chunk as far as they don't hang on undecided points
    within ``min_distance`` beyond its borders, which come along as a halo. The best point still open is always decided, and
    a long chain of falling scores is decided chunk by chunk, so rounds are few. A repeated point counts once, with its best score.
    """
    width = float(chunk or max(4096 * min_distance, 1.0))
    points = stage(candidates.groupBy("cond", F.col("point")).agg(F.max("score").alias("score")).where("point is not null and score is not null"))
    kinds = dict(points.dtypes)
    schema = f"cond string, point {kinds['point']}, score {kinds['score']}, fate int"
    own = F.floor(F.col("point") / width)
    reach = F.sequence(F.floor((F.col("point") - min_distance) / width), F.floor((F.col("point") + min_distance) / width))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", ignore_index=True)
        at = pdf["point"].to_numpy(dtype=float)
        fate = pdf["fate"].to_numpy(copy=True)  # 1 kept, 0 open
        mine = (pdf["home"] == pdf["chunk"]).to_numpy()
        blocked = np.zeros(len(at), dtype=bool)  # something better nearby is open
        gone = np.zeros(len(at), dtype=bool)
        left, right = np.searchsorted(at, at - min_distance, side="right"), np.searchsorted(at, at + min_distance, side="left")
        for k in np.flatnonzero(fate == 1):
            gone[left[k]:right[k]] = True
        for k in np.lexsort((at, -pdf["score"].to_numpy(dtype=float))):
            if fate[k] == 1 or gone[k]:
                continue
            if mine[k] and not blocked[k]:
                fate[k] = 1
                gone[left[k]:right[k]] = True
            else:
                blocked[left[k]:right[k]] = True
        fate[(fate == 0) & gone] = -1
        return pdf.assign(fate=fate)[mine][["cond", "point", "score", "fate"]]

    state = points.withColumn("fate", F.lit(0))
    while True:
        state = stage(state)
        open_ = state.where("fate = 0")
        if open_.isEmpty():
            return state.where("fate = 1").select("cond", "point", "score")
        dealt = state.select("*", own.alias("home"), F.explode(reach).alias("chunk"))
        busy = open_.select("cond", own.alias("chunk")).distinct()
        active = dealt.join(busy, ["cond", "chunk"])
        settled = state.select("*", own.alias("chunk")).join(busy, ["cond", "chunk"], "left_anti").drop("chunk")
        state = active.groupBy("cond", "chunk").applyInPandas(decide, schema).where("fate >= 0").unionByName(settled)
