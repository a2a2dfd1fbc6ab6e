"""Packed frames: one row per (cond, t) with the sparse cells of all subjects' graphs.

Every row has the same bounded size (subjects x pairs), so work per row is even whatever
the data distribution; the per-row kernels below are a few dense products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.linalg import flat_pairs, square
from netweave.shape import TensorShape, frame_spine, literal_array
from netweave.stage import stage

EDGE_ROWS = "cond string, subj string, i bigint, j bigint, t bigint"


def pair_index(n: int) -> Column:
    """Position of (i, j), i < j, in the row-major upper triangle."""
    i, j = F.col("i"), F.col("j")
    return F.expr(f"i * {n} - (i * (i + 1)) div 2") + j - i - 1


def pack_frames(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """(cond, t, pos, w): absent frames come back with empty arrays; cells outside the shape fail."""
    shape.require_frame_fits()
    names = F.create_map(*[F.lit(x) for k, s in enumerate(shape.subjects) for x in (s, k)])
    subject = F.try_element_at(names, F.col("subj"))
    inside = (
        F.col("cond").isin(*shape.conds) & subject.isNotNull() & F.col("t").between(0, shape.n_frames - 1)
        & (F.col("i") >= 0) & (F.col("i") < F.col("j")) & (F.col("j") < shape.n_nodes)
    )
    place = F.concat_ws(" ", F.lit("cell outside the declared shape:"), "cond", "subj", "i", "j", "t")
    pos = F.when(inside, subject * shape.n_pairs + pair_index(shape.n_nodes)).otherwise(F.raise_error(place).cast("bigint"))
    cells = edges.filter("w <> 0").select("cond", "t", pos.alias("pos"), "w")
    packed = cells.groupBy("cond", "t").agg(F.collect_list("pos").alias("pos"), F.collect_list("w").alias("w"))
    return frame_spine(edges.sparkSession, shape).join(packed, ["cond", "t"], "left").select(
        "cond", "t",
        F.coalesce("pos", F.array().cast("array<bigint>")).alias("pos"),
        F.coalesce("w", F.array().cast("array<double>")).alias("w"),
    )


def stage_frames(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Packed frames on shared storage in time order, so a time slice reads few files."""
    return stage(pack_frames(edges, shape).repartitionByRange("t", "cond").sortWithinPartitions("t", "cond"))


def unpack(pos, w, shape: TensorShape) -> np.ndarray:
    """One frame as (subjects, nodes, nodes); repeated cells add up."""
    flat = np.bincount(np.asarray(pos, dtype=int), weights=np.asarray(w, dtype=float), minlength=shape.n_subjects * shape.n_pairs)
    return square(flat.reshape(shape.n_subjects, shape.n_pairs), shape.n_nodes)


def map_frames(frames: DataFrame, shape: TensorShape, kernel: Callable, schema: str) -> DataFrame:
    """Apply ``kernel(cond, t, graphs) -> DataFrame`` to every frame, without a shuffle."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                yield kernel(row.cond, row.t, unpack(row.pos, row.w, shape))

    return frames.mapInPandas(run, schema)


def edge_rows(cond: str, t: int, shape: TensorShape, **values: np.ndarray) -> pd.DataFrame:
    """Upper triangles of (subjects, nodes, nodes) arrays as long rows; all-zero cells are left out."""
    r, c = flat_pairs(shape.n_nodes)
    flat = {name: v[:, r, c].ravel() for name, v in values.items()}
    keep = np.flatnonzero(np.logical_or.reduce([v != 0 for v in flat.values()]))
    out = {
        "cond": cond, "subj": np.asarray(shape.subjects, dtype=object)[keep // r.size],
        "i": r[keep % r.size], "j": c[keep % r.size], "t": t,
    }
    return pd.DataFrame({**out, **{name: v[keep] for name, v in flat.items()}}, index=range(keep.size))


def node_gram(graphs: np.ndarray) -> np.ndarray:
    """Gram of the node unfolding (both node modes agree: the graphs are symmetric)."""
    return np.einsum("sik,sjk->ij", graphs, graphs, optimize=True)


def subject_gram(graphs: np.ndarray) -> np.ndarray:
    flat = graphs.reshape(graphs.shape[0], -1)
    return flat @ flat.T


def frame_grams(frames: DataFrame, shape: TensorShape, transform: Callable | None = None) -> DataFrame:
    """Mode Gram matrices over all given frames: (cond, mode, r, c, g).

    ``transform(cond, t, graphs)`` may replace each frame's graphs before they are folded in.

    Each task folds its frames into one matrix per condition and mode before the shuffle,
    so what is shuffled does not depend on the number of frames.
    """
    shape.require_modes_fit()

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                graphs = unpack(row.pos, row.w, shape)
                if transform is not None:
                    graphs = transform(row.cond, row.t, graphs)
                for mode, gram in (("node", node_gram(graphs)), ("subject", subject_gram(graphs))):
                    sums[(row.cond, mode)] = sums.get((row.cond, mode), 0.0) + gram
        for (cond, mode), gram in sums.items():
            r, c = np.indices(gram.shape)
            yield pd.DataFrame({"cond": cond, "mode": mode, "r": r.ravel(), "c": c.ravel(), "g": gram.ravel()})

    parts = frames.mapInPandas(run, "cond string, mode string, r bigint, c bigint, g double")
    return parts.groupBy("cond", "mode", "r", "c").agg(F.sum("g").alias("g"))


def collect_grams(grams: DataFrame, shape: TensorShape) -> dict[tuple[str, str], np.ndarray]:
    """Bring the summed Gram matrices (nodes^2 + subjects^2 numbers per condition) to the driver."""
    size = {"node": shape.n_nodes, "subject": shape.n_subjects}
    out = {(cond, mode): np.zeros((n, n)) for cond in shape.conds for mode, n in size.items()}
    for row in grams.collect():
        out[(row.cond, row.mode)][row.r, row.c] = row.g
    return out
