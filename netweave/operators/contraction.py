"""Contraction of one axis with a matrix, block by block: a task multiplies many fibres by a block of columns at once.

Cells are shuffled once, as they are; nothing is copied for each row of the matrix before it is summed. A matrix of up to
`MATRIX_ENTRIES` entries goes along with the tasks (its size is checked); a larger one is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.subspace import add_arrays

MATRIX_ENTRIES = 1 << 22
#: types that number rows and columns
ARROW = {"int": pa.int32(), "bigint": pa.int64()}
#: positions of the contracted axis in a block
AXIS_BLOCK = 1024


@dataclass(frozen=True)
class Matrix:
    """A sparse matrix (row, col, m) as arrays: names of rows and columns, values and which cells are stored."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    stored: np.ndarray

    def columns(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the columns, which of the wanted ones exist)."""
        at = np.minimum(np.searchsorted(self.cols, wanted), max(len(self.cols) - 1, 0))
        return at, (self.cols[at] == wanted) if len(self.cols) else np.zeros(len(wanted), dtype=bool)


def small_matrix(matrix: DataFrame) -> Matrix | None:
    """The matrix on the driver, None if it has more than `MATRIX_ENTRIES` entries, stored or not. Repeated entries add up."""
    size = matrix.agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols")).first()
    if size["rows"] * size["cols"] > MATRIX_ENTRIES:
        return None
    cells = matrix.groupBy("row", "col").agg(F.sum("m").alias("m")).collect()
    rows, cols = (np.array(sorted({r[n] for r in cells})) for n in ("row", "col"))
    values, stored = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
    for r in cells:
        at = np.searchsorted(rows, r["row"]), np.searchsorted(cols, r["col"])
        values[at], stored[at] = r["m"], 1.0
    return Matrix(rows, cols, values, stored)


def contract_cells(cells: DataFrame, matrix: DataFrame, axis: str, block: int = AXIS_BLOCK) -> DataFrame:
    """Contract ``axis`` of cells (..., w), absent ones being 0, with ``matrix`` (row, col, m): the axis becomes row.

    A fibre (the cells that agree in all other columns) comes in blocks of the axis. A batch of blocks is one dense product. Rows of the matrix
    that meet no cell of a fibre have no result.
    """
    small = small_matrix(matrix)
    rest = [c for c in cells.columns if c not in (axis, "w")]
    row_type = dict(matrix.dtypes)["row"]
    if small is None:
        joined = cells.join(matrix.withColumnRenamed("col", axis), axis)
        return joined.groupBy(*rest, F.col("row").alias(axis)).agg(F.sum(F.col("m") * F.col("w")).alias("w"))
    shared = cells.sparkSession.sparkContext.broadcast(small)
    fibres = cells.groupBy(*rest, F.expr(f"`{axis}` div {block}").alias("_block")).agg(
        F.collect_list(F.struct(F.col(axis).cast("long").alias("at"), F.col("w").cast("double").alias("w"))).alias("x")
    )
    keys = [*rest, "_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = part.column(len(keys))
                owner = np.repeat(np.arange(part.num_rows), np.asarray(x.value_lengths()))
                flat = x.flatten()
                at, known = m.columns(flat.field("at").to_numpy())
                dense, met = np.zeros((part.num_rows, len(m.cols))), np.zeros((part.num_rows, len(m.cols)))
                np.add.at(dense, (owner[known], at[known]), flat.field("w").to_numpy()[known])
                met[owner[known], at[known]] = 1.0
                both = np.concatenate([dense @ m.values.T, met @ m.stored.T], axis=1)
                cuts = pa.array(np.arange(part.num_rows + 1) * both.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(cuts, pa.array(both.ravel()))], [*keys, "y"])

    kinds = dict(fibres.dtypes)
    n = len(small.rows)
    parts = fibres.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", y array<double>")
    names = F.array(*[F.lit(x.item()) for x in small.rows]).cast(f"array<{row_type}>")
    sums = add_arrays(parts, rest, "y", 2 * n)
    zipped = F.arrays_zip(names.alias("name"), F.slice("y", 1, n).alias("w"), F.slice("y", n + 1, n).alias("met"))
    cells_out = sums.select(*rest, F.inline(zipped)) if n else sums.select(*rest, F.lit(None).cast(row_type).alias("name"), F.lit(0.0).alias("w"), F.lit(0.0).alias("met"))
    return cells_out.where("met > 0").select(*rest, F.col("name").alias(axis), "w")


def contract_arrays(rows: DataFrame, matrix: DataFrame, keys: list[str], axis: str = "ch", value: str = "v") -> DataFrame:
    """(*keys, axis, value): rows of arrays of equal length mixed along ``axis`` by the matrix; rows that are absent count as 0.

    All rows that agree in ``keys`` are one product; there must be few of them (channels of a trial).
    """
    small = small_matrix(matrix)
    if small is None:
        raise ValueError("the mixing matrix is too large to go along with the tasks")
    shared = rows.sparkSession.sparkContext.broadcast(small)
    row_type = dict(matrix.dtypes)["row"]
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).cast("long").alias("at"), F.col(value).cast("array<double>").alias("v"))).alias("x"))
    kinds = dict(packed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.column(len(keys))[k].values
                at, known = m.columns(x.field("at").to_numpy())
                if not known.any():
                    continue
                width = len(x.field("v")[0])
                v = x.field("v").flatten().to_numpy().reshape(-1, width)[known]
                present = m.stored[:, at[known]].any(axis=1)
                y = (m.values[:, at[known]] @ v)[present]
                cuts = pa.array(np.arange(len(y) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *(pa.repeat(batch.column(c)[k], len(y)) for c in range(len(keys))), pa.array(m.rows[present], ARROW[row_type]), pa.ListArray.from_arrays(cuts, pa.array(y.ravel())),
                ], [*keys, axis, value])

    return packed.mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + f"`{axis}` {row_type}, `{value}` array<double>")
