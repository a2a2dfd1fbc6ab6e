"""Declared dimensions of a connectivity tensor and the size checks that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest frame (subjects x node pairs) a task may hold as one row, in cells (doubles).
MAX_FRAME_CELLS = 1 << 25
# Largest mode (subjects or nodes) whose square Gram matrix may reach the driver.
MAX_MODE_SIZE = 4096


@dataclass(frozen=True)
class TensorShape:
    """What absent rows stand for: every (subject, i < j, frame) not stored is 0."""

    conds: tuple[str, ...]
    subjects: tuple[str, ...]
    n_nodes: int
    n_frames: int

    @property
    def n_subjects(self) -> int:
        return len(self.subjects)

    @property
    def n_pairs(self) -> int:
        return self.n_nodes * (self.n_nodes - 1) // 2

    def require_frame_fits(self) -> None:
        """Refuse, rather than overload a task, when one frame is too large for a row."""
        cells = self.n_subjects * self.n_pairs
        if cells > MAX_FRAME_CELLS:
            raise ValueError(
                f"one frame has {cells} cells, more than {MAX_FRAME_CELLS}; use the long-form operators"
            )

    def require_modes_fit(self) -> None:
        largest = max(self.n_subjects, self.n_nodes)
        if largest > MAX_MODE_SIZE:
            raise ValueError(f"mode of size {largest} exceeds {MAX_MODE_SIZE}: its Gram matrix is too large")


def shape_of(edges: DataFrame) -> TensorShape:
    """Discover the dimensions of a tensor whose dimensions were not declared."""
    row = edges.agg(
        F.sort_array(F.collect_set("cond")).alias("conds"),
        F.sort_array(F.collect_set("subj")).alias("subjects"),
        F.max(F.greatest("i", "j")).alias("node"),
        F.max("t").alias("t"),
    ).first()
    return TensorShape(tuple(row.conds), tuple(row.subjects), row.node + 1, row.t + 1)


def literal_array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def pair_spine(spark: SparkSession, shape: TensorShape, by_subject: bool = False, by_frame: bool = True) -> DataFrame:
    """Every cell the tensor is defined on, generated in the executors without a join."""
    n = shape.n_nodes
    spine = (
        spark.range(0, n - 1)
        .withColumnRenamed("id", "i")
        .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1).cast("bigint"))))
        .withColumn("cond", F.explode(literal_array(shape.conds)))
    )
    if by_subject:
        spine = spine.withColumn("subj", F.explode(literal_array(shape.subjects)))
    if by_frame:
        frames = F.sequence(F.lit(0).cast("bigint"), F.lit(shape.n_frames - 1).cast("bigint"))
        spine = spine.withColumn("t", F.explode(frames))
    return spine


def frame_spine(spark: SparkSession, shape: TensorShape) -> DataFrame:
    return (
        spark.range(0, shape.n_frames)
        .withColumnRenamed("id", "t")
        .withColumn("cond", F.explode(literal_array(shape.conds)))
    )


def densify(edges: DataFrame, shape: TensorShape, value: str = "w") -> DataFrame:
    """Make the implied zeros explicit (needed before ranks, windows and spreads)."""
    by_subject = "subj" in edges.columns
    by_frame = "t" in edges.columns
    spine = pair_spine(edges.sparkSession, shape, by_subject, by_frame)
    return (
        spine.join(edges, spine.columns, "left")
        .select(*spine.columns, F.coalesce(F.col(value), F.lit(0.0)).alias(value))
    )
