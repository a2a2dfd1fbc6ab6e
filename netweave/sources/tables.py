"""Readers and writers for the tables, tensors and reports the engine exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_SCHEMA = T.StructType([
    T.StructField("cond", T.StringType()),
    T.StructField("subj", T.StringType()),
    T.StructField("i", T.LongType()),
    T.StructField("j", T.LongType()),
    T.StructField("t", T.LongType()),
    T.StructField("w", T.DoubleType()),
])
CHANGE_POINT_SCHEMA = "cond string, method string, ord int, frame long, ms double"
QUALITY_COLUMNS = ["k", "selection_score", "u", "h", "c", "q"]


# Declared so that opening a table costs no schema-inference job.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def read_edges(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """A stored tensor; ``frames`` (inclusive) prunes to the row groups of a time slice."""
    edges = spark.read.schema(EDGE_SCHEMA).parquet(path)
    return edges if frames is None else edges.filter(F.col("t").between(*frames))


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by condition and sorted by frame inside every file, for slice reads."""
    (
        edges.select(*EDGE_SCHEMA.names)
        .repartitionByRange("cond", "t")
        .sortWithinPartitions("cond", "t", "subj", "i", "j")
        .write.mode(mode).partitionBy("cond").parquet(path)
    )


def discover_subjects(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """Sorted subject ids, optionally the first ``limit``."""
    ids = signals.select("subj").distinct().orderBy("subj")
    return ids if limit is None else ids.limit(limit)


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated layout; blank, 'n/a' and unparsable coordinates become NULL."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="name string, x string, y string, z string")
    return raw.select("name", *[F.expr(f"try_cast(trim({c}) AS double)").alias(c) for c in "xyz"])


def electrode_positions(layout: DataFrame, radius: float = 0.96) -> DataFrame:
    """Turn the layout so the nose points up and scale it into the head circle."""
    turned = layout.select("name", (-F.col("y")).alias("x"), F.col("x").alias("y"))
    turned = turned.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    reach = turned.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("r")).scalar()
    scale = F.lit(radius) / F.when(reach > 0, reach).otherwise(1.0)
    return turned.select("name", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))


def read_change_points(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Stored change points; with ``expected``, fail on a wrong count or unordered times."""
    points = spark.read.schema(CHANGE_POINT_SCHEMA).parquet(path)
    return points if expected is None else check_change_points(points, expected)


def check_change_points(points: DataFrame, expected: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("cond", "method")
    step = F.col("ms") - F.lag("ms").over(w.orderBy("ord"))
    checked = points.withColumn("_n", F.count("*").over(w)).withColumn("_step", step)
    bad_n = F.raise_error(F.concat(F.lit(f"expected {expected} boundaries, got "), F.col("_n").cast("string")))
    bad_step = F.raise_error(F.lit("change points must be strictly increasing"))
    ok = F.when(F.col("_n") != expected, bad_n).when(F.col("_step") <= 0, bad_step).otherwise(F.col("ms"))
    return checked.withColumn("ms", ok.cast("double")).drop("_n", "_step")


def write_result(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists") -> None:
    """Results (low-rank, scores, labels, consensus) as Parquet by condition and method."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV report with ten significant digits for doubles."""
    cols = [
        F.format_string("%.10g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ]
    df.select(*cols).write.mode(mode).csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def matrix_wide(cells: DataFrame, n_nodes: int, value: str = "w") -> DataFrame:
    """Symmetric matrix as one row per node and one column per other node."""
    both = cells.select("i", "j", value).union(cells.select("j", "i", value))
    wide = both.groupBy("i").pivot("j", list(range(n_nodes))).sum(value)
    return wide.na.fill(0.0).orderBy("i")


def write_epochs(epochs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Epochs (subj, trial, ch, ..., v array) in ranges of subjects, sorted inside every file: a subject's trials are read from few row groups."""
    epochs.repartitionByRange("subj", "trial").sortWithinPartitions("subj", "trial", "ch").write.mode(mode).parquet(path)


def read_epochs(spark: SparkSession, path: str, schema: str | None = None, subjects: list | None = None) -> DataFrame:
    """Stored epochs, optionally of some subjects only: the condition reaches the scan and prunes by row-group statistics."""
    epochs = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return epochs if subjects is None else epochs.filter(F.col("subj").isin(*subjects))


def write_layout(layout: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Electrodes (name, x, y, z) as tab-separated text; NULL is written as n/a."""
    layout.select("name", *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in "xyz"]).write.mode(mode).csv(path, sep="\t", header=True)
