"""Tensors, signals and partitions derived from the relational and event tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.shape import TensorShape
from netweave.sources.tables import table

EVENT_GROUPS = 8
EPOCH_SAMPLES = 64


@functools.lru_cache(maxsize=64)
def _trade_shape(session: str, sf_dir: str) -> TensorShape:
    spark = SparkSession.getActiveSession()
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s")).where("s is not null").distinct()
    nodes = table(spark, sf_dir, "nation").agg(F.max("n_nationkey").cast("int").alias("n")).first().n
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("last")).select(month_index("last").alias("t")).first().t
    return TensorShape(("trade",), tuple(sorted(r.s for r in segments.collect())), nodes + 1, last + 1)


def trade_shape(spark: SparkSession, sf_dir: str) -> TensorShape:
    """Segments, nations and months that the tables hold; read once per session and folder."""
    return _trade_shape(spark.sparkContext.applicationId, sf_dir)


@functools.lru_cache(maxsize=64)
def _event_axes(session: str, sf_dir: str) -> tuple[tuple[str, ...], TensorShape]:
    events = table(SparkSession.getActiveSession(), sf_dir, "events")
    types = tuple(sorted(r.e for r in events.select(F.col("event_type").alias("e")).where("e is not null").distinct().collect()))
    last = events.agg(F.max("ts").alias("ts")).select(event_hour().alias("t")).first().t
    return types, TensorShape(("events",), tuple(str(s) for s in range(EVENT_GROUPS)), len(types), last + 1)


def event_types(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Event types in node order."""
    return _event_axes(spark.sparkContext.applicationId, sf_dir)[0]


def event_shape(spark: SparkSession, sf_dir: str) -> TensorShape:
    """User groups, event types and hours that the events hold; read once per session and folder."""
    return _event_axes(spark.sparkContext.applicationId, sf_dir)[1]


@functools.lru_cache(maxsize=64)
def _channels(session: str, sf_dir: str) -> int:
    vecs = table(SparkSession.getActiveSession(), sf_dir, "embeddings")
    return vecs.agg(F.max("label").cast("int").alias("n")).first().n + 1


def n_channels(spark: SparkSession, sf_dir: str) -> int:
    """Channels that the vectors hold; read once per session and folder."""
    return _channels(spark.sparkContext.applicationId, sf_dir)


def month_index(c: str) -> F.Column:
    """Months since January 1995."""
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).cast("bigint")


def first_day(month: int) -> F.Column:
    return F.make_date(F.lit(1995 + month // 12), F.lit(month % 12 + 1), F.lit(1)).cast("timestamp")


def trade_lines(spark: SparkSession, sf_dir: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """One row per order line: (cond, subj, buyer, seller, t, qty); ``frames`` [first, end) prunes the scan.

    Orders meet customers first, so order lines are shuffled only by order and by supplier
    key, and the latter only when suppliers are too large for the optimizer to broadcast.
    Neither join needs its partitioning kept, so adaptive execution can split hot keys.
    """
    line = table(spark, sf_dir, "lineitem")
    if frames:
        line = line.where((F.col("l_shipdate") >= first_day(frames[0])) & (F.col("l_shipdate") < first_day(frames[1])))
    line = line.select(
        "l_orderkey", "l_suppkey", month_index("l_shipdate").alias("t"), F.col("l_quantity").alias("qty")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("subj"), F.col("c_nationkey").cast("bigint").alias("buyer")
    )
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("seller"))
    buyers = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "subj", "buyer")
    # both sides grow with the data and estimates after a join are poor: never broadcast here
    buyers = buyers.hint("merge")
    return (
        line.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_suppkey", "subj", "buyer", "t", "qty")
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.lit("trade").alias("cond"), "subj", "buyer", "seller", "t", "qty")
    )


def trade_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed flows: i = buyer nation, j = seller nation, w = quantity."""
    return (
        trade_lines(spark, sf_dir)
        .groupBy("cond", "subj", F.col("buyer").alias("i"), F.col("seller").alias("j"), "t")
        .agg(F.sum("qty").alias("w"))
    )


def trade_edges(spark: SparkSession, sf_dir: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """Undirected trade tensor: both directions added, domestic trade dropped.

    One shuffle after the joins, with map-side partial sums, so a hot subject or nation
    reaches it as at most one row per cell and task.
    """
    return (
        trade_lines(spark, sf_dir, frames).filter("buyer <> seller")
        .groupBy(
            "cond", "subj", F.least("buyer", "seller").alias("i"), F.greatest("buyer", "seller").alias("j"), "t"
        )
        .agg(F.sum("qty").alias("w"))
    )


def planted_edges(spark: SparkSession, sf_dir: str, factor: float = 8.0) -> DataFrame:
    """Trade tensor whose within-region edges are amplified (region = nation mod 5 here)."""
    region = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").alias("r")
    )
    a = region.select(F.col("n").alias("i"), F.col("r").alias("ri"))
    b = region.select(F.col("n").alias("j"), F.col("r").alias("rj"))
    gain = F.when(F.col("ri") == F.col("rj"), F.lit(factor)).otherwise(1.0)
    return trade_edges(spark, sf_dir).join(a, "i").join(b, "j").select(
        "cond", "subj", "i", "j", "t", (F.col("w") * gain).alias("w")
    )


def party_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-supplier network: quantity by pair. Nodes are 2 x customer key and 2 x supplier key + 1; one subject, one frame."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (2 * F.col("l_suppkey") + 1).cast("bigint").alias("supplier"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (2 * F.col("o_custkey")).cast("bigint").alias("customer"))
    pairs = line.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = F.least("customer", "supplier").alias("i"), F.greatest("customer", "supplier").alias("j")
    return pairs.groupBy(*ends).agg(F.sum("l_quantity").cast("double").alias("w")).select(
        F.lit("party").alias("cond"), F.lit("all").alias("subj"), "i", "j", F.lit(0).cast("bigint").alias("t"), "w"
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given partition of the nations: community = region + 1."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("node"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("community"),
    )


def event_hour(c: str = "ts") -> F.Column:
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return F.floor((F.unix_timestamp(F.col(c).cast("timestamp")) - start) / 3600).cast("bigint")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts per user group, one column per event type."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    return events.groupBy(
        F.lit("events").alias("cond"), (F.col("user_id") % EVENT_GROUPS).cast("string").alias("subj"), event_hour().alias("t")
    ).agg(*[F.count_if(F.col("event_type") == e).cast("double").alias(f"n{k}") for k, e in enumerate(event_types(spark, sf_dir))])


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-activity tensor: product of the hourly counts of two event types."""
    n = len(event_types(spark, sf_dir))
    cells = [
        F.struct(
            F.lit(a).cast("bigint").alias("i"), F.lit(b).cast("bigint").alias("j"),
            (F.col(f"n{a}") * F.col(f"n{b}")).alias("w"),
        )
        for a in range(n) for b in range(a + 1, n)
    ]
    return (
        event_counts(spark, sf_dir)
        .select("cond", "subj", "t", F.inline(F.array(*cells)))
        .filter("w > 0")
    )


def trial_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs (subj, cond, trial, ch, v array) from the vectors; trials may lack channels."""
    vecs = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("ch"), F.col("embedding").cast("array<double>").alias("v")
    )
    ranked = running(vecs, ["ch"], ["vec_id"], F.floor(F.col("vec_id") / 4096), {"k": (F.lit(1), "sum")})
    ranked = ranked.withColumn("k", (F.col("k") - 1).cast("bigint"))
    return ranked.select(
        (F.col("k") % 4).alias("subj"),
        F.when(F.floor(F.col("k") / 4) % 2 == 0, "Correct").otherwise("Incorrect").alias("cond"),
        F.floor(F.col("k") / 8).alias("trial"),
        "ch", "v",
    )


def complete_trials(trials: DataFrame, n_channels: int) -> DataFrame:
    """The trials that hold every channel, as mixing all channels needs."""
    channels = F.count("*").over(Window.partitionBy("subj", "cond", "trial"))
    return trials.withColumn("n", channels).filter(F.col("n") == n_channels).drop("n")


def trial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response events: errors are Incorrect trials, everything else Correct."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subj"),
        (F.unix_timestamp(F.col("ts").cast("timestamp")) - start).alias("sample"),
        "event_id",
        F.when(F.col("event_type") == "error", "Incorrect").otherwise("Correct").alias("code"),
    )
