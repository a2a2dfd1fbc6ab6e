"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # of the sources in code-point order, repeating
    share: float = 1.5  # of all sizes that the mix has
    most_epochs: float = 2.0  # no source is taken more often
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, size, target) from (source, size), each source once: shares by weight, none above its limit.

    Sources stand in code-point order, null last, and take the weights in turn. What a limit cuts off goes to the
    others by weight, again and again; the end of that is one level for which target = min(limit, level * weight).
    With sources in order of limit / weight the level follows from running sums, so nothing iterates, and
    any number of sources stays distributed.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sizes.select("source", F.col("source").isNull().alias("no_source"), "size", F.lit(0).alias("all"))
    rows = _ranged(rows, parts, "no_source", "source")
    place = running(rows, ["all"], ["no_source", "source"], F.col("part"), {"place": (F.lit(1), "sum")})
    cycle = F.array(*[F.lit(float(w)) for w in config.weights])
    rows = place.drop("part").withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(config.weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("size") * config.most_epochs).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = _ranged(rows, parts, "ratio", "place")
    sums = {"most_upto": (F.col("most"), "sum"), "weight_upto": (F.col("weight"), "sum")}
    rows = stage(running(rows, ["all"], ["ratio", "place"], F.col("part"), sums))
    whole = rows.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole.size is None:
        return rows.select("source", "size", F.col("ratio").alias("target"))
    left = F.lit(config.share * whole.size) - (F.col("most_upto") - F.col("most"))
    level = left / (F.lit(whole.weight) - (F.col("weight_upto") - F.col("weight")))
    free = rows.select("ratio", "place", level.alias("level")).where(F.col("level") <= F.col("ratio"))
    found = free.agg(F.min_by("level", F.struct("ratio", "place")).alias("level")).first().level
    target = F.col("most") if found is None else F.least(F.col("most"), F.lit(found) * F.col("weight"))
    return rows.select("source", "size", target.alias("target"))


def _ranged(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """The rows stored in ranges of ``order``; ``part`` grows along it."""
    return stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def exponential(identity: Column, seed: str) -> Column:
    """Exponential variate of rate 1 from 52 bits of an MD5 of seed and identity: reruns draw alike.

    Divided by a weight it is a key by which rows stand in the order of weighted draws without replacement.
    """
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity)), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 1) / F.lit(float(1 << 52)))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    config: MixConfig = MixConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken): one row per input row.

    A source whose target is e times its size and a rest takes every document e times, then documents in the order
    of their keys until their sizes fill the rest; the document at the border gives its first words only, so
    a source's words are its target rounded down. ``taken`` are a document's words in the mix, ``epochs`` its
    whole passes. ``quality`` has positive weights (id, quality), the largest of an id counts; documents without one, and null,
    zero, negative and not finite weights, count as 1.

    Defined results: null, empty and white texts have size 0 and take 0; a source of such texts has target 0; a null
    source is a source, the last one. Rows with equal id, text and source have equal keys and stand in a
    row. Ids may be null or repeat, other columns are ignored, no rows give no rows. Texts are read by one scan and never
    shuffled. Prefix sums run over ranges of (source, key) with one carried row a range, so a source may hold most
    rows; weights and sources join by plain joins.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    identity = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        exponential(identity, config.seed).alias("key"),
    )
    if quality is not None:
        weight = F.col("quality").cast("double")
        sound = quality.where((weight > 0) & (weight < float("inf"))).groupBy(F.col(id_col).alias("id")).agg(F.max(weight).alias("weight"))
        rows = stage(rows).join(sound, "id", "left").withColumn("key", F.col("key") / F.coalesce("weight", F.lit(1.0))).drop("weight")
    rows = stage(rows)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), config)
    order = ["key", "no_id", "id", "size"]
    keyed = rows.withColumn("no_source", F.col("source").isNull()).withColumn("no_id", F.col("id").isNull())
    keyed = _ranged(keyed, parts, "no_source", "source", *order)
    placed = running(
        keyed.withColumn("named", F.coalesce("source", F.lit(""))), ["no_source", "named"], order, F.col("part"), {"upto": (F.col("size"), "sum")},
    )
    # by name and flag: a plain equi-join with few rows on one side, whose hot keys adaptive execution splits
    targets = targets.select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named"), F.col("size").alias("source_size"), "target",
    )
    joined = placed.join(targets, ["no_source", "named"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    again = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    return joined.withColumn("epochs", epochs).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + again).cast("long").alias("taken"),
    )
