"""Chat formatting: every participant's view of a dialogue, with training masks; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(role: Column, name: Column) -> Column:
    """A turn's first line; a name takes one line and can't hold a marker."""
    name = F.replace(F.regexp_replace(name, r"[\n\r]", " "), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: tuple[str, ...] = ("system",),
    chunk_chars: int = 65536,
) -> DataFrame:
    """Render each dialogue once for every participant: that speaker as assistant, others as named users.

    Returns (conv, perspective, chunk, n_turns, text, masks, n_masked): the chunks of a perspective, in order,
    are its rendered dialogue; a chunk takes the turns that start within its ``chunk_chars``
    characters, so no row grows with a dialogue. ``masks`` holds [start, end) in the chunk's text of what
    is trained on: the assistant's contents with their end markers.

    Participants are the speakers not named in ``system``; a dialogue without any gives no row. Null speakers
    are one participant, "unknown". System turns stay system turns in all views. Null texts are
    empty. Turns go by number, null numbers last, then by speaker and the text's MD5; repeated
    rows are all rendered. Rows without a dialogue id form one dialogue. ``<|`` in a text or a name is written
    ``< |`` and a line end in a name a space, so neither can forge a turn. Other columns are ignored.

    One dialogue may hold most rows: rows are dealt by ranges of (dialogue, view, turn), positions are running
    sums with one carried row for a range, and the join with participants is a plain one that
    adaptive execution splits.
    """
    spark = turns.sparkSession
    rows = stage(turns.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("-")).alias("key"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"), F.monotonically_increasing_id().alias("row"),
    ))
    views = stage(rows.where(~F.col("speaker").isin(*system)).select("key", F.col("speaker").alias("view")).distinct())
    own = F.col("speaker") == F.col("view")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*system), "system").otherwise("user")
    header = _header(role, F.when(role == "user", F.col("speaker")))
    body = F.concat("text", F.lit(CLOSE))
    order = ["no_turn", "turn", "speaker", "text_md5", "row"]
    seen = rows.join(views, "key").select(
        "key", "conv", "view", F.col("turn").isNull().alias("no_turn"), "turn", "speaker", "text_md5", "row",
        F.concat(header, body, F.lit("\n")).alias("segment"),
        F.when(own, F.char_length(header)).alias("mask_start"), F.when(own, F.char_length(header) + F.char_length(body)).alias("mask_end"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = stage(seen.repartitionByRange(parts, "key", "view", *order).withColumn("part", F.spark_partition_id()))
    size = F.char_length("segment").cast("long")
    placed = running(seen, ["key", "view"], order, F.col("part"), {"end": (size, "sum")})
    start = F.col("end") - size
    chunks = placed.withColumn("start", start).withColumn("chunk", F.floor(F.col("start") / chunk_chars)).groupBy("key", "view", "chunk").agg(
        F.first("conv").alias("conv"), F.count("*").alias("n_turns"), F.min("start").alias("from"),
        F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end"))).alias("parts"),
    )
    trained = F.filter("parts", lambda x: x["mask_start"].isNotNull())
    masks = F.transform(trained, lambda x: F.struct(
        (x["start"] - F.col("from") + x["mask_start"]).alias("start"), (x["start"] - F.col("from") + x["mask_end"]).alias("end")
    ))
    return chunks.select(
        F.col("conv").alias(conv_col), F.col("view").alias("perspective"), "chunk", "n_turns",
        F.array_join(F.col("parts.segment"), "").alias("text"), masks.alias("masks"),
        F.aggregate(masks, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_masked"),
    )
