"""Pairing Incorrect trials with Correct ones near in time.

``events(subj, sample, event_id, code)`` is ordered by (sample, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

ORDER = ["sample", "event_id"]
# Samples per bucket of the running counts: long recordings of one subject split here.
BUCKET = 86_400


def _bucket():
    return F.floor(F.col("sample") / BUCKET)


def nearest_correct(events: DataFrame) -> DataFrame:
    """Closest Correct trial of every Incorrect one, reuse allowed; ties go to the earliest.

    Running maximum/minimum of the Correct times replaces the pairing of all trials.
    """
    correct = F.when(F.col("code").startswith("Correct"), F.col("sample"))
    seen = running(events, ["subj"], ORDER, _bucket(), {"prev": (correct, "max"), "next": (correct, "min", "back")})
    wrong = seen.filter(F.col("code").startswith("Incorrect"))
    near = F.when(
        F.col("next").isNull() | (F.col("sample") - F.col("prev") <= F.col("next") - F.col("sample")), F.col("prev")
    ).otherwise(F.col("next"))
    wrong = wrong.select("subj", "event_id", "sample", near.alias("match_sample")).filter("match_sample is not null")
    first = (
        events.filter(F.col("code").startswith("Correct"))
        .groupBy("subj", F.col("sample").alias("match_sample")).agg(F.min("event_id").alias("match_id"))
    )
    return wrong.join(first, ["subj", "match_sample"]).withColumn("gap", F.abs(F.col("sample") - F.col("match_sample")))


def _match_stretch(wrong: list, slots: list) -> list[tuple]:
    """Nearest free slot per Incorrect trial of one independent stretch, in order."""
    n = len(slots)
    first = slots[0]["pos"] if n else 0
    times = [x["sample"] for x in slots]
    down = list(range(n + 1))  # down[k]: slot k - 1 is free if down[k] == k, else look at down[k]
    up = list(range(n + 1))  # up[k]: slot k is free if up[k] == k, else look at up[k]; n = none

    def root(link: list[int], k: int) -> int:
        while link[k] != k:
            link[k] = link[link[k]]
            k = link[k]
        return k

    out = []
    for x in wrong:
        at = min(max(x["pos"] - first, 0), n)
        lo, hi = root(down, at) - 1, root(up, at)
        if lo < 0 and hi >= n:
            continue
        near_left = lo >= 0 and (hi >= n or x["sample"] - times[lo] <= times[hi] - x["sample"])
        take = lo if near_left else hi
        down[take + 1], up[take] = take, take + 1
        out.append((x["event_id"], x["sample"], x["ord"], times[take]))
    return out


def _match(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        rows = []
        for row in pdf.itertuples(index=False):
            slots = [] if row.slots is None else list(row.slots)
            rows.extend((row.subj, *pair) for pair in _match_stretch(list(row.wrong), slots))
        yield pd.DataFrame(rows, columns=["subj", "event_id", "sample", "ord", "match_sample"])


def balance_trials(events: DataFrame) -> DataFrame:
    """One-to-one greedy matching: each Incorrect trial, in order, takes the nearest unused
    Correct trial (before or after; ties to the earliest) until none is left.

    The greedy order is sequential, but trials far apart cannot affect each other. Number
    the Correct trials of a subject 0, 1, ...; an Incorrect trial sits at ``pos``, the
    number of Correct trials before it. If all trials so far moved right, they would fill
    slots up to ``reach``; if all later ones moved left, down to ``floor``. Nearest-free
    matching fills no more than that on either side, so wherever ``reach`` of one trial is
    at or below ``floor`` of the next, the two sides are independent. Both bounds are
    running extremes, and only the stretches between such cuts are matched sequentially.
    Result: matched pairs (subj, event_id, sample, match_id, match_sample).
    """
    correct = F.col("code").startswith("Correct").cast("bigint")
    counted = stage(running(
        events, ["subj"], ORDER, _bucket(),
        {"pos": (correct, "sum"), "seen": (1 - correct, "sum")},
    ))
    wrong = counted.filter(F.col("code").startswith("Incorrect")).select(
        "subj", "sample", "event_id", "pos", (F.col("seen") - 1).alias("ord")
    ).withColumn("d", F.col("ord") - F.col("pos"))
    wrong = running(
        wrong, ["subj"], ORDER, _bucket(), {"lowest": (F.col("d"), "min"), "highest": (F.col("d"), "max", "back")}
    )
    wrong = wrong.select(
        "subj", "sample", "event_id", "pos", "ord",
        (F.col("ord") + 1 - F.col("lowest")).alias("reach"),
        (F.col("ord") - 1 - F.col("highest")).alias("floor"),
    )
    before = wrong.select("subj", (F.col("ord") + 1).alias("ord"), F.col("reach").alias("prev_reach"))
    cut = F.when(F.col("prev_reach") <= F.col("floor"), 1).otherwise(0)
    wrong = stage(wrong.join(before, ["subj", "ord"], "left").withColumn("cut", cut))
    wrong = stage(running(wrong, ["subj"], ORDER, _bucket(), {"part": (F.col("cut").cast("bigint"), "sum")}))
    spans = wrong.groupBy("subj", "part").agg(F.min("floor").alias("lo"), (F.max("reach") - 1).alias("hi"))
    wanted = spans.select(
        "subj", "part", F.explode(F.sequence(F.greatest("lo", F.lit(0)), F.col("hi"))).alias("pos")
    )
    slots = counted.filter(F.col("code").startswith("Correct")).select(
        "subj", (F.col("pos") - 1).alias("pos"), "sample"
    )
    slots = wanted.join(slots, ["subj", "pos"]).groupBy("subj", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "sample"))).alias("slots")
    )
    stretches = wrong.groupBy("subj", "part").agg(
        F.sort_array(F.collect_list(F.struct("ord", "pos", "sample", "event_id"))).alias("wrong")
    ).join(slots, ["subj", "part"], "left")
    taken = stretches.mapInPandas(
        _match, "subj bigint, event_id bigint, sample bigint, ord bigint, match_sample bigint"
    )
    # among Correct trials of the same time the earliest unused is taken, whoever comes first
    same = Window.partitionBy("subj", "match_sample")
    taken = taken.withColumn("nth", F.row_number().over(same.orderBy("ord")))
    named = events.filter(F.col("code").startswith("Correct")).select(
        "subj", F.col("sample").alias("match_sample"), F.col("event_id").alias("match_id")
    ).withColumn("nth", F.row_number().over(same.orderBy("match_id")))
    return taken.join(named, ["subj", "match_sample", "nth"]).select(
        "subj", "event_id", "sample", "match_id", "match_sample"
    )


def balanced_events(pairs: DataFrame) -> DataFrame:
    """Matched pairs back to an event list (subj, sample, event_id, code)."""
    both = F.array(
        F.struct("sample", "event_id", F.lit("Incorrect").alias("code")),
        F.struct(F.col("match_sample").alias("sample"), F.col("match_id").alias("event_id"), F.lit("Correct").alias("code")),
    )
    return pairs.select("subj", F.inline(both))
