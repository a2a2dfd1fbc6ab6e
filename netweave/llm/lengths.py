"""Token counts: an exact histogram of encoded lengths and what suffix sums over it answer."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the byte-level vocabulary splits a text before merging (a fixed value of that vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: longer texts are encoded in parts, cut where the pattern always cuts
PART_CHARS = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")

_encodings: dict[str, object] = {}


def _encoding(key: str, ranks: bytes):
    """The encoder of a vocabulary, built once in every Python worker."""
    if key not in _encodings:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encodings[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encodings[key]


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART_CHARS:
        cut = _CUT.search(text, start + PART_CHARS)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of every whole text (long); null and empty texts have none.

    The driver reads the vocabulary file (of fixed size, under 1 MB) and broadcasts its bytes.
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    shared, key = spark.sparkContext.broadcast(ranks), hashlib.md5(ranks).hexdigest()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(key, shared.value).encode_to_numpy
        for texts in batches:
            yield pd.Series([
                sum(len(encode(p, disallowed_special=())) for p in _parts(t)) if t else 0 for t in texts
            ], dtype="int64")

    return count(text)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs): summed map-side; null lengths count as 0. No documents: no rows."""
    return lengths.select(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length")).groupBy("length").agg(
        F.count("*").alias("n_docs")
    )


def context_limits(histogram: DataFrame) -> DataFrame:
    """What every context limit gives, one row for each length that occurs.

    limit, n_docs (of exactly this length), docs_within (length <= limit), docs_longer, total_tokens,
    truncated_tokens (all documents cut to the limit), whole_tokens (of documents within), quantile
    (share of documents within). Sums run over buckets of 1024 lengths, so no window holds them all.
    """
    hist = stage(histogram).withColumn("tokens", F.col("length") * F.col("n_docs"))
    sums = running(hist, [], ["length"], F.shiftright("length", 10), {
        "docs_from": (F.col("n_docs"), "sum", "back"), "tokens_from": (F.col("tokens"), "sum", "back"),
        "docs_within": (F.col("n_docs"), "sum"), "whole_tokens": (F.col("tokens"), "sum"),
    })
    longer = F.col("docs_from") - F.col("n_docs")
    return sums.select(
        F.col("length").alias("limit"), "n_docs", "docs_within", longer.alias("docs_longer"),
        (F.col("whole_tokens") + F.col("tokens_from") - F.col("tokens")).alias("total_tokens"),
        (F.col("whole_tokens") + longer * F.col("length")).alias("truncated_tokens"), "whole_tokens",
        (F.col("docs_within") / (F.col("docs_within") + longer)).alias("quantile"),
    )


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(limit, docs_longer, total_tokens, truncated_tokens) for any stated limits, from `context_limits`.

    Between two lengths that occur nothing changes but the tokens of longer documents, so the last row at or
    below a limit answers it; below the shortest length every document is longer.
    """
    below = F.struct("docs_longer", "whole_tokens")
    found = limits.agg(
        F.max("total_tokens").alias("total"), F.max(F.col("docs_within") + F.col("docs_longer")).alias("docs"),
        *[F.max_by(below, F.when(F.col("limit") <= c, F.col("limit"))).alias(f"b{k}") for k, c in enumerate(wanted)],
    )
    rows = []
    for k, c in enumerate(wanted):
        longer = F.coalesce(F.col(f"b{k}.docs_longer"), F.col("docs"))
        rows.append(F.struct(
            F.lit(c).cast("long").alias("limit"), longer.alias("docs_longer"), F.col("total").alias("total_tokens"),
            (F.coalesce(F.col(f"b{k}.whole_tokens"), F.lit(0)) + longer * F.lit(c)).alias("truncated_tokens"),
        ))
    return found.select(F.inline(F.array(*rows)))


def quantiles(limits: DataFrame, probabilities: list[float]) -> DataFrame:
    """(probability, length): the smallest length within which this share of documents lies."""
    found = limits.agg(*[
        F.min(F.when(F.col("quantile") >= p, F.col("limit"))).alias(f"q{k}") for k, p in enumerate(probabilities)
    ])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.col(f"q{k}").alias("length")) for k, p in enumerate(probabilities)])
    return found.select(F.inline(pairs))
