"""Source mixing: targets against a plain refill loop, weighted draws, hard rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.llm import mixing as mx

from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Refill by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {(None if k == 3 else f"s{k}{'é' if k % 5 else ''}"): int(x) for k, x in enumerate(rng.pareto(0.7, 40) * 50)}
    rows = mx.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint").repartition(3)).collect()
    want = plain_targets(sizes)
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(t, 6) for s, t in want.items()}


def check_mix(rows, texts):
    sizes = {}
    for _, text, _, source in texts:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(*r, "k", 1.0, 2) for r in TEXTS], "doc_id bigint, text string, lang string, source string, key string, target double, size int")
    rows = mx.mix(docs.repartition(3)).collect()
    assert len(rows) == len(TEXTS)
    check_mix(rows, TEXTS)
    again = mx.mix(docs.repartition(5), docs.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_no_rows(spark, no_docs):
    assert mx.mix(no_docs).collect() == []
    empty = spark.createDataFrame([(1, None, None, "a"), (2, "", None, None)], "doc_id bigint, text string, lang string, source string")
    assert [(r.size, r.taken, r.target) for r in mx.mix(empty).collect()] == [(0, 0, 0.0)] * 2


def test_odd_weights_count_as_one(spark):
    docs = spark.createDataFrame([(k, f"w{k} x y", "s", w) for k, w in enumerate([None, 0.0, -1.0, float("nan"), float("inf"), 1.0])], "doc_id int, text string, source string, w double")
    weights = docs.select("doc_id", F.col("w").alias("quality"))
    assert sorted(mx.mix(docs, weights.unionByName(weights)).collect()) == sorted(mx.mix(docs).collect())


def test_heavier_documents_come_first(spark):
    """First draws follow the weights: one source, a third of its words wanted."""
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'s' AS source", "if(id % 4 = 0, 3.0, 1.0) AS w")
    config = mx.MixConfig(weights=(1.0,), share=0.05)
    drawn = mx.mix(docs, docs.selectExpr("doc_id", "w AS quality"), config).where("taken > 0").selectExpr("avg(if(doc_id % 4 = 0, 1, 0)) AS heavy").first().heavy
    assert drawn == pytest.approx(0.5, abs=0.05)  # a quarter of the rows with three times the weight
