"""Ranked search against a plain scorer; batches, sketches of few coordinates and hard rows."""

import math
import re
from collections import Counter

import pytest

from netweave.llm import search as se
from netweave.llm.queries import op12_ranked_search

from .conftest import SCHEMA, TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(df, item="item_id"):
    return sorted(((r[item], r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    hashes, ends = se.term_hashes(["Naïve x-9 É_1", "naïve X 9 É 1", None, "- _ !", "É é"])
    assert ends.tolist() == [5, 10, 10, 10, 12] and (hashes[:5] == hashes[5:10]).all() and hashes[10] != hashes[11]


def test_query_on_the_table(spark, small):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]
    want = plain_search(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert found(op12_ranked_search(spark, small)) == want


ITEMS = [(1, "one TWO three"), (2, "alpha omega"), (3, None), (4, ""), (5, "straße über"), (None, "short one"), (6, "nowhere"), (1, "one TWO three"), (7, "12345 " * 3)]


@pytest.mark.parametrize("config", [
    se.SearchConfig(), se.SearchConfig(top=3, coordinates=1, docs=2, rescored=1), se.SearchConfig(coordinates=4, batch_items=1), se.SearchConfig(batch_terms=2),
])
def test_hard_rows(spark, config):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in TEXTS], SCHEMA + ", score int, places double").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumnsRenamed({"text": "question"})
    got = found(se.search(docs, items, config, item_text_col="question"))
    assert got == plain_search([r[:2] for r in TEXTS], dict.fromkeys(ITEMS), config.top)


def test_string_items_and_ties(spark):
    docs = spark.createDataFrame([(k, "same words here" if k % 2 else "other words") for k in range(60)], "doc_id bigint, text string").repartition(7)
    items = spark.createDataFrame([("a", "same"), ("b", "words other")], "name string, text string")
    got = found(se.search(docs, items, item_col="name"), "name")
    assert [r[2] for r in got if r[0] == "a"] and {r[2] for r in got if r[0] == "a"} == {1, 3, 5, 7, 9, 11, 13, 15, 17, 19}
    assert {r[2] for r in got if r[0] == "b"} == {0, 2, 4, 6, 8, 10, 12, 14, 16, 18}


def test_no_rows(spark, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert se.search(no_docs, items).collect() == []
    docs = spark.createDataFrame([r for r in TEXTS], SCHEMA)
    assert se.search(docs, items.where("item_id > 100")).collect() == []
