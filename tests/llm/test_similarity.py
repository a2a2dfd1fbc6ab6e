"""Joins on similarity against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.llm import ngram_join, vectors
from netweave.llm.components import components

from .conftest import TEXTS


def roots(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return [top(k) for k in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((50, 40), (200, 150)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(20)]
        df = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")
        found = {r.node: r.root for r in components(df).collect()}
        want = roots(n, links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert found == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---- n-grams -------------------------------------------------------------------------------


def grams_of(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}


def plain_groups(docs):
    sets = [grams_of(t) for _, t in docs]
    links = [
        (a, b) for a in range(len(docs)) for b in range(a + 1, len(docs))
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    group = roots(len(docs), links)
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [docs[x][0] for x in range(len(docs)) if group[x] == group[k] and docs[x][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(seed, families, size, words=60):
    """Families of texts, each member with a few words changed; some parts are shared by all."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    docs = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            docs.append(" ".join(own) + (" " + passage if rng.random() < 0.5 else ""))
    rng.shuffle(docs)
    return [(k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("config", [
    ngram_join.NgramConfig(),
    # small limits: many blocks, columns and flushes, and heavy n-grams
    ngram_join.NgramConfig(block=4, columns=16, flush=500, block_chars=2000, heavy_least=6, heavy_share=0.0, sketch_bits=14),
])
def test_ngram_groups_against_all_pairs(spark, config):
    docs = near_copies(7, 6, 14) + [(900 + k, t) for k, t in enumerate(["", None, " \t", "a b", "A  b", "a b c"])] + [(0, near_copies(7, 6, 14)[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, config).collect()]
    assert sorted(found, key=str) == plain_groups(docs)
    assert len({c for _, _, c in found}) < len(docs)


def test_ngram_hard_rows_and_no_rows(spark, odd_docs, no_docs):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd_docs).collect()]
    assert sorted(found, key=str) == plain_groups([r[:2] for r in TEXTS])
    assert ngram_join.near_duplicates(no_docs).collect() == []


def test_product_forest_connects_like_all_pairs():
    rng = np.random.default_rng(1)
    config = ngram_join.NgramConfig(columns=8)
    sets = [np.unique(rng.choice(30, size=rng.integers(5, 25)).astype(np.uint64)) for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    links = list(ngram_join.product_links(np.arange(40), sizes, sets, np.full(40, 2), config))
    full = [
        (a, b) for a in range(40) for b in range(a + 1, 40)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    ]
    assert roots(40, links) == roots(40, full) and len(links) < 40 and {tuple(sorted(x)) for x in links} <= set(full)


def test_posting_packets_round_trip():
    rng = np.random.default_rng(0)
    grams, nodes = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(-2**62, 2**62, 50)[rng.integers(0, 50, 1000)]
    order = rng.integers(0, 2**32, 1000).astype(np.uint32)
    data = ngram_join._pack_postings(grams, nodes, order)
    back = ngram_join._unpack_postings(data, 1000, len(np.unique(nodes)))
    by = np.argsort(grams, kind="stable")
    assert all((a == b).all() for a, b in zip(back, (grams[by], nodes[by], order[by])))


# ---- vectors -------------------------------------------------------------------------------


def plain_vectors(rows):
    units = []
    for _, v in rows:
        x = None if not v or any(c is None for c in v) else np.array(v, dtype=np.float64)
        units.append(x / np.linalg.norm(x) if x is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    links = [
        (a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
        if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95
    ]
    group = roots(len(rows), links)
    count = [sum(k in x for x in links) for k in range(len(rows))]
    return sorted((
        (i, count[k], min(rows[x][0] for x in range(len(rows)) if group[x] == group[k])) for k, (i, _) in enumerate(rows)
    ), key=str)


@pytest.mark.parametrize("config", [vectors.VectorConfig(), vectors.VectorConfig(window=20, block=16)])
def test_vectors_against_all_pairs(spark, config):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(150)]
    centre = rng.standard_normal(16)
    rows += [(200 + k, (centre + 0.12 * rng.standard_normal(16)).tolist()) for k in range(60)]
    rows += [(300 + k, rows[3][1]) for k in range(40)] + [(3, rows[3][1]), (340, [2 * x for x in rows[3][1]])]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [nan] * 16), (405, [inf] + [1.0] * 15), (406, [1.0] * 8), (407, [1.0] * 8), (408, [1e-200] * 16), (409, [1e200] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("key", F.lit("k")).withColumn("copies", F.lit(1))
    found = vectors.near_duplicates(df, config).collect()
    want = plain_vectors([(i, v) for i, v in rows if i < 408])  # a plain norm of the last two overflows
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found if r.vec_id < 408), key=str) == want
    assert {r.vec_id: r.component_id for r in found}[409] == 408
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_no_rows(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_vectors_on_the_table_settle_by_passes(spark, small, monkeypatch):
    """No pair of the given table reaches the threshold, and its denser vectors need no comparison of all with all."""
    monkeypatch.setattr(vectors, "_all_links", None)
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert found == {i: n for i, n, _ in plain_vectors([(r.vec_id, list(r.embedding)) for r in df.collect()])}


def planted_table(n=1500, dim=64):
    """Even vectors, a dense cone, a hot group of copies, and groups of near copies around 0.95."""
    rng = np.random.default_rng(17)
    x = planted_cone(0.8, n, dim, pairs=120)
    x[n // 2: n // 2 + 200] = x[n // 2]
    for k in range(min(60, (n - n // 2 - 215) // 5)):
        at, turn = n // 2 + 210 + 5 * k, rng.standard_normal((4, dim))
        x[at + 1: at + 5] = x[at] + turn / np.linalg.norm(turn, axis=1, keepdims=True) * rng.uniform(0.2, 0.36, (4, 1))
    return x * rng.uniform(0.5, 2, (n, 1))


def test_planted_links_against_all_rows(spark):
    """Recall of the query rows (id divisible by 50) and of all rows against brute force; no link below the threshold."""
    x = planted_table()
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    want = {i: n for i, n, _ in plain_vectors([(k, v.tolist()) for k, v in enumerate(x)])}
    asked = [i for i in want if i % 50 == 0]
    assert sum(want[i] for i in asked) > 100
    for ids in (asked, list(want)):
        assert sum(found[i] for i in ids) >= 0.999 * sum(want[i] for i in ids) and all(found[i] <= want[i] for i in ids)


def test_query_and_sql_agree_where_there_are_links(spark, tmp_path):
    import duckdb

    from netweave.llm.queries import ORACLES, op7_embedding_near_dedup

    x = planted_table(600, 32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 32)], "vec_id bigint, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLES['op7_embedding_near_dedup']})").fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op7_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert got == want and sum(r[1] for r in want) > 10000


def planted_cone(cosine, n=4000, dim=64, pairs=200):
    """Unit vectors, a third of them in a cone (``cosine`` between any two), with planted pairs at 0.95 to 0.96 in it."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    own = rng.standard_normal((n, dim))
    own[: n // 3] -= np.outer(own[: n // 3] @ centre, centre)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = own.copy()
    x[: n // 3] = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * own[: n // 3]
    for k in range(pairs):
        turn = rng.standard_normal(dim)
        turn -= (turn @ x[2 * k]) * x[2 * k]
        c = rng.uniform(0.95, 0.96)
        x[2 * k + 1] = c * x[2 * k] + np.sqrt(1 - c * c) * turn / np.linalg.norm(turn)
    return x


def window_recall(spark, x, config):
    """Share of all linked pairs that window_links puts into one component."""
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows, distinct = vectors.distinct_vectors(df, "vec_id", "embedding")
    at = {r.key: r.id for r in rows.collect()}
    top = roots(len(x), [(at[r.a], at[r.b]) for r in vectors.window_links(distinct, config).collect()])
    a, b = np.nonzero(np.triu(x @ x.T >= config.threshold + 1e-9, 1))
    assert len(a) >= 20
    return sum(top[i] == top[j] for i, j in zip(a.tolist(), b.tolist())) / len(a)


@pytest.mark.parametrize("config", [vectors.VectorConfig(window=8), vectors.VectorConfig(window=8, least_settled=0.99, rest_block=200)])
def test_vectors_recall_in_a_dense_cone(spark, config):
    assert window_recall(spark, planted_cone(0.9), config) >= 0.999


def test_windows_reach_over_small_partitions(spark):
    """49 vectors are one window, so one pass finds all links, however many sort partitions there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert window_recall(spark, planted_cone(0.0, n=49, pairs=24), vectors.VectorConfig(passes=1)) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
