"""The pipeline's stages, each on hard rows, on no rows and against a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from netweave.llm import language, toxicity

from .conftest import TEXTS
from .test_similarity import grams_of, plain_groups


@pytest.fixture(scope="module")
def sf_dir(spark, small):
    return small


def test_stage_names():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "language_id", "exact_dedup", "ngram_jaccard", "best_fit_packing"]


@pytest.mark.parametrize("stage", range(4))
def test_filters_keep_columns_and_take_hard_rows(spark, odd_docs, no_docs, sf_dir, stage):
    function = cp.STAGES[stage][1]
    out = function(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns and out.count() <= len(TEXTS)
    empty = function(spark, no_docs, sf_dir)
    assert empty.columns == no_docs.columns and empty.count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_columns_pass_with_their_values(spark, sf_dir, stage):
    """Names that operators use inside, and types that have no order or hash, come through every stage unchanged."""
    names = ["score", "predicted", "lang_pred", "lang_score", "digest", "_digest", "_row", "_key", "key", "rest", "_id", "_kept", "first"]
    text = "the quick brown fox of the old house and its garden in the north, number {} and so on"
    rows = [(k, text.format(k), "en", "s", 9, {"a": k}, *[f"{n}{k}" for n in names]) for k in (1, 2, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `map` map<string,int>, " + ", ".join(f"`{n}` string" for n in names))
    out = [tuple(r) for r in cp.STAGES[stage][1](spark, docs, sf_dir).collect()]
    assert out and all(r in rows for r in out)


def test_held_out_is_never_null(spark, tmp_path, sf_dir):
    import shutil

    from netweave.llm.queries import op3_language_id, op9_toxicity

    for name in ("labels",):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for op in (op3_language_id, op9_toxicity):
        rows = op(spark, str(tmp_path)).collect()
        assert len(rows) == docs.count() and all(r.held_out is (False if r.doc_id is None else r.held_out) and r.held_out is not None for r in rows)


def test_exact_stage(spark, odd_docs, sf_dir):
    kept = sorted((r.doc_id for r in cp.keep_first_copies(spark, odd_docs, sf_dir).collect()), key=str)
    assert kept == sorted([1, 4, 6, 7, 8, 9, 10, None, 11, 12], key=str)


def test_near_copy_stage(spark, odd_docs, sf_dir):
    kept = sorted({r.doc_id for r in cp.keep_one_of_near_copies(spark, odd_docs, sf_dir).collect()}, key=str)
    groups = plain_groups([r[:2] for r in TEXTS])
    assert kept == sorted({i for i, _, c in groups if i is None or i == c}, key=str)


def test_near_copies_with_repeated_and_null_ids(spark, sf_dir):
    words = [f"w{k}" for k in range(60)]
    base, near, clean = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (5, near), (5, clean), (None, near + " x"), (None, clean + " x"), (7, "own text of six words here"), (7, "own text of six words here"),
            (None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z"), (8, ""), (8, "")]
    out = cp.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    want = [rows[0], rows[2], rows[5], rows[7], rows[9], rows[10]]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_last_stage(spark, odd_docs, no_docs, sf_dir):
    assert {r.doc_id for r in cp.pack_bins(spark, odd_docs, sf_dir).collect()} == {t[0] for t in TEXTS}
    assert cp.pack_bins(spark, no_docs, sf_dir).collect() == []


def test_run_against_plain_stages(spark, small):
    """run() keeps what the classifiers keep, then the first of equal texts, then the first of near copies."""
    found = {r.doc_id for r in cp.run(spark, small).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where(cp.remainder("doc_id", 5) != 0)
    docs = toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(*docs.columns)
    model = language.fit(docs.where(cp.remainder("doc_id", 4) != 2))
    rows = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= cp.LEAST_LANGUAGE_SCORE)).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.replace("\n", " ").split(" ")), (r.doc_id, r.text))
    left = list(first.values())
    assert any(grams_of(t) for _, t in left)
    assert found == {i for i, _, c in plain_groups(left) if i == c}
