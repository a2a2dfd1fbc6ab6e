"""From raw documents to packed training bins: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last
return the columns of ``docs`` (doc_id, text, lang, source, n_chars; others pass through with their values, whatever their
names and types: stages see them as one struct). Rows with null ids pass every filter that can't name them. The
result has no SQL: language and toxicity models are learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import exact, language, ngram_join, packing, toxicity
from netweave.llm.queries import remainder
from netweave.stage import new_path, stage

#: documents whose language is less certain than this go, as do those without a letter
LEAST_LANGUAGE_SCORE = 0.3


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and one struct of all other columns: no name of theirs can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, *([] if rest else [F.lit(0).alias("none")])).alias("rest"))


def _unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return rows.select(*[c if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def _first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of those that agree in ``keys``, by a hash of all columns: a grouping, combined before the shuffle."""
    held = [c for c in rows.columns if c not in keys]
    whole: Column = F.xxhash64("text", F.to_json("rest"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*held), whole).alias("first")).select(*keys, "first.*")


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more; trained on the labelled ones outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return _unwrapped(toxicity.score(_wrapped(docs), model).where("predicted = 0"), docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a likely language."""
    model = language.fit(docs.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))))
    found = language.identify(_wrapped(docs), model)
    return _unwrapped(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)), docs)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space keep the one with the smallest id; of repeated rows one."""
    index = exact.DigestIndex(spark, new_path(spark, "digests"))
    kept = index.add(docs, "corpus").where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    index.close()
    keyed = _wrapped(docs).withColumn("digest", exact.digest(F.col("text")))
    joined = keyed.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return _unwrapped(_first_of(joined, "digest", "doc_id"), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.75) keep the one with the smallest id, nulls last; of repeated rows one.

    Rows are known by a hash of id and text, as ids may repeat. Texts without a shingle all stay.
    """
    keyed = _wrapped(docs).withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = ngram_join.near_duplicates(keyed, id_col="key").where("n_shingles > 0").groupBy("key", "component_id").agg(F.count("*").alias("n"))
    groups = stage(found.join(keyed.select("key", "doc_id").distinct(), "key"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key").alias("first"))
    first = stage(groups.groupBy("component_id").agg(F.min(place).alias("least")).select("component_id", "least.first"))
    placed = stage(groups.join(first, "component_id").select("key", "n", "first"))
    kept = keyed.join(placed.where("key <> first").select("key"), "key", "left_anti")
    repeated = placed.where("key = first and n > 1").select("key")
    if not repeated.isEmpty():
        again = _first_of(kept.join(repeated, "key", "left_semi"), "key")
        kept = kept.join(repeated, "key", "left_anti").unionByName(again)
    return _unwrapped(kept, docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 16384 UTF-8 bytes with at most four documents of one source and no two of equal text."""
    return packing.pack(docs, F.octet_length("text"), F.col("source"), packing.text_cluster(F.col("text")))


STAGES = [
    ("toxicity", keep_ordinary),
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_first_copies),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("best_fit_packing", pack_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every result is a table on shared storage before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = new_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
