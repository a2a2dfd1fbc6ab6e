"""The registered query of every operator, over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import chat, exact, language, lengths, lines, mixing, ngram_join, packing, pieces, repair, search, toxicity, vectors
from netweave.stage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def remainder(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: deals documents to training and held-out sets. Null for null ids."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_chat_formatting", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text,
    md5(coalesce(text, '')) AS h, row_number() OVER () AS n FROM conversations),
 v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
 s AS (SELECT conv_id, perspective, turn, speaker, h, n, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      ELSE 'user name=' || replace(regexp_replace(speaker, '[\n\r]', ' ', 'g'), '<|', '< |') END || chr(10) AS header, text || '<|im_end|>' AS body FROM t JOIN v USING (conv_id)),
 p AS (SELECT *, length(header) + length(body) + 1 AS size, sum(length(header) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, h, n) AS fin FROM s),
 c AS (SELECT *, (fin - size)::BIGINT AS begin, (fin - size)::BIGINT // 65536 AS chunk FROM p),
 m AS (SELECT *, begin - min(begin) OVER (PARTITION BY conv_id, perspective, chunk) + length(header) AS a FROM c)
SELECT conv_id, perspective, chunk, count(*) AS n_turns,
  sha256(string_agg(header || body || chr(10), '' ORDER BY begin)) AS text_sha256,
  coalesce(string_agg(a || ':' || (a + length(body)), ';' ORDER BY begin) FILTER (own), '') AS masks,
  coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked
FROM m GROUP BY conv_id, perspective, chunk""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return out.select(
        "conv_id", "perspective", "chunk", "n_turns", F.sha2("text", 256).alias("text_sha256"),
        F.array_join(spans, ";").alias("masks"), "n_masked",
    )


@query("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact.DigestIndex(spark, new_path(spark, "digests"))
    out = index.add(table(spark, sf_dir, "documents"), "documents")
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))  # rows without an id are never held out
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = docs.select(lengths.token_count(spark, F.col("text")).alias("n_tokens"))
    return lengths.context_limits(lengths.length_histogram(counts))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, F.octet_length("text"), F.col("source"), packing.text_cluster(F.col("text")))


@query("op7_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE e IS NOT NULL
   AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
 r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = r.vec_id GROUP BY r.vec_id""")
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
 g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS gram FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m ON m.doc_id = d.doc_id""")
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_line_dedup", r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
 f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(turns), keys=turns)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query("op12_ranked_search", r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 f AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 s AS MATERIALIZED (SELECT row, sum(tf)::BIGINT AS n FROM f GROUP BY 1),
 c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM s),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
   FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY 1),
 r AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
   FROM q JOIN w USING (term) JOIN f USING (term) JOIN s USING (row), c GROUP BY 1, 2, 3)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '')) AS name, coalesce(q.w, 1.0)::DOUBLE AS w
  FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS w FROM labels
    WHERE quality IS NOT NULL GROUP BY 1) q USING (doc_id)),
 k AS (SELECT *, -ln((('0x' || substr(md5('mix:' || name), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
 o AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt,
    2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
 c AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - (sum(most) OVER r - most)) / (sum(wt) OVER () - (sum(wt) OVER r - wt)) AS level
   FROM o WINDOW r AS (ORDER BY most / wt, place)),
 t AS (SELECT source, source_size, CASE WHEN l IS NULL THEN most ELSE least(most, l * wt) END AS target
   FROM c, (SELECT arg_min(level, (most / wt, place)) FILTER (level <= most / wt) AS l FROM c)),
 p AS (SELECT k.*, source_size, target, floor(target)::BIGINT AS budget, (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id
     NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))))::BIGINT AS taken
FROM e""")
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(
        F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("quality")
    )
    return mixing.mix(table(spark, sf_dir, "documents"), labels).select("doc_id", "size", "source_size", "target", "taken")
