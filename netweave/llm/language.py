"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.llm.pieces import text_blocks
from netweave.llm.words import LOWER, letters, mix

#: families of languages by ISO 639-1 code (fixed values); a language not named is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("an", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
UNDETERMINED = "und"

_LETTERS = letters()
BLOCK_CHARS = 400_000


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category (numbers such as ½ or Ⅷ are none)."""
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


@dataclass(frozen=True)
class LanguageConfig:
    buckets: int = 4096  # hashed n-grams of 2 to 4 bytes
    max_languages: int = 200  # bounds of the training sample: the most frequent languages
    max_per_language: int = 800
    max_chars: int = 20000  # longer documents are not trained on
    penalty: float = 1e-4
    rounds: int = 150
    families: dict[str, tuple[str, ...]] = field(default_factory=lambda: FAMILIES)


@dataclass(frozen=True)
class LanguageModel:
    """``families`` in order with their languages; a row of weights for each family, then for each pair."""

    config: LanguageConfig
    families: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    sharpness: float


def features(texts: list[str | None], buckets: int) -> np.ndarray:
    """Unit-length square roots of hashed n-gram frequencies of every whole text; no letters: zeros.

    A-Z count as a-z, whatever is no letter as a space, runs of spaces as one.
    """
    raw = [b" " + t.encode("utf-8", "replace") + b" " if t else b"  " for t in texts]
    buffer = LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    buffer = np.where(_LETTERS[buffer], buffer, 32).astype(np.uint32)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    keep = (buffer != 32) | np.concatenate([[True], buffer[:-1] != 32]) | first
    buffer, owner = buffer[keep], owner[keep]
    counts = np.zeros(len(raw) * buckets)
    gram = buffer.astype(np.uint64)
    for n in range(2, 5):
        if len(buffer) < n:
            break
        gram = gram[:-1] << np.uint64(8) | buffer[n - 1:]
        same = owner[: len(gram)] == owner[n - 1:]
        bucket = (mix(gram[same] * np.uint64(8) + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
        counts += np.bincount(owner[: len(gram)][same] * buckets + bucket, minlength=len(counts))
    counts = np.sqrt(counts.reshape(len(raw), buckets)).astype(np.float32)
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Linear SVM with squared hinge loss, classes weighted equally, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    step, momentum = np.float32(1 / (2.0 + penalty)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = np.float32(penalty) * ahead - 2 * x.T @ (weight * y * slack)
        new = ahead - step * gradient
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + np.float32((momentum - 1) / grown) * (new - w), new, grown
    return w


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.full((len(x), 1), 0.3, dtype=x.dtype)])


def train(texts: list[str], langs: list[str], config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """One-versus-rest SVMs over families, then an SVM for each pair of languages within a family."""
    known = sorted(set(langs))
    of = {lang: name for name, members in config.families.items() for lang in members}
    grouped: dict[str, list[str]] = {}
    for lang in known:
        grouped.setdefault(of.get(lang, f"only {lang}"), []).append(lang)
    families = tuple(tuple(grouped[name]) for name in sorted(grouped))
    x = _with_bias(np.vstack([features(texts[k:k + 256], config.buckets) for k in range(0, len(texts), 256)])) if texts else np.zeros((0, config.buckets + 1))
    names = np.array(langs, dtype=object)
    rows = [_svm(x, np.where(np.isin(names, f), 1.0, -1.0), config.penalty, config.rounds) for f in families] if len(families) > 1 else []
    pairs = tuple((a, b) for f in families for k, a in enumerate(f) for b in f[k + 1:])
    for a, b in pairs:
        part = np.isin(names, (a, b))
        rows.append(_svm(x[part], np.where(names[part] == a, 1.0, -1.0), config.penalty, config.rounds))
    weights = np.array(rows, dtype=np.float32).reshape(len(rows), config.buckets + 1)
    return LanguageModel(config, families, pairs, weights, 3.0)


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score): the score is the family's share times the language's share of the votes within it."""
    if not model.families:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    margins = _with_bias(features(texts, model.config.buckets)) @ model.weights.T.astype(np.float32)
    n_families = len(model.families) if len(model.families) > 1 else 0
    likely = 1 / (1 + np.exp(-2 * model.sharpness * margins.astype(np.float64)))
    if n_families:
        odds = np.exp(2 * model.sharpness * margins[:, :n_families].astype(np.float64))
        family_share = odds / odds.sum(axis=1, keepdims=True)
    else:
        family_share = np.ones((len(texts), 1))
    chosen = family_share.argmax(axis=1)
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for k, family in enumerate(model.families):
        rows = [r for r in np.flatnonzero(chosen == k) if has_letter(texts[r])]
        votes = np.zeros((len(rows), len(family)))
        for p, (a, b) in enumerate(model.pairs):
            if a in family:
                for_a = likely[rows, n_families + p]
                votes[:, family.index(a)] += for_a
                votes[:, family.index(b)] += 1 - for_a
        games = max(1, len(family) - 1)
        share = votes / games if len(family) > 1 else np.ones((len(rows), 1))
        best = share.argmax(axis=1) if len(rows) else []
        for r, b, s in zip(rows, best, share):
            langs[r], scores[r] = family[b], family_share[r, k] * s[b]
    return langs, scores


def fit(docs: DataFrame, config: LanguageConfig = LanguageConfig(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Train on a bounded sample: of the ``max_languages`` most frequent languages ``max_per_language`` rows each, those with the smallest hashes.

    Rows without language, with a longer text than ``max_chars``, or without letters are left out. Rows are drawn by the hash of id and
    text, so rows that share an id, or have none, are drawn like others; of repeated rows one. Distinct rows are estimated map-side; each
    language has a threshold for the hash that about twice the rows wanted pass, and ranks among those keep the bound
    exact before anything reaches the driver. Languages known by few rows are taken whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & (F.char_length("text") <= config.max_chars) & F.col("text").rlike(r"\p{L}")
    ).withColumn("h", F.xxhash64(F.col("id").isNull(), "id", "text"))
    usual = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(config.max_languages).collect()
    if not usual:
        return train([], [], config)
    share = F.create_map(*[F.lit(x) for r in sorted(usual) for x in (r.lang, 2.0 * config.max_per_language / r.n)])
    near = rows.where(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    drawn = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= config.max_per_language).collect()
    drawn.sort(key=lambda r: (r.lang, r.h, r.text))
    return train([r.text for r in drawn], [r.lang for r in drawn], config)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but any former lang_pred and lang_score, with lang_pred and lang_score (0 to 1).

    Each whole text is judged from itself alone. Null texts and texts without a letter are ``und`` with score 0.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, _, texts in text_blocks(batch.column(place), BLOCK_CHARS, 512):
                found, sure = predict(shared.value, texts)
                langs += found
                scores += sure.tolist()
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "lang_score"])

    rows = docs.select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
