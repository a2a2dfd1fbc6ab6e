"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.llm.pieces import text_blocks
from netweave.llm.words import hashed_words, letters, mix

_LETTERS = letters()


@dataclass(frozen=True)
class ToxicityConfig:
    window: int = 32  # words compressed at once
    ordinary_bytes: int = 32768  # dictionary sizes
    toxic_bytes: int = 32768
    min_docs: int = 3  # toxic documents that must hold a word or phrase before it may enter the toxic dictionary
    min_ratio: float = 3.0  # how much more usual it must be in toxic than in ordinary documents
    false_share: float = 0.05  # expected share of words and phrases that enter by chance
    phrase: int = 3  # words of the longest phrase
    max_toxic: int = 1500  # bounds of the training sample, in documents
    max_ordinary: int = 3000
    max_chars: int = 10000  # longer documents are not trained on


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents and the calibration: score = logistic(weights . [1, features])."""

    config: ToxicityConfig
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _coded(words: np.ndarray) -> bytes:
    """A text as the compressor sees it: every word by its 64-bit code, so that a match is a whole word."""
    return words.astype("<u8").tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        13, hash_log=18, chain_log=18, window_log=18, strategy=zstandard.STRATEGY_BTLAZY2, min_match=6,
        write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


class Scorer:
    """Compresses windows with the ordinary dictionary alone and with the toxic one before it.

    What the second saves is text that is usual in toxic documents and in no ordinary one.
    """

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.plain = _compressor(model.ordinary) if model.toxic else None
        self.both = _compressor(model.toxic + model.ordinary) if model.toxic else None

    def features(self, words: np.ndarray) -> tuple[float, float, float]:
        """(bytes saved per 100 words, most saved in a window, log of bytes saved)."""
        if not len(words) or self.both is None:
            return 0.0, 0.0, 0.0
        size = self.model.config.window * 8
        coded = _coded(words)
        saved = [
            len(self.plain.compress(coded[k:k + size])) - len(self.both.compress(coded[k:k + size])) for k in range(0, len(coded), size)
        ]
        total = max(0, sum(saved))
        return min(50.0, 100 * total / len(words)), float(min(50, max(saved))), float(np.log1p(total))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.both is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.model.weights[0])))
        hashes, ends = hashed_words(texts, _LETTERS)
        starts = np.concatenate([[0], ends[:-1]])
        x = np.array([(1.0, *self.features(hashes[a:b])) for a, b in zip(starts, ends)])
        return 1 / (1 + np.exp(-(x @ np.array(self.model.weights))))


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def _samples(words: list[np.ndarray]) -> list[bytes]:
    return [_coded(w[k:k + 128]) for w in words for k in range(0, len(w), 128)]


def _phrases(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in text order; of one word the word's own."""
    out = words[: max(0, len(words) - size + 1)]
    for k in range(1, size):
        out = mix(out * np.uint64(3) + words[k:k + len(out)])
    return out


def _by_chance(held: np.ndarray, usual: np.ndarray, share: float) -> np.ndarray:
    """Binomial chance that at least ``held`` of held + usual holders are toxic if each is so with the chance ``share``."""
    pairs, back = np.unique(np.stack([held, usual], axis=1), axis=0, return_inverse=True)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, pairs.sum(axis=1).max(initial=1) + 1)))])
    out = np.ones(len(pairs))
    for k, (h, u) in enumerate(pairs.tolist()):
        n, x = h + u, np.arange(h, h + u + 1)
        terms = log_factorial[n] - log_factorial[x] - log_factorial[n - x] + x * np.log(share) + (n - x) * np.log1p(-share)
        out[k] = np.exp(terms).sum()
    return out[back.ravel()]


def _telling(toxic: list[np.ndarray], ordinary: list[np.ndarray], config: ToxicityConfig) -> np.ndarray:
    """Units that distinct units of toxic documents hold more often than chance explains (Benjamini-Hochberg over all units of enough documents)."""
    found, held = np.unique(np.concatenate(toxic), return_counts=True)
    known, counts = np.unique(np.concatenate(ordinary), return_counts=True)
    if not len(found) or not len(known):
        return found[held >= min(config.min_docs, len(toxic))]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    usual = np.where(known[at] == found, counts[at], 0)
    least = min(config.min_docs, len(toxic))
    tested = (held >= least) & (held / len(toxic) >= config.min_ratio * usual / len(ordinary))
    family = ((held + usual) >= least).sum() + (counts[~np.isin(known, found)] >= least).sum()
    found, held, usual = found[tested], held[tested], usual[tested]
    chance = _by_chance(held, usual, sum(map(len, toxic)) / (sum(map(len, toxic)) + sum(map(len, ordinary))))
    order = np.argsort(chance, kind="stable")
    passed = np.flatnonzero(chance[order] <= config.false_share * np.arange(1, len(order) + 1) / family)
    return np.sort(found[order[: passed[-1] + 1 if len(passed) else 0]])


def _stretches(words: np.ndarray, telling: list[np.ndarray]) -> np.ndarray:
    """The words of a document that belong to a telling word or phrase, in text order."""
    inside = np.zeros(len(words), dtype=bool)
    for size, units in enumerate(telling, 1):
        starts = np.flatnonzero(np.isin(_phrases(words, size), units))
        for k in range(size):
            inside[starts + k] = True
    return words[inside]


def _unlike(docs: list[np.ndarray], known: np.ndarray, size: int = 8) -> list[int]:
    """Places of the documents (distinct words) without later near copies, which would make any of their words look usual.

    Near copies share half or more of the ``size`` smallest hashes of the words that no ordinary document holds.
    """
    kept, holders = [], {}
    for place, doc in enumerate(docs):
        at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
        marks = doc[known[at] != doc][:size].tolist() if len(known) else doc[:size].tolist()
        shared: dict[int, int] = {}
        for m in marks:
            for k in holders.get(m, ()):
                shared[k] = shared.get(k, 0) + 1
        if marks and max(shared.values(), default=0) >= max(2, len(marks) / 2):
            continue
        for m in marks:
            holders.setdefault(m, []).append(len(kept))
        kept.append(place)
    return kept


def train(texts: list[str], labels: list[int], keys: list[int], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Dictionaries from three quarters of the documents, calibration on the rest (dealt by ``keys``).

    Both dictionaries are trained on text in its order. Of toxic documents, without near copies, the words enter that belong to a word or
    phrase which more toxic documents hold than chance explains, each document counting once.
    """
    labels = np.array(labels, dtype=int)
    if not labels.any() or labels.all():
        return ToxicityModel(config, b"", b"", (9.0 if len(labels) and labels.all() else -9.0,))
    docs = [hashed_words([t], _LETTERS)[0] for t in texts]
    fit = np.array([zlib.crc32(f"fit{k}".encode()) % 4 != 0 for k in keys])
    for part in (fit, ~fit):  # a sample too small to part serves for both
        if not labels[part].any() or labels[part].all():
            fit = np.ones(len(labels), dtype=bool)
    ordinary = [d for d, f, y in zip(docs, fit, labels) if f and not y]
    toxic = [d for d, f, y in zip(docs, fit, labels) if f and y]
    toxic = [toxic[k] for k in _unlike([np.unique(d) for d in toxic], np.unique(np.concatenate(ordinary)))]
    telling = [
        _telling(*([np.unique(_phrases(d, size)) for d in part] for part in (toxic, ordinary)), config) for size in range(1, config.phrase + 1)
    ]
    toxic = [_stretches(d, telling) for d in toxic]
    model = ToxicityModel(
        config, _dictionary(config.ordinary_bytes, _samples(ordinary), 64),
        _dictionary(config.toxic_bytes, [s for s in _samples(toxic) if s], 32) if any(map(len, toxic)) else b"", (-9.0,),
    )
    if not model.toxic:
        return model
    held_back = ~fit if not fit.all() else fit
    scorer = Scorer(model)
    x = np.array([(1.0, *scorer.features(d)) for d, b in zip(docs, held_back) if b])
    return ToxicityModel(config, model.ordinary, model.toxic, tuple(_logistic(x, labels[held_back])))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    config: ToxicityConfig = ToxicityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Train on a bounded sample of the labelled documents, drawn by the hash of their ids.

    Null labels and ids are left out; a document is toxic if any of its labels says so; of texts that share an id the
    one with the smallest hash is taken. The sample's ids are
    at most ``max_toxic + max_ordinary`` rows, so joining them by broadcast is bounded, as is what reaches the driver.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label is not null"
    ).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))

    def drawn(label: int, most: int) -> DataFrame:
        return known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)

    sample = drawn(1, config.max_toxic).unionByName(drawn(0, config.max_ordinary))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        F.char_length("text") <= config.max_chars
    )
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("id").toLocalIterator()
    drawn = [(r.text, r.label, r.id) for r in rows]
    return train([d[0] for d in drawn], [d[1] for d in drawn], [d[2] for d in drawn], config)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but any former ``score`` and ``predicted``, with score (0 to 1) and predicted (score >= 0.5).

    Every whole text is scored from its text alone; null and empty texts score as a text without any toxic word.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer.scores(texts) for _, _, texts in text_blocks(batch.column(place))]
            found = np.concatenate(parts) if parts else np.zeros(0)
            columns = [*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)
