"""Trackers on a stream of packed frames, with typed state and event-time timers.

A frame is (cond, t, at, pos, w), ``at`` its event time. Frames of a condition are taken in order of t, whatever order they come in:

* the frame that is due is processed at once, and whatever is held behind it;
* an earlier one that comes late, or one that comes twice, changes nothing;
* a frame that comes early is held, with a timer on its time by the clock of the frames. When the watermark passes it, frames still
  missing before it are taken as empty, as absent cells are everywhere.

State of a condition is bounded: two bases, the Gram matrices of one block of frames, one support, and the frames held
within the watermark's delay. Nothing is kept of a frame once it is processed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netweave.functions.linalg import complement, gram_spectrum
from netweave.operators import tracker as tr
from netweave.operators.frames import node_gram, subject_gram, unpack
from netweave.operators.tracker_config import TrackerConfig
from netweave.shape import TensorShape
from netweave.stage import new_path

FRAME_SCHEMA = "cond string, t bigint, at timestamp, pos array<bigint>, w array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameProcessor(StatefulProcessor):
    """Hands a condition's frames to `frame` in order; subclasses keep their own state."""

    def __init__(self, shape: TensorShape):
        self.shape = shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "t bigint")
        self.held = handle.getMapState("held", "t bigint", "pos array<bigint>, w array<double>")
        self.opened(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, held = self._due(), False
        for batch in rows:
            out = []
            for row in batch.sort_values("t").itertuples(index=False):
                t = int(row.t)
                if t == due and not self.held.containsKey((due,)):
                    out += self.frame(key[0], due, unpack(row.pos, row.w, self.shape))
                    due += 1
                elif t >= due and not self.held.containsKey((t,)):
                    self.held.updateValue((t,), ([int(x) for x in row.pos], [float(x) for x in row.w]))
                    self.handle.registerTimer(self.at_ms(t))
                    held = True
            if held or self.held.exists():
                due, more = self._release(key[0], due)
                out += more
            if out:
                yield pd.DataFrame(out, columns=self.columns)
        self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, mark = self._due(), timerValues.getCurrentWatermarkInMs()
        late = sorted(t for (t,) in self.held.keys())
        out = []
        for t in late:
            if t > due and not self._passed(t, expiredTimerInfo.getExpiryTimeInMs(), mark):
                break
            while due < t:
                out += self.frame(key[0], due, unpack([], [], self.shape))
                due += 1
            due, more = self._release(key[0], due)
            out += more
        self.due.update((due,))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Create the subclass's state."""

    def frame(self, cond: str, t: int, graphs: np.ndarray) -> list[tuple]:
        """Process the frame that is due; result rows."""
        raise NotImplementedError

    def at_ms(self, t: int) -> int:
        """Event time of frame ``t``."""
        return self.start_ms + t * self.step_ms

    start_ms, step_ms = 0, 3_600_000
    columns: list[str] = []

    def _due(self) -> int:
        return self.due.get()[0] if self.due.exists() else 0

    def _passed(self, t: int, expired: int, mark: int) -> bool:
        return self.at_ms(t) <= max(expired, mark)

    def _release(self, cond: str, due: int) -> tuple[int, list[tuple]]:
        out = []
        while self.held.containsKey((due,)):
            pos, w = self.held.getValue((due,))
            self.held.removeKey((due,))
            out += self.frame(cond, due, unpack(pos, w, self.shape))
            due += 1
        return due, out


def _flat(x: np.ndarray) -> list[float]:
    return [float(v) for v in np.asarray(x).ravel()]


class _Bases:
    """Typed state of a pair of bases (node, subject): sizes come from the shape, ranks from the lengths."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, shape: TensorShape):
        self.state = handle.getValueState(name, "node array<double>, subject array<double>")
        self.sizes = (shape.n_nodes, shape.n_subjects)

    def get(self) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.state.exists():
            return None
        return tuple(np.array(x).reshape(n, -1) for x, n in zip(self.state.get(), self.sizes))

    def put(self, pair) -> None:
        self.state.update(tuple(_flat(x) for x in pair))


SCORE_COLUMNS = [c.split()[0] for c in tr.SCORE_SCHEMA.split(", ")]


class RecursiveTracker(FrameProcessor):
    """The full recursive tracker: a score row for every update of the bases, as `tracker.track` gives."""

    columns = SCORE_COLUMNS

    def __init__(self, shape: TensorShape, config: TrackerConfig, start_ms: int, step_ms: int):
        super().__init__(shape)
        self.config, self.start_ms, self.step_ms = config, start_ms, step_ms

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.training = _Bases(handle, "training", self.shape)
        self.bases = _Bases(handle, "bases", self.shape)
        self.limits = handle.getValueState("limits", "node double, subject double")
        self.support = handle.getValueState("support", "cells array<bigint>")
        self.block = handle.getListState("block", "t bigint, error double, jaccard double, node array<double>, subject array<double>")

    def frame(self, cond: str, t: int, graphs: np.ndarray) -> list[tuple]:
        train, size = self.config.subspace.train, self.config.subspace.block
        if t < train:
            grams, sums = (node_gram(graphs), subject_gram(graphs)), self.training.get()
            self.training.put(grams if sums is None else [a + b for a, b in zip(sums, grams)])
            if t < train - 1:
                return []
            pair, limits = tr.trained_bases(dict(zip(("node", "subject"), self.training.get())), self.shape, self.config)
            self.bases.put(pair)
            self.limits.update(limits)
            return []
        if t >= self.shape.n_frames - (self.shape.n_frames - train) % size:
            return []  # an unfinished block has no score
        pair = self.bases.get()
        low, sparse, error = tr.separate(np.moveaxis(graphs, 0, 2), *(complement(b) for b in pair), self.config)
        now = np.flatnonzero(np.abs(sparse).ravel() > tr.EPS)
        place = (t - train) % size
        jaccard = None
        if place:
            before = np.array(self.support.get()[0], dtype=int)
            union = np.union1d(now, before).size
            jaccard = 0.0 if union == 0 else 1.0 - np.intersect1d(now, before).size / union
        self.support.update(([int(x) for x in now],))
        flat = np.moveaxis(low, 2, 0)
        self.block.appendValue((t, float(error), jaccard, _flat(node_gram(flat)), _flat(subject_gram(flat))))
        if place < size - 1:
            return []
        rows = [SimpleNamespace(t=r[0], error=r[1], jaccard=r[2], node=r[3], subject=r[4]) for r in self.block.get()]
        scores, events = [], []
        self.bases.put(tr._update(cond, rows, t - size + 1, t, pair, self.limits.get(), self.shape, self.config, scores, events))
        self.block.clear()
        return [tuple(s[c] for c in SCORE_COLUMNS) for s in scores]


class EnergyTracker(FrameProcessor):
    """The simplified tracker: the energy of every frame's sparse part, as `tracker.sparse_energy` gives."""

    columns = ["cond", "t", "v"]

    def __init__(self, shape: TensorShape, train: int, alpha: int, sigma_min: float, tau: float, start_ms: int, step_ms: int):
        super().__init__(shape)
        self.train, self.alpha, self.sigma_min, self.tau, self.start_ms, self.step_ms = train, alpha, sigma_min, tau, start_ms, step_ms

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.training, self.window, self.bases = (_Bases(handle, n, self.shape) for n in ("training", "window", "bases"))

    def _leading(self, grams) -> list[np.ndarray]:
        pair = []
        for gram in grams:
            u, sv = gram_spectrum(gram)
            pair.append(u[:, :max(int((sv > self.sigma_min * sv[0]).sum()), 1)])
        return pair

    def frame(self, cond: str, t: int, graphs: np.ndarray) -> list[tuple]:
        sparse = np.zeros_like(graphs)
        if t >= self.train:
            pair = self.bases.get()
            if pair is None:
                self.bases.put(pair := self._leading(self.training.get()))
            sparse = np.moveaxis(tr.shrink(tr.project_out(np.moveaxis(graphs, 0, 2), *(complement(b) for b in pair)), self.tau), 2, 0)
        low = graphs - sparse
        grams = [node_gram(low), subject_gram(low)]
        if t < self.train:
            sums = self.training.get()
            self.training.put(grams if sums is None else [a + b for a, b in zip(sums, grams)])
        if t % self.alpha == 0:
            # refresh windows are disjoint: one running sum stands for the one being filled
            if t >= self.train:
                self.bases.put(self._leading(self.window.get()))
            self.window.put(grams)
        else:
            self.window.put([a + b for a, b in zip(self.window.get(), grams)])
        return [(cond, t, float(np.linalg.norm(sparse)))]


def _tracked(frames: DataFrame, processor: FrameProcessor, schema: str, delay: str) -> DataFrame:
    require_state_store(frames.sparkSession)
    return frames.withWatermark("at", delay).groupBy("cond").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def require_state_store(spark: SparkSession) -> None:
    """Typed state needs a store with column families: the session's setting is changed to one unless it is."""
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_scores(frames: DataFrame, shape: TensorShape, config: TrackerConfig, start_ms: int, step_ms: int, delay: str = "1 day") -> DataFrame:
    """Scores of the full tracker on a stream of frames: a row for every update, appended as blocks fill.

    ``start_ms`` and ``step_ms`` place frame t on the event-time axis; ``delay`` is how long an early frame waits for those before it.
    """
    shape.require_modes_fit()
    return _tracked(frames, RecursiveTracker(shape, config, start_ms, step_ms), tr.SCORE_SCHEMA, delay)


def stream_sparse_energy(
    frames: DataFrame, shape: TensorShape, train: int, alpha: int, sigma_min: float, tau: float = 0.01,
    start_ms: int = 0, step_ms: int = 3_600_000, delay: str = "1 day",
) -> DataFrame:
    """Streaming counterpart of `tracker.sparse_energy`: (cond, t, v), appended as frames fall due."""
    return _tracked(frames, EnergyTracker(shape, train, alpha, sigma_min, tau, start_ms, step_ms), "cond string, t bigint, v double", delay)


def replay(frames: DataFrame, run: Callable[[DataFrame], DataFrame], files: int = 8, files_per_batch: int = 1) -> DataFrame:
    """Stream stored frames (cond, t, at, pos, w) through ``run`` until all are taken; what it appended, as a stored table.

    Input, checkpoint and result lie in the session's shared folder, so a restarted query goes on where it stopped.
    """
    spark = frames.sparkSession
    source, result, checkpoint = (new_path(spark, name) for name in ("frames", "streamed", "stream-state"))
    frames.select("cond", "t", "at", "pos", "w").repartitionByRange(files, "t", "cond").sortWithinPartitions("t").write.parquet(source)
    before = spark.conf.get(_PROVIDER)
    stream = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = run(stream)
    try:
        query = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(result)
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(out.schema).parquet(result)
