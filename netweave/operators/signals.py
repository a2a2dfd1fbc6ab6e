"""From continuous signals to phase-locking tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netweave.functions.linalg import flat_pairs
from netweave.operators.contraction import contract_arrays
from netweave.stage import stage

# Trials of one subject kept together in a task; more are spread over further tasks.
TRIAL_CHUNK = 32
# Partial cross-spectra a task keeps open before it passes them on to the shuffle.
MAX_OPEN_SUMS = 16
# Trials whose short-time spectra are formed at once.
SPECTRA_ROWS = 256


def pick_channels(signals: DataFrame, keep: list[str], rename: dict[str, str]) -> DataFrame:
    """Keep the configured channels and give them their montage names."""
    ch = F.col("ch")
    named = ch
    for old, new in rename.items():
        named = F.when(ch == old, new).otherwise(named)
    return signals.withColumn("ch", named).filter(F.col("ch").isin(*keep))


def classify_trials(events: DataFrame, code: str = "code") -> DataFrame:
    """3-character codes only: same first and last character is Correct, else Incorrect."""
    c = F.col(code)
    same = F.substring(c, 1, 1) == F.substring(c, 3, 1)
    return events.filter(F.length(c) == 3).withColumn("class", F.when(same, "Correct").otherwise("Incorrect"))


def cut_epochs(signal: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Windows of ``signal(subj, ch, sample, v)`` around ``events(subj, sample, trial, ...)``.

    Every position with an event expands to its sample positions once, however many events share it; an equi-join fetches
    the samples and another one brings events and windows together. Windows with missing samples are dropped. Result: (subj, trial, ch, v array, ...);
    further columns of events must agree within a trial.
    """
    width = before + after + 1
    offsets = F.sequence(F.lit(-before), F.lit(after))
    rest = [c for c in events.columns if c not in ("subj", "sample", "trial")]
    trials = stage(events.groupBy("subj", "trial").agg(F.collect_list("sample").alias("onsets"), *[F.first(c).alias(c) for c in rest]))
    wanted = trials.select("subj", F.explode("onsets").alias("onset")).distinct().select("*", F.explode(offsets).alias("t"))
    found = wanted.withColumn("sample", F.col("onset") + F.col("t")).join(signal, ["subj", "sample"])
    windows = stage(found.groupBy("subj", "onset", "ch").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x")))
    once = trials.where("size(onsets) = 1").withColumn("onset", F.col("onsets")[0]).join(windows.where(F.size("x") == width), ["subj", "onset"])
    several = trials.where("size(onsets) > 1")
    if not several.isEmpty():  # a trial named by several events has all their samples
        parts = several.withColumn("onset", F.explode("onsets")).join(windows, ["subj", "onset"]).groupBy("subj", "trial", "ch")
        whole = parts.agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"), *[F.first(c).alias(c) for c in rest]).where(F.size("x") == width)
        once = once.select("subj", "trial", "ch", "x", *rest).unionByName(whole)
    return once.select("subj", "trial", "ch", F.transform("x", lambda x: x["v"]).alias("v"), *rest)


def spatial_filter(signals: DataFrame, matrix: DataFrame) -> DataFrame:
    """Linear channel mixing (surface Laplacian, reference) by ``matrix(row, col, m)``; channels that a trial lacks count as 0.

    A trial is one matrix product; its channels are shuffled as whole arrays.
    """
    mixed = contract_arrays(signals, matrix, ["subj", "cond", "trial"])
    return mixed.select("subj", "cond", "trial", "ch", F.posexplode("v").alias("t", "x"))


def _spectral(v: Column, rate_hz: float, lo: float | None, hi: float | None, analytic: bool, out) -> Column:
    def transform(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        spec = np.fft.fft(x, axis=1)
        if lo is not None:
            freq = np.abs(np.fft.fftfreq(n, 1.0 / rate_hz))
            spec[:, (freq < lo) | (freq > hi)] = 0.0
        if analytic:
            gain = np.zeros(n)
            gain[0] = 1.0
            gain[1:(n + 1) // 2] = 2.0
            if n % 2 == 0:
                gain[n // 2] = 1.0
            spec *= gain
        y = np.fft.ifft(spec, axis=1)
        return np.concatenate([y.real, y.imag], axis=1) if analytic else y.real

    @F.pandas_udf(out)
    def run(col: pd.Series) -> pd.Series:
        res = pd.Series([None] * len(col), dtype=object)
        for _, same in col.groupby(col.map(len)):
            rows = transform(np.stack(same.to_list()).astype(float))
            for k, y in zip(same.index, rows):
                res[k] = y
        return res

    return run(v)


def band_pass(v: Column, rate_hz: float, lo: float, hi: float) -> Column:
    """Zero-phase ideal band filter: Fourier bins outside [lo, hi] Hz are removed."""
    return _spectral(v, rate_hz, lo, hi, False, T.ArrayType(T.DoubleType()))


def analytic_signal(v: Column) -> Column:
    """Real part then imaginary part (Hilbert transform), concatenated."""
    return _spectral(v, 1.0, None, None, True, T.ArrayType(T.DoubleType()))


def short_time_spectrum(v: Column, window: int, bins: tuple[int, ...]) -> Column:
    """Windowed Fourier transforms at every sample: real parts by (sample, bin), then imaginary parts, concatenated.

    The window is a raised cosine of ``window`` samples that starts window / 2 before the sample; samples beyond the ends are 0.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), dtype=object)
        for _, same in col.groupby(col.map(len)):
            for at in range(0, len(same), SPECTRA_ROWS):
                slab = same.iloc[at:at + SPECTRA_ROWS]
                for k, row in zip(slab.index, windowed_spectra(np.stack(slab.to_list()).astype(float), window, bins)):
                    out[k] = row
        return out

    return run(v)


def windowed_spectra(x: np.ndarray, window: int, bins: tuple[int, ...]) -> np.ndarray:
    """`short_time_spectrum` of the rows of ``x``."""
    m = np.arange(window)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * m / window)
    waves = taper * np.exp(-2j * np.pi * np.outer(bins, m) / window)
    padded = np.pad(x, ((0, 0), (window // 2, window)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, window, axis=1)[:, : x.shape[1]]
    z = (frames @ waves.T).reshape(len(x), -1)
    return np.concatenate([z.real, z.imag], axis=1)


def band_locking(trials: DataFrame, n_channels: int, n_samples: int, window: int, bins: tuple[int, ...]) -> DataFrame:
    """Phase locking (cond, subj, i, j, t, w) in a time-frequency band: per sample and bin over trials, then the mean over the bins.

    Cross-spectra of all bins are summed per task before the shuffle, as in `phase_locking`; every bin is a sample of its own there.
    """
    spectra = trials.withColumn("a", short_time_spectrum(F.col("v"), window, bins)).select("subj", "cond", "trial", "ch", "a")
    long = locking_edges(phase_locking(spectra, n_channels), n_channels, n_samples * len(bins))
    sample = F.floor(F.col("t") / len(bins)).cast("bigint").alias("t")
    return long.groupBy("cond", "subj", "i", "j", sample).agg(F.avg("w").alias("w"))


def phase_locking(analytic: DataFrame, n_channels: int) -> DataFrame:
    """|mean over trials of exp(i (phase_c - phase_d))| per subject, condition, pair, sample.

    ``analytic(subj, cond, trial, ch, a)`` with ``a`` from `analytic_signal`; channels are
    numbered 0..n-1. A pair is averaged over the trials that hold both channels. Trials are salted into chunks of at
    most TRIAL_CHUNK and summed per task before the final aggregation, so a subject with
    many trials is spread over many tasks and little is shuffled.
    """
    r, c = flat_pairs(n_channels)
    salted = analytic.withColumn("salt", F.floor(F.col("trial") / TRIAL_CHUNK)).repartition("subj", "cond", "salt")
    packed = salted.groupBy("subj", "cond", "salt", "trial").agg(F.sort_array(F.collect_list(F.struct("ch", "a"))).alias("chs"))
    packed = packed.select("subj", "cond", "trial", F.col("chs.ch").alias("ch"), F.col("chs.a").alias("z"))
    out = T.StructType([
        analytic.schema["subj"], analytic.schema["cond"],
        T.StructField("n", T.ArrayType(T.LongType())), T.StructField("re", T.ArrayType(T.DoubleType())),
        T.StructField("im", T.ArrayType(T.DoubleType())),
    ])

    def rows(sums: dict) -> pa.RecordBatch:
        columns = list(zip(*((s, k, n, total.real, total.imag) for (s, k), (n, total) in sums.items())))
        kinds = (key_types[0], key_types[1], pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], out.names)

    key_types = tuple(to_arrow_type(analytic.schema[k].dataType) for k in ("subj", "cond"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):  # one trial at a time leaves Arrow
                subj, cond = (batch.column(x)[k].as_py() for x in (0, 1))
                ch, lists = (batch.column(x)[k].values for x in (3, 4))
                a = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                n = a.shape[1] // 2
                z, held = np.zeros((n_channels, n), dtype=complex), np.zeros(n_channels, dtype=bool)
                at = ch.to_numpy(zero_copy_only=False)
                z[at], held[at] = np.exp(1j * np.arctan2(a[:, n:], a[:, :n])), True
                both = np.repeat((held[r] & held[c]).astype(np.int64), n)
                count, total = sums.get((subj, cond), (0, 0.0))
                sums[(subj, cond)] = (count + both, total + (z[r] * np.conj(z[c])).ravel())
                if len(sums) > MAX_OPEN_SUMS:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    sums = packed.mapInArrow(partial, out)
    cells = (
        sums.select("subj", "cond", F.posexplode(F.arrays_zip("n", "re", "im")).alias("pos", "x"))
        .groupBy("subj", "cond", "pos")
        .agg(F.sum("x.n").alias("n"), F.sum("x.re").alias("re"), F.sum("x.im").alias("im"))
        .where("n > 0")
    )
    w = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    return cells.select("subj", "cond", "pos", w.alias("w"))


def locking_edges(locking: DataFrame, n_channels: int, n_samples: int) -> DataFrame:
    """Turn the packed position into (i, j, t)."""
    r, c = flat_pairs(n_channels)
    pair = F.floor(F.col("pos") / n_samples).cast("int")
    ends = F.array(*[F.struct(F.lit(int(a)).cast("bigint").alias("i"), F.lit(int(b)).cast("bigint").alias("j")) for a, b in zip(r, c)])
    return (
        locking.select("cond", "subj", "w", F.get(ends, pair).alias("e"), (F.col("pos") % n_samples).cast("bigint").alias("t"))
        .select("cond", F.col("subj").cast("string").alias("subj"), "e.i", "e.j", "t", "w")
    )


def evoked_response(trials: DataFrame, t0: int, base: tuple[int, int], scale: float = 1e6) -> DataFrame:
    """Trial mean per (subj, cond, ch, t), minus its mean over ``base`` samples, scaled.

    ``t0`` is the position of time zero; ``base`` is relative to it, inclusive.
    """
    from pyspark.sql import Window

    mean = (
        trials.select("subj", "cond", "ch", F.posexplode("v").alias("pos", "x"))
        .groupBy("subj", "cond", "ch", (F.col("pos") - t0).cast("bigint").alias("t"))
        .agg(F.avg("x").alias("x"))
    )
    w = Window.partitionBy("subj", "cond", "ch")
    ground = F.avg(F.when(F.col("t").between(*base), F.col("x"))).over(w)
    return mean.select("subj", "cond", "ch", "t", ((F.col("x") - F.coalesce(ground, F.lit(0.0))) * scale).alias("v"))


def trial_report(events: DataFrame) -> DataFrame:
    """Per subject: status and trial counts by class (a subject without errors is skipped)."""
    counts = events.groupBy("subj").agg(
        F.count_if(F.col("code").startswith("Correct")).alias("correct"),
        F.count_if(F.col("code").startswith("Incorrect")).alias("incorrect"),
    )
    return counts.withColumn("status", F.when(F.col("incorrect") > 0, "SUCCESS").otherwise("SKIPPED: no incorrect trials"))


def captured(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(row) -> dict`` for every row, with its key columns kept; where it raises, its result is NULL and ``error`` says why.

    Key columns are those of ``rows`` that ``schema`` doesn't name and that are no arrays. One bad row costs neither its task nor its subject.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    keys = [c for c, t in rows.dtypes if not t.startswith("array") and c not in names]
    kinds = dict(rows.dtypes)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    found, error = kernel(row), None
                except Exception as problem:  # whatever a kernel raises is reported, not raised
                    found, error = dict.fromkeys(names), str(problem)
                out.append({**{k: getattr(row, k) for k in keys}, **found, "error": error})
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names, "error"])

    return rows.mapInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + schema + ", error string")


def subject_status(results: DataFrame, cond: str = "cond", order: str = "trial") -> DataFrame:
    """Per subject: SUCCESS, SKIPPED without Incorrect trials, or FAILED with the first error; counts of sound trials by class (0 where it failed)."""
    sound = F.col("error").isNull()
    counts = results.groupBy("subj").agg(
        F.count_if(sound & F.col(cond).startswith("Correct")).alias("correct"), F.count_if(sound & F.col(cond).startswith("Incorrect")).alias("incorrect"),
        F.min(F.when(~sound, F.struct(order, "error"))).alias("first"),
    )
    failed = F.col("first").isNotNull()
    status = F.when(failed, F.concat(F.lit("FAILED: "), "first.error")).when(F.col("incorrect") > 0, "SUCCESS").otherwise("SKIPPED: no incorrect trials")
    return counts.select("subj", status.alias("status"), *[F.when(failed, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("correct", "incorrect")])
