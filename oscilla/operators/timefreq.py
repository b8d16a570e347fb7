"""Spectra over time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, TRACE, length_of
from ..functions.kernels import correlate_valid, dpss_at, morlet, morlet_kernel
from .filtering import in_blocks, per_trace
from .transform import spectrum

COEFFICIENTS = "recording_id string, epoch int, ch int, label string, s long, freq double, re double, im double"


BLOCK = 1 << 16  # samples whose windows are transformed together


def window_weights(kind: str, n: int) -> np.ndarray:
    x = np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.zeros(n)
    if kind not in ("hanning", "hamming", "rectangular"):
        raise ValueError(f"unknown window {kind!r}")
    return {"hanning": 0.5 - 0.5 * x, "hamming": 0.54 - 0.46 * x, "rectangular": np.ones(n)}[kind]


def window_energy(kind: str, n: int) -> float:
    return float((window_weights(kind, n) ** 2).sum())


def window_spectra(samples: DataFrame, sr: float, n: int, hop: int, window: str = "hanning", band: tuple[float, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(recording_id, epoch, ch, label, win, k, freq, re, im): transforms of windows of n samples every hop, win from 0.

    Windows must fit into the trace. A trace is dealt in blocks of windows with a halo, so
    a long channel is many tasks, and each block is one FFT of its windows; bins outside
    the band never leave the kernel.
    """
    total = length_of(samples)
    last = (total - n) // hop
    if n < 1 or last < 0:
        raise ValueError(f"signal of {total} samples is shorter than a window of {n}")
    weights, k = window_weights(window, n), np.arange(n // 2 + 1)
    freq = k * sr / n
    if band is not None:
        k = k[(freq >= band[0]) & (freq <= band[1])]
    freq = k * sr / n
    per = max(1, block // hop)  # windows of a block
    low = F.greatest(F.lit(0), F.ceil((F.col("s") - n) / F.lit(hop)))
    high = F.least(F.lit(last), F.floor((F.col("s") - 1) / F.lit(hop)))
    dealt = samples.select(*TRACE, "s", "v", low.alias("_low"), high.alias("_high")).where("_low <= _high")
    dealt = dealt.select(*TRACE, "s", "v", F.explode(F.sequence(F.floor(F.col("_low") / per), F.floor(F.col("_high") / per))).alias("block"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("s")
        first = t["block"][0].as_py() * per
        count = min(per, last + 1 - first)
        skip = first * hop + 1 - t["s"][0].as_py()
        x = t["v"].to_numpy()[skip:]
        if len(x) < (count - 1) * hop + n:
            raise ValueError("a trace lacks samples that others have")
        view = np.lib.stride_tricks.sliding_window_view(x, n)[::hop][:count]
        z = np.fft.rfft(view * weights, axis=1)[:, k].ravel()
        size = len(z)
        same = [pa.array([t[c][0].as_py()] * size, t.schema.field(c).type) for c in TRACE]
        win = np.repeat(np.arange(first, first + count, dtype=np.int32), len(k))
        cols = [win, np.tile(k, count), np.tile(freq, count), z.real.copy(), z.imag.copy()]
        return pa.Table.from_arrays([*same, *map(pa.array, cols)], names=[*TRACE, "win", "k", "freq", "re", "im"])

    return dealt.groupBy(*TRACE, "block").applyInArrow(run, "recording_id string, epoch int, ch int, label string, win int, k long, freq double, re double, im double")


def coefficients(samples: DataFrame, sr: float, frequencies: list[float], n_cycles: float = 7, align: str = "centered", block: int | None = None) -> DataFrame:
    """(recording_id, epoch, ch, label, s, freq, re, im) of unit-energy wavelets.

    A wavelet ends three deviations from its middle, so blocks of a trace with a halo of the
    longest wavelet suffice. align "reference" wraps around the padded trace, and takes a trace
    as one group.
    """
    if n_cycles <= 0 or any(f <= 0 for f in frequencies):
        raise ValueError("frequencies and n_cycles must be positive")
    freqs = [float(f) for f in frequencies]
    if align == "reference":

        def whole(p: pd.DataFrame) -> pd.DataFrame:
            c = morlet(p.v.to_numpy(), sr, freqs, n_cycles, align)
            rows = {k: p[k].iloc[0] for k in TRACE}
            return pd.DataFrame({**rows, "s": np.tile(p.s.to_numpy(), len(freqs)), "freq": np.repeat(freqs, len(p)), "re": c.real.ravel(), "im": c.imag.ravel()})[[x.split()[0] for x in COEFFICIENTS.split(", ")]]

        return per_trace(samples, whole, COEFFICIENTS)
    wavelets = [morlet_kernel(sr, f, n_cycles) for f in freqs]
    halo = max(len(w) // 2 for w in wavelets)

    def products(x: np.ndarray) -> list[np.ndarray]:
        parts = []
        for w in wavelets:
            cut = halo - len(w) // 2
            z = correlate_valid(x[cut : len(x) - cut], w)
            parts += [z.real, z.imag]
        return parts

    names = [f"{part}{i}" for i in range(len(freqs)) for part in ("re", "im")]
    wide = in_blocks(samples, length_of(samples), halo, halo, products, names, block)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), F.col(f"re{i}").alias("re"), F.col(f"im{i}").alias("im")) for i, f in enumerate(freqs)])).alias("c")
    return wide.select(*TRACE, "s", cells).select(*TRACE, "s", "c.freq", "c.re", "c.im")


def wavelet(samples: DataFrame, sr: float, frequencies: list[float], n_cycles: float = 7, align: str = "centered") -> DataFrame:
    """(…, s, freq, power, phase)."""
    c = coefficients(samples, sr, frequencies, n_cycles, align)
    return c.select(*TRACE, "s", "freq", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"), F.atan2("im", "re").alias("phase"))


def _epochs_only(samples: DataFrame) -> None:
    if not samples.where("epoch is null").isEmpty():
        raise ValueError("a continuous recording has no epochs")


def ersp(samples: DataFrame, sr: float, frequencies: list[float], n_cycles: float = 7, baseline: tuple[int, int] = (1, 50), align: str = "centered") -> DataFrame:
    """Power averaged over epochs against its baseline (in samples, held above 0), in dB; no power is -inf.

    Samples must be cut into epochs.
    """
    _epochs_only(samples)
    p = wavelet(samples, sr, frequencies, n_cycles, align).groupBy("recording_id", "ch", "label", "freq", "s").agg(F.avg("power").alias("p"))
    base = F.avg(F.when(F.col("s").between(*baseline), F.col("p"))).over(Window.partitionBy("recording_id", "ch", "label", "freq"))
    ratio = F.col("p") / F.greatest(base, F.lit(EPS))
    return p.select("recording_id", "s", "freq", "ch", "label", F.when(ratio > 0, 10 * F.log10(ratio)).otherwise(float("-inf")).alias("ersp_db"))


def itc(samples: DataFrame, sr: float, frequencies: list[float], n_cycles: float = 7, align: str = "centered") -> DataFrame:
    """Length of the mean unit coefficient over epochs, into which samples must be cut."""
    _epochs_only(samples)
    c = coefficients(samples, sr, frequencies, n_cycles, align)
    mag = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    mag = F.when(mag < EPS, 1.0).otherwise(mag)
    c = c.groupBy("recording_id", "ch", "label", "freq", "s").agg(F.avg(F.col("re") / mag).alias("x"), F.avg(F.col("im") / mag).alias("y"))
    return c.select("recording_id", "s", "freq", "ch", "label", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("itc"))


def stft(samples: DataFrame, sr: float, window_sec: float = 0.5, overlap: float = 0.75, window_type: str = "hanning") -> DataFrame:
    """(…, time_bin, time_sec, freq, power)."""
    if window_sec <= 0 or not 0 <= overlap < 1:
        raise ValueError("window_sec must be positive and overlap in [0, 1)")
    n = round(window_sec * sr)
    n += n % 2
    hop = max(1, round(n * (1 - overlap)))
    spec = window_spectra(samples, sr, n, hop, window_type)
    time = (F.col("win") * hop + n / 2) / sr
    return spec.select(*TRACE, (F.col("win") + 1).alias("time_bin"), time.alias("time_sec"), "freq", ((F.col("re") ** 2 + F.col("im") ** 2) / window_energy(window_type, n)).alias("power"))


def multitaper(samples: DataFrame, sr: float, bandwidth: float = 4, n_tapers: int | None = None) -> DataFrame:
    """(…, freq, psd): mean over Slepian tapers of transforms of whole traces; tasks evaluate the tapers at their samples."""
    n = length_of(samples)
    k = n_tapers or math.floor(2 * bandwidth) - 1
    spec = spectrum(samples, n, weights=dpss_at(n, bandwidth, k))
    psd = spec.groupBy(*TRACE, "k").agg((F.avg(F.col("re") ** 2 + F.col("im") ** 2) / sr).alias("psd"))
    return psd.select(*TRACE, (F.col("k") * sr / n).alias("freq"), "psd")
