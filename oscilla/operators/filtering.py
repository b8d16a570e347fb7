"""Filters along time.

FIR filters run on blocks of a trace with a halo of half the taps on both sides, so one
long channel is many tasks; only the true ends of a trace are held. The recursive filter
is an affine map of the state over each block: blocks give what they push into the state
from rest, a scan over blocks gives each its start, and a second pass fills in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SAMPLES, TRACE, length_of
from ..functions.kernels import butterworth, cascade, cascade_decay, convolve_valid, fir, fir_length, fir_taps, steady_state

BLOCK = 1 << 16


def per_trace(samples: DataFrame, kernel, schema: str = SAMPLES) -> DataFrame:
    """kernel(trace ordered by s) -> frame, for each recording, epoch and channel."""
    return samples.select(*SAMPLES_COLUMNS).groupBy(*TRACE).applyInPandas(lambda p: kernel(p.sort_values("s")), schema)


SAMPLES_COLUMNS = [c.split()[0] for c in SAMPLES.split(", ")]


def convolve(samples: DataFrame, taps: np.ndarray, n: int, block: int = BLOCK) -> DataFrame:
    """Centred convolution of every trace of n samples, ends held, in blocks with a halo."""
    half = (len(taps) - 1) // 2
    first, last = F.floor((F.col("s") - 1 - half) / block), F.floor((F.col("s") - 1 + half) / block)
    top = (n - 1) // block
    spread = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(top)))
    dealt = samples.select(*SAMPLES_COLUMNS, F.explode(spread).alias("block"))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("s")
        low, high = key[-1] * block + 1, min(n, (key[-1] + 1) * block)
        s = p.s.to_numpy()
        x = np.pad(p.v.to_numpy(), (max(0, half - (low - s[0])), max(0, half - (s[-1] - high))), mode="edge")
        inside = p[(s >= low) & (s <= high)].copy()
        inside["v"] = convolve_valid(x, taps)
        return inside[SAMPLES_COLUMNS]

    return dealt.groupBy(*TRACE, "block").applyInPandas(run, SAMPLES)


def in_blocks(samples: DataFrame, n: int, before: int, after: int, kernel: Callable[[np.ndarray], list[np.ndarray]], names: list[str], block: int | None = None) -> DataFrame:
    """(recording_id, epoch, ch, label, s, <names>…) of every trace of n samples, in blocks with a halo.

    The kernel maps the samples of a block, with `before` and `after` samples around it that are
    0 beyond the trace's ends, to one array for each name, a value for each sample of the block.
    """
    size = block or BLOCK
    first, last = F.floor((F.col("s") - 1 - after) / size), F.floor((F.col("s") - 1 + before) / size)
    spread = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((n - 1) // size)))
    dealt = samples.select(*TRACE, "s", "v", F.explode(spread).alias("block"))

    def run(t: pa.Table) -> pa.Table:
        low = t["block"][0].as_py() * size
        high = min(n, low + size)
        x = np.zeros(before + high - low + after)
        at = t["s"].to_numpy() - 1 - low + before
        x[at] = t["v"].to_numpy()
        out = [pa.array(np.ascontiguousarray(y)) for y in kernel(x)]
        same = [pa.array([t[c][0].as_py()] * (high - low), t.schema.field(c).type) for c in TRACE]
        return pa.Table.from_arrays([*same, pa.array(np.arange(low + 1, high + 1)), *out], names=[*TRACE, "s", *names])

    schema = "recording_id string, epoch int, ch int, label string, s long, " + ", ".join(f"{x} double" for x in names)
    return dealt.groupBy(*TRACE, "block").applyInArrow(run, schema)


def fir_filter(samples: DataFrame, kind: str, sr: float, low: float | None = None, high: float | None = None, order: int | None = None, block: int = BLOCK) -> DataFrame:
    """bandpass, lowpass (high), highpass (low) or notch (low to high) of every channel."""
    if kind == "notch" and (low <= 0 or high >= sr / 2):
        return samples
    n = length_of(samples)
    taps = fir_length(sr, high if kind == "lowpass" else low, n, order)
    return samples.select(*SAMPLES_COLUMNS) if taps < 3 else convolve(samples, fir_taps(kind, sr, low, high, taps), n, block)


def recursive(samples: DataFrame, sections: np.ndarray, n: int, block: int | None = None) -> DataFrame:
    """Second-order sections over every trace of n samples, started in the steady state of its first sample."""
    size = block or BLOCK
    decay, settled = cascade_decay(sections, size), steady_state(sections)
    dealt = samples.select(*SAMPLES_COLUMNS, F.floor((F.col("s") - 1) / size).alias("block")).repartition(*TRACE, "block")

    def push(t: pa.Table) -> pa.Table:
        t = t.sort_by("s")
        x = t["v"].to_numpy()
        _, state = cascade(x, sections, np.zeros(len(settled)))
        one = pa.array([[float(x[0]), *state.tolist()]], pa.list_(pa.float64()))
        return pa.Table.from_arrays([*(t[c].slice(0, 1) for c in TRACE), t["block"].slice(0, 1), one], names=[*TRACE, "block", "pushed"])

    def scan(t: pa.Table) -> pa.Table:
        """One row of a few numbers for each block."""
        t = t.sort_by("block")
        rows = np.array(t["pushed"].to_pylist())
        starts, state = [], settled * rows[0, 0]
        for pushed in rows[:, 1:]:
            starts.append(state.tolist())
            state = decay @ state + pushed
        return pa.Table.from_arrays([*(t[c] for c in TRACE), t["block"], pa.array(starts, pa.list_(pa.float64()))], names=[*TRACE, "block", "start"])

    def fill(t: pa.Table, starts: pa.Table) -> pa.Table:
        t = t.sort_by("s")
        y, _ = cascade(t["v"].to_numpy(), sections, np.array(starts["start"][0].as_py()))
        return t.set_column(t.schema.get_field_index("v"), "v", pa.array(y)).select(SAMPLES_COLUMNS)

    keys = "recording_id string, epoch int, ch int, label string, block long"
    pushed = dealt.groupBy(*TRACE, "block").applyInArrow(push, f"{keys}, pushed array<double>")
    starts = pushed.groupBy(*TRACE).applyInArrow(scan, f"{keys}, start array<double>")
    return dealt.groupBy(*TRACE, "block").cogroup(starts.groupBy(*TRACE, "block")).applyInArrow(fill, SAMPLES)


def zero_phase(samples: DataFrame, sections: np.ndarray, n: int, block: int | None = None) -> DataFrame:
    """Both directions, with odd extensions at the ends, of traces of n samples."""
    pad = min(3 * (2 * len(sections) + 1), n - 1)
    x = samples.select(*SAMPLES_COLUMNS)
    ends = x.groupBy(*TRACE).agg(F.max(F.when(F.col("s") == 1, F.col("v"))).alias("first"), F.max(F.when(F.col("s") == n, F.col("v"))).alias("last"))
    same = F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in TRACE))
    near = x.where((F.col("s") <= pad + 1) | (F.col("s") >= n - pad)).alias("a").join(ends.alias("b"), same)
    near = near.select(*(F.col(f"a.{c}").alias(c) for c in SAMPLES_COLUMNS), "first", "last")
    place, turned = F.col("s") + pad, lambda of: (2 * F.col(of) - F.col("v")).alias("v")
    other = [c for c in SAMPLES_COLUMNS if c not in ("s", "v")]
    order = lambda df: df.select(*SAMPLES_COLUMNS)
    left = order(near.where(F.col("s").between(2, pad + 1)).select(*other, (pad + 2 - F.col("s")).alias("s"), turned("first")))
    right = order(near.where(F.col("s").between(n - pad, n - 1)).select(*other, (2 * n + pad - F.col("s")).alias("s"), turned("last")))
    long = order(x.withColumn("s", place)).unionByName(left).unionByName(right)
    total = n + 2 * pad
    back = lambda df: df.withColumn("s", total + 1 - F.col("s"))
    y = back(recursive(back(recursive(long, sections, total, block)), sections, total, block))
    return y.where(F.col("s").between(pad + 1, pad + n)).withColumn("s", F.col("s") - pad)


def eeg_filter(samples: DataFrame, sr: float, lowcut: float | None = None, highcut: float | None = None, notch: float | None = None, method: str = "fir", order: int | None = None) -> DataFrame:
    """Main filter, then an FIR notch of 4 Hz width."""
    nyquist = sr / 2
    if lowcut is None and highcut is None and notch is None:
        raise ValueError("at least one of lowcut, highcut and notch is needed")
    for f in (lowcut, highcut):
        if f is not None and not 0 < f < nyquist:
            raise ValueError("cut-offs must lie between 0 and the Nyquist frequency")
    if lowcut is not None and highcut is not None and lowcut >= highcut:
        raise ValueError("lowcut must be below highcut")
    if notch is not None and not 2 < notch < nyquist - 2:
        raise ValueError("notch must lie 2 Hz within the band")
    n = length_of(samples, False)
    kind = "bandpass" if lowcut and highcut else "highpass" if lowcut else "lowpass" if highcut else None
    out = samples
    if kind and method == "iir":
        out = zero_phase(out, butterworth(order or 4, sr, lowcut, highcut), n)
    elif kind:
        out = fir_filter(out, kind, sr, lowcut, highcut, order)
    return fir_filter(out, "notch", sr, notch - 2, notch + 2, order) if notch else out


def band(p: pd.DataFrame, sr: float, low: float, high: float) -> np.ndarray:
    return fir(p.v.to_numpy(), "bandpass", sr, low, high)
