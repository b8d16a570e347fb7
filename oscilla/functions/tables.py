"""Operators as table functions of SQL.

`register(spark)` adds them to a session. A table argument is partitioned by trace and block,
so that a long channel is many tasks; `eeg_blocks` and `eeg_windows` give the blocks a sample
belongs to, halo included:

    SELECT * FROM eeg_fir(
      TABLE(SELECT *, explode(blocks) AS block FROM (SELECT *, eeg_blocks(s, n, 30, 30, 65536) AS blocks FROM …))
      PARTITION BY (recording_id, epoch, ch, label, block) ORDER BY (s),
      'bandpass', 128.0, 8.0, 13.0, 61, 65536)

Tables have the columns of samples (recording_id, epoch, s, ch, label, v), n (samples of a
trace) and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .columns import SAMPLES
from .kernels import convolve_valid, fir_taps

KEYS = ["recording_id", "epoch", "ch", "label"]
KEY_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string()]


class Blocks:
    """Holds the batches of a partition, which is one block, and hands them on as one table at its end."""

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.options: tuple = ()

    def eval(self, rows: pa.RecordBatch, *options: pa.Array) -> None:
        if rows.num_rows:
            self.batches.append(rows)
            self.options = self.options or tuple(o[0].as_py() for o in options)

    def terminate(self) -> Iterator[pa.Table]:
        if self.batches:
            yield self.run(pa.Table.from_batches(self.batches), *self.options)


def keyed(t: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    size = len(next(iter(columns.values())))
    same = [pa.array([t[k][0].as_py()] * size, kind) for k, kind in zip(KEYS, KEY_TYPES)]
    return pa.table([*same, *columns.values()], names=[*KEYS, *columns])


class Fir(Blocks):
    """(kind, sr, low, high, taps, size): centred filter of blocks of `size` samples, ends of the trace held."""

    def run(self, t: pa.Table, kind: str, sr: float, low: float | None, high: float | None, taps: int, size: int) -> pa.Table:
        h = fir_taps(kind, float(sr), low and float(low), high and float(high), taps)
        half, s, n = (taps - 1) // 2, t["s"].to_numpy(), t["n"][0].as_py()
        first = t["block"][0].as_py() * size + 1
        last = min(n, first + size - 1)
        x = np.pad(t["v"].to_numpy(), (max(0, half - (first - int(s[0]))), max(0, half - (int(s[-1]) - last))), mode="edge")
        out = keyed(t, {"s": pa.array(np.arange(first, last + 1)), "v": pa.array(convolve_valid(x, h))})
        return out.select([c.split()[0] for c in SAMPLES.split(", ")])


class Spectra(Blocks):
    """(window, hop, per, sr, weights): transforms of windows of `window` samples every `hop`, `per` windows a block."""

    def run(self, t: pa.Table, window: int, hop: int, per: int, sr: float, weights: str) -> pa.Table:
        from ..operators.timefreq import window_weights

        first, n = t["block"][0].as_py() * per, t["n"][0].as_py()
        count = min(per, (n - window) // hop + 1 - first)
        x = t["v"].to_numpy()[first * hop + 1 - t["s"][0].as_py() :]
        view = np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:count]
        z = np.fft.rfft(view * window_weights(weights, window), axis=1)
        k = np.tile(np.arange(z.shape[1]), count)
        win = np.repeat(np.arange(first, first + count, dtype=np.int32), z.shape[1])
        return keyed(t, {"win": pa.array(win), "k": pa.array(k), "freq": pa.array(k * float(sr) / window), "re": pa.array(z.real.ravel()), "im": pa.array(z.imag.ravel())})


class Runs(Blocks):
    """Runs of consecutive s with one value of `value` within a block of a recording."""

    def run(self, t: pa.Table) -> pa.Table:
        s, value = t["s"].to_numpy(), t["value"].to_numpy()
        cut = np.flatnonzero((np.diff(s) != 1) | (value[1:] != value[:-1])) + 1
        low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]])
        name = pa.array([t["recording_id"][0].as_py()] * len(low), pa.string())
        return pa.table([name, pa.array(value[low]), pa.array(s[low]), pa.array(s[high - 1])], names=["recording_id", "value", "start", "stop"])


def register(spark: SparkSession) -> None:
    """Add eeg_fir, eeg_spectra, eeg_runs and the block functions to the session."""
    keys = "recording_id string, epoch int, ch int, label string"
    spark.udtf.register("eeg_fir", F.arrow_udtf(Fir, returnType=SAMPLES))
    spark.udtf.register("eeg_spectra", F.arrow_udtf(Spectra, returnType=f"{keys}, win int, k long, freq double, re double, im double"))
    spark.udtf.register("eeg_runs", F.arrow_udtf(Runs, returnType="recording_id string, value boolean, start long, stop long"))
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION eeg_blocks(s BIGINT, n BIGINT, before BIGINT, after BIGINT, size BIGINT) RETURNS ARRAY<BIGINT>
        RETURN sequence(greatest(CAST(floor((s - 1 - after) / size) AS BIGINT), 0L), least(CAST(floor((s - 1 + before) / size) AS BIGINT), CAST(floor((n - 1) / size) AS BIGINT)))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION eeg_windows(s BIGINT, n BIGINT, width BIGINT, hop BIGINT, per BIGINT) RETURNS ARRAY<BIGINT>
        RETURN CASE WHEN greatest(0, ceil((s - width) / hop)) <= least(floor((n - width) / hop), floor((s - 1) / hop))
        THEN sequence(CAST(floor(greatest(0, ceil((s - width) / hop)) / per) AS BIGINT), CAST(floor(least(floor((n - width) / hop), floor((s - 1) / hop)) / per) AS BIGINT))
        ELSE CAST(array() AS ARRAY<BIGINT>) END""")
