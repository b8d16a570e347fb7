"""Fourier transforms of one long trace over many tasks.

A transform of n = a * b samples is a matrix of a rows and b columns: tasks transform blocks
of its columns, turn the results by the twiddle factors, exchange tiles, and transform blocks
of rows. No task holds more than a block of columns or rows, TILE numbers of all sets of weights
together or one line of each, and a trace of n samples needs lines of about sqrt(n).

Lengths without a divisor near their root go by convolution with a chirp, and any other
circular convolution (the quadrature signal) goes the same way: the product of two transforms
of a power of two, whose first inverse step needs no exchange, as rows of the one are columns
of the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TRACE

TILE = 1 << 18  # numbers of a block of lines; a task holds some 200 bytes for each
KEYS = "recording_id string, epoch int, ch int, label string"
# weights at samples t = 0, 1, …: (count of weights, number of samples), or a plain vector
Weights = Callable[[np.ndarray], np.ndarray]


def product_mod(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """a * b mod m of longs below 2^40, without overflow."""
    high, low = a >> 20, a & ((1 << 20) - 1)
    return ((high * b % m << 20) + low * b) % m


def turns(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i a b / n)."""
    return np.exp(-2j * np.pi / n * product_mod(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64), n))


def factors(n: int) -> tuple[int, int] | None:
    """a * b = n with a the largest divisor up to the root of n, or nothing if that is far from it."""
    a = next((a for a in range(math.isqrt(n), 0, -1) if n % a == 0), 1)
    return (a, n // a) if a * a * 16 >= n else None


def lines(length: int, tile: int, matrices: int = 1) -> int:
    """Lines of a block of so many matrices."""
    return max(1, tile // (length * matrices))


def sets_of(weights: Weights | None) -> int:
    return 1 if weights is None else len(np.atleast_2d(weights(np.zeros(1, dtype=np.int64))))


def tiles(t: pa.Table, columns: list[tuple[np.ndarray, ...]], first: int, n: int, per: int, block: int) -> pa.Table:
    """Transforms over columns, turned and cut into tiles of `per` rows; `columns` holds for each part one matrix (row, column) from column `first`."""
    rows, out = len(columns[0][0]), {"part": [], "row": [], "block": [], "data": []}
    for part, matrices in enumerate(columns):
        done = []
        for x in matrices:
            z = np.fft.fft(x, axis=0)
            z *= turns(np.arange(rows)[:, None], np.arange(first, first + z.shape[1])[None, :], n)
            done.append(z)
        for r in range(0, rows, per):
            out["part"].append(part)
            out["row"].append(r // per)
            out["block"].append(block)
            out["data"].append(np.stack([z[r : r + per] for z in done]).tobytes())
    return keyed(t, [pa.array(out["part"], pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["data"], pa.binary())], ["part", "row", "block", "data"])


def keyed(t: pa.Table, columns: list[pa.Array], names: list[str]) -> pa.Table:
    size = len(columns[0])
    same = [pa.array([t[c][0].as_py()] * size, t.schema.field(c).type) for c in TRACE]
    return pa.Table.from_arrays([*same, *columns], names=[*TRACE, *names])


TILES = f"{KEYS}, part int, row long, block long, data binary"


def joined(t: pa.Table, matrices: int, rows: int, cols: int) -> np.ndarray:
    """(matrix, row, column) of a block of rows from its tiles."""
    t = t.sort_by("block")
    return np.concatenate([np.frombuffer(d.as_buffer(), dtype=complex).reshape(matrices, rows, -1) for d in t["data"].combine_chunks()], axis=2) if cols else np.zeros((matrices, rows, 0))


def column_blocks(samples: DataFrame, b: int, per: int) -> DataFrame:
    column = (F.col("s") - 1) % b
    return samples.select(*TRACE, "s", "v", F.floor(column / per).alias("block"))


def matrix(t: pa.Table, a: int, b: int, first: int, width: int, weights: Weights | None) -> list[np.ndarray]:
    """The samples of a block of columns, for each set of weights."""
    at = t["s"].to_numpy() - 1
    x = t["v"].to_numpy()
    w = np.ones((1, len(at))) if weights is None else np.atleast_2d(weights(at))
    out = []
    for row in w:
        m = np.zeros((a, width), dtype=complex)
        m[at // b, at % b - first] = x * row
        out.append(m)
    return out


def spectrum(samples: DataFrame, n: int, low: int = 0, high: int | None = None, weights: Weights | None = None, tile: int | None = None) -> DataFrame:
    """(recording_id, epoch, ch, label, part, k, re, im) of whole traces of n samples, bins low to high (n // 2 by default).

    `weights` multiply the samples, one part of the result for each set of them.
    """
    high, tile = n // 2 if high is None else high, tile or TILE
    if n < 1 or low > high:
        raise ValueError("a spectrum needs samples and bins")
    ab = factors(n)
    if ab is None:
        out = chirp(samples, n, low, high, weights, tile)
    else:
        a, b = ab
        wide, tall = lines(a, tile, sets_of(weights)), lines(b, tile)

        def columns(t: pa.Table) -> pa.Table:
            block = t["block"][0].as_py()
            first = block * wide
            parts = matrix(t, a, b, first, min(wide, b - first), weights)
            return tiles(t, [(m,) for m in parts], first, n, tall, block)

        def rows(t: pa.Table) -> pa.Table:
            first = t["row"][0].as_py() * tall
            count = min(tall, a - first)
            z = np.fft.fft(joined(t, 1, count, b)[0], axis=1)
            k = np.add.outer(np.arange(first, first + count), a * np.arange(b))
            return chosen(t, k, z, low, high)

        dealt = column_blocks(samples, b, wide).groupBy(*TRACE, "block").applyInArrow(columns, TILES)
        out = dealt.groupBy(*TRACE, "part", "row").applyInArrow(rows, BINS)
    return out


BINS = f"{KEYS}, part int, k long, re double, im double"


def chosen(t: pa.Table, k: np.ndarray, z: np.ndarray, low: int, high: int) -> pa.Table:
    use = (k >= low) & (k <= high)
    part = pa.array(np.full(int(use.sum()), t["part"][0].as_py(), dtype=np.int32))
    return keyed(t, [part, pa.array(k[use]), pa.array(z.real[use]), pa.array(z.imag[use])], ["part", "k", "re", "im"])


def convolution(samples: DataFrame, n: int, kernel: Weights, finish: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, weights: Weights | None, tile: int) -> DataFrame:
    """finish(keys, t, y) of y[t] = sum over u of x[u] w[u] h[t - u], 0 <= t < n, h given for -n < t < n.

    Padded to a power of two; h is made in the tasks.
    """
    m = 1 << max(2, (2 * n - 2).bit_length())
    a = 1 << (m.bit_length() - 1) // 2
    b = m // a
    wide, tall, last = lines(a, tile, sets_of(weights) + 1), lines(b, tile, 2), lines(a, tile)

    def columns(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        first = block * wide
        width = min(wide, b - first)
        at = np.add.outer(b * np.arange(a), np.arange(first, first + width))
        at = np.where(at >= n, at - m, at)  # the second half of the circle is before zero
        near = at > -n
        h = np.zeros(at.shape, dtype=complex)
        h[near] = kernel(at[near])
        return tiles(t, [(x, h) for x in matrix(t, a, b, first, width, weights)], first, m, tall, block)

    def middle(t: pa.Table) -> pa.Table:
        row = t["row"][0].as_py()
        first, part = row * tall, t["part"][0].as_py()
        count = min(tall, a - first)
        z = np.fft.fft(joined(t, 2, count, b), axis=2)
        # the product's rows are columns of the inverse, taken as a transform of the conjugate
        back = tiles(t, [(np.conj(z[0] * z[1]).T,)], first, m, last, row)
        return back.set_column(back.schema.get_field_index("part"), "part", pa.array(np.full(back.num_rows, part, dtype=np.int32)))

    def final(t: pa.Table) -> pa.Table:
        first = t["row"][0].as_py() * last
        count = min(last, b - first)
        y = np.conj(np.fft.fft(joined(t, 1, count, a)[0], axis=1)) / m
        at = np.add.outer(np.arange(first, first + count), b * np.arange(a))
        use = at < n
        return finish(t, at[use], y[use])

    dealt = column_blocks(samples, b, wide).groupBy(*TRACE, "block").applyInArrow(columns, TILES)
    turned = dealt.groupBy(*TRACE, "part", "row").applyInArrow(middle, TILES)
    return turned.groupBy(*TRACE, "part", "row").applyInArrow(final, schema)


def chirp(samples: DataFrame, n: int, low: int, high: int, weights: Weights | None, tile: int) -> DataFrame:
    """A spectrum as a convolution: t k = (t^2 + k^2 - (k - t)^2) / 2."""

    def wave(t: np.ndarray) -> np.ndarray:
        return np.exp(-1j * np.pi / n * product_mod(t, t, 2 * n))

    def windowed(t: np.ndarray) -> np.ndarray:
        return wave(t) if weights is None else np.atleast_2d(weights(t)) * wave(t)

    def finish(t: pa.Table, k: np.ndarray, y: np.ndarray) -> pa.Table:
        use = (k >= low) & (k <= high)
        return chosen(t, k[use], y[use] * wave(k[use]), low, high)

    return convolution(samples, n, lambda t: np.conj(wave(np.abs(t))), finish, BINS, windowed, tile)


def analytic(samples: DataFrame, n: int, tile: int | None = None) -> DataFrame:
    """(recording_id, epoch, ch, label, s, re, im): the analytic signal of whole traces of n samples."""
    top = (n - 1) // 2  # the frequencies between zero and half the rate

    def kernel(t: np.ndarray) -> np.ndarray:
        """One at zero, and i times the sum of 2 / n sin(2 pi k t / n) over those frequencies."""
        t = t % n
        angle = lambda j: np.pi / n * product_mod(t, np.full_like(t, j), 2 * n)
        rest = np.where(t == 0, 0.0, 2 / n * np.sin(angle(top)) * np.sin(angle(top + 1)) / np.sin(np.pi / n * np.where(t == 0, 1, t)))
        return np.where(t == 0, 1.0, 0.0) + 1j * rest

    def finish(t: pa.Table, at: np.ndarray, y: np.ndarray) -> pa.Table:
        return keyed(t, [pa.array(at + 1), pa.array(y.real.copy()), pa.array(y.imag.copy())], ["s", "re", "im"])

    return convolution(samples, n, kernel, finish, f"{KEYS}, s long, re double, im double", None, tile or TILE)
