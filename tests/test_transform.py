"""Transforms of long traces over several tasks against transforms of whole arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oscilla.functions import kernels
from oscilla.operators import transform
from test_signals import samples

RNG = np.random.default_rng(5)


def bins(df, c):
    rows = df.toPandas().sort_values(["ch", "part", "k"])
    return {(ch, part): (g.re + 1j * g.im).to_numpy() for (ch, part), g in rows.groupby(["ch", "part"])}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 64, 97, 240, 241, 1021])
@pytest.mark.parametrize("tile", [1, 32, 1 << 20])
def test_spectrum(spark, n, tile):
    if n > 300 and tile == 1:
        tile = 100
    x = RNG.normal(size=(n, 2))
    got = bins(transform.spectrum(samples(spark, x), n, tile=tile), 2)
    for c in range(2):
        assert np.allclose(got[c + 1, 0], np.fft.rfft(x[:, c]), atol=1e-9)


def test_factors():
    assert transform.factors(240) == (15, 16) and transform.factors(241) is None and transform.factors(2 * 97) is None and transform.factors(1 << 21) == (1 << 10, 1 << 11)


def test_products_of_large_numbers():
    a = RNG.integers(0, 1 << 39, 50)
    assert transform.product_mod(a, a, (1 << 39) + 7).tolist() == [int(x) * int(x) % ((1 << 39) + 7) for x in a]


@pytest.mark.parametrize("n", [120, 127])
def test_bins_and_weights(spark, n):
    x, w = RNG.normal(size=(n, 1)), RNG.normal(size=(3, n))
    got = bins(transform.spectrum(samples(spark, x), n, 5, 17, lambda t: w[:, t], tile=16), 1)
    for j in range(3):
        assert np.allclose(got[1, j], np.fft.rfft(w[j] * x[:, 0])[5:18])


@pytest.mark.parametrize("n", [1, 2, 9, 64, 127, 500])
def test_analytic_signal(spark, n):
    x = RNG.normal(size=(n, 2))
    got = transform.analytic(samples(spark, x), n, tile=64).toPandas()
    for c in range(2):
        gain = np.zeros(n)
        gain[0], gain[1 : (n + 1) // 2] = 1, 2
        gain[n // 2] = 1 if n % 2 == 0 else gain[n // 2]
        g = got[got.ch == c + 1].sort_values("s")
        assert np.allclose(g.re + 1j * g.im, np.fft.ifft(np.fft.fft(x[:, c]) * gain))


@pytest.mark.parametrize("n,nw,k", [(300, 4, 7), (1500, 4, 7), (1500, 2.5, 4), (4000, 12, 20)])
def test_tapers_by_place(n, nw, k):
    """Tapers evaluated at places equal the eigenvectors of the whole matrix."""
    i = np.arange(n)
    off = i[1:] * (n - i[1:]) / 2
    _, vectors = np.linalg.eigh(np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(off, 1) + np.diag(off, -1))
    want = vectors[:, ::-1][:, :k].T
    want = np.where(want[:, :1] < 0, -want, want)
    tapers = kernels.dpss_at(n, nw, k)
    assert np.allclose(tapers(i), want, atol=1e-8) and np.allclose(tapers(i[5:9]), want[:, 5:9], atol=1e-8)


def test_tapers_of_a_night():
    n = 7_372_800
    tapers = kernels.dpss_at(n, 4, 7)
    at = np.arange(0, n, 64)
    w = tapers(at)
    assert np.allclose(w @ w.T * 64, np.eye(7), atol=1e-3)
    turn = np.where(np.arange(7) % 2, -1, 1)[:, None]
    assert np.allclose(tapers(n - 1 - at[:100]), turn * w[:, :100], atol=1e-12)


def test_many_tasks_and_epochs(spark):
    n = 960
    x = RNG.normal(size=(2, n, 1))
    df = samples(spark, x, epoch=True)
    a, b = transform.factors(n)
    assert df.select(F.floor(((F.col("s") - 1) % b) / transform.lines(a, 128))).distinct().count() >= 8
    rows = transform.spectrum(df, n, tile=128).toPandas().sort_values("k")
    for e in range(2):
        g = rows[rows.epoch == e + 1]
        assert np.allclose(g.re + 1j * g.im, np.fft.rfft(x[e, :, 0]))


@pytest.mark.parametrize("n", [960, 997])
def test_blocks_hold_all_sets_of_weights(spark, n):
    """A task's numbers are bounded over all sets of weights together, also where a chirp comes beside them."""
    x, w = RNG.normal(size=(n, 1)), RNG.normal(size=(4, n))

    def weights(t):
        if 4 * len(t) > 256:
            raise MemoryError("a block is too large")
        return w[:, t]

    got = bins(transform.spectrum(samples(spark, x), n, weights=weights, tile=256), 1)
    for j in range(4):
        assert np.allclose(got[1, j], np.fft.rfft(w[j] * x[:, 0]))


def test_memory_of_a_block():
    """Blocks of the default size stay small, so that many tasks fit an executor."""
    size = 1 << 10
    m = np.ones((size, transform.lines(size, transform.TILE)), dtype=complex)
    keys = pa.table({"recording_id": ["r1"], "epoch": pa.array([None], pa.int32()), "ch": pa.array([1], pa.int32()), "label": ["Cz"]})
    tracemalloc.start()
    transform.tiles(keys, [(m,)], 0, size * size, size, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
