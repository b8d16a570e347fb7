"""Operators on blocks of a trace equal those on the whole trace, whatever the size of a block."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import columns, kernels
from oscilla.operators import clinical, connectivity, filtering, timefreq, transform
from oscilla.plans import queries
from test_oracles import cell
from test_signals import dense, samples

DATA = Path("/root/testdata/sf0.01")

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("block", [1 << 16, 100, 37])
def test_recursive_filter(spark, block):
    n = 901
    x = np.cumsum(RNG.normal(size=(n, 2)), axis=0)
    for low, high in ((4, 20), (1, None), (None, 30)):
        sections = kernels.butterworth(4, 128, low, high)
        got = dense(filtering.zero_phase(samples(spark, x), sections, n, block), n, 2)
        for c in range(2):
            assert np.allclose(got[:, c], kernels.forward_backward(x[:, c], sections), atol=1e-8)


def test_recursive_filter_by_the_definition(spark):
    n = 300
    x = RNG.normal(size=(n, 1)) + 5
    sections = kernels.butterworth(2, 128, 2, 30)
    got = dense(filtering.recursive(samples(spark, x), sections, n, 64), n, 1)[:, 0]
    y = np.concatenate([np.full(4000, x[0, 0]), x[:, 0]])  # the first sample has always come in
    for b0, b1, b2, _, a1, a2 in sections:
        out = np.zeros(len(y))
        for t in range(len(y)):
            out[t] = b0 * y[t] + (b1 * y[t - 1] - a1 * out[t - 1] if t > 0 else 0) + (b2 * y[t - 2] - a2 * out[t - 2] if t > 1 else 0)
        y = out
    assert np.allclose(got, y[4000:], atol=1e-8)


def test_short_traces_are_filtered(spark):
    for n in (1, 2, 5):
        x = RNG.normal(size=(n, 1))
        sections = kernels.butterworth(4, 128, 4, 20)
        assert np.allclose(dense(filtering.zero_phase(samples(spark, x), sections, n, 3), n, 1)[:, 0], kernels.forward_backward(x[:, 0], sections))


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_wavelets(spark, block):
    n, freqs = 777, [4.0, 9.5, 30.0]
    x = RNG.normal(size=(n, 2))
    got = timefreq.coefficients(samples(spark, x), 128, freqs, 5, block=block).toPandas()
    for c in range(2):
        want = kernels.morlet(x[:, c], 128, freqs, 5)
        for f, w in zip(freqs, want):
            g = got[(got.ch == c + 1) & (got.freq == f)].sort_values("s")
            assert np.allclose(g.re + 1j * g.im, w)


def test_template_spikes(spark):
    n, sr = 900, 256
    x = RNG.normal(size=(n, 2))
    shape = clinical.spike_template(sr, 70)
    for at in (100, 249, 251, 600, n - len(shape)):
        x[at : at + len(shape), 0] += 400 * shape
    found = [sorted(map(tuple, clinical._template_spikes(samples(spark, x), sr, 70, 50, b).collect())) for b in (1 << 16, 250, 11)]
    assert found[0] and all(len(f) == len(found[0]) and all(np.allclose(a[1:], b[1:]) for a, b in zip(f, found[0])) for f in found[1:])


@pytest.fixture
def small_blocks(monkeypatch):
    for module, name, size in ((columns, "BLOCK", 150), (filtering, "BLOCK", 130), (timefreq, "BLOCK", 700), (transform, "TILE", 512), (connectivity, "LAGS_BLOCK", 100)):
        monkeypatch.setattr(module, name, size)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


SPREAD = [
    "band_power", "slowing_peak", "asymmetry", "plv", "coherence", "wpli", "morlet", "spikes_template", "spikes_morphology", "iir_bandpass",
    "gfp_peaks", "suppression", "spindles", "slow_waves", "k_complexes", "microstate_stats", "microstate_transitions",
]


@pytest.mark.parametrize("name", SPREAD)
def test_oracles_over_many_blocks(spark, db, small_blocks, name):
    """A channel of 2,000 samples in some 14 blocks gives what the SQL gives."""
    got = queries.QUERIES[name](spark, str(DATA))
    cur = db.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in cur.description)
    place = {c[0]: i for i, c in enumerate(cur.description)}
    want = sorted(([cell(row[place[c]]) for c in names] for row in cur.fetchall()), key=str)
    assert sorted(([cell(row[c]) for c in names] for row in got.collect()), key=str) == want


def spans(rows):
    out = []
    for s, v in rows:
        if out and out[-1][0] == v and out[-1][2] == s - 1:
            out[-1][2], out[-1][3] = s, out[-1][3] + 1
        else:
            out.append([v, s, s, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 16])
def test_runs(spark, size):
    """Long runs over many blocks, gaps, nulls, single rows."""
    values = [1] * 25 + [2, 1, None, None, 2, 2] + [3] * 12 + [1, 2] * 6
    rows = [(s, v) for s, v in enumerate(values, 1) if s not in (7, 8, 40)]
    df = spark.createDataFrame([("r", s, v) for s, v in rows] + [("q", 5, 1)], "recording_id string, s long, v int").withColumn("n", F.lit(1))
    got = columns.runs(df, ["recording_id"], F.col("v"), {"n": F.sum("n")}, size).collect()
    assert sorted([(r.value, r.start, r.stop, r.n) for r in got if r.recording_id == "r"], key=str) == spans(rows)
    assert [tuple(r)[1:] for r in got if r.recording_id == "q"] == [(1, 5, 5, 1)]
    assert columns.runs(df.limit(0), ["recording_id"], F.col("v")).count() == 0


@pytest.mark.parametrize("size", [1, 4, 1 << 16])
def test_neighbours(spark, size):
    places = [1, 2, 3, 9, 10, 40, 41, 42, 43, 44, 45]
    df = spark.createDataFrame([("r", s, float(s) / 2) for s in places] + [("q", 3, 1.0)], "recording_id string, s long, v double")
    got = {(r.recording_id, r.s): (r.prev and tuple(r.prev), r.next and tuple(r.next)) for r in columns.neighbours(df, ["recording_id"], ["v"], size=size).collect()}
    for i, s in enumerate(places):
        before, after = places[i - 1] if i else None, places[i + 1] if i + 1 < len(places) else None
        assert got["r", s] == (before and (before, before / 2), after and (after, after / 2))
    assert got["q", 3] == (None, None)


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_sessions(spark, size):
    places = [1, 2, 6, 7, 13, 14, 15, 30, 33, 36, 39, 42, 60]
    df = spark.createDataFrame([("r", s, s, True) for s in places], "recording_id string, start long, stop long, value boolean")
    got = sorted((r.start, r.stop) for r in columns.merge_runs(df, ["recording_id"], {}, 4, size).collect())
    assert got == [(1, 7), (13, 15), (30, 42), (60, 60)]
