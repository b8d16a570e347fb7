"""Operators called from SQL, in blocks of any size."""

import numpy as np
import pytest

from oscilla.functions import tables
from oscilla.functions.kernels import fir
from oscilla.operators.timefreq import window_spectra
from test_signals import dense, samples

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("size", [20, 64, 1 << 16])
def test_filter(spark, size):
    x = RNG.normal(size=(301, 2))
    tables.register(spark)
    samples(spark, x).createOrReplaceTempView("given")
    got = spark.sql(f"""SELECT * FROM eeg_fir(TABLE(SELECT *, 301L AS n, explode(blocks) AS block FROM (SELECT *, eeg_blocks(s, 301, 20, 20, {size}) AS blocks FROM given))
        PARTITION BY (recording_id, epoch, ch, label, block) ORDER BY (s), 'lowpass', 128.0, NULL, 20.0, 41, {size})""")
    assert np.allclose(dense(got, 301, 2)[:, 1], fir(x[:, 1], "lowpass", 128, None, 20, 40))


@pytest.mark.parametrize("per", [1, 5, 4096])
def test_spectra(spark, per):
    df = samples(spark, RNG.normal(size=(200, 2)))
    tables.register(spark)
    df.createOrReplaceTempView("given")
    got = spark.sql(f"""SELECT ch, win, k, re, im FROM eeg_spectra(TABLE(SELECT *, 200L AS n, explode(blocks) AS block FROM (SELECT *, eeg_windows(s, 200, 32, 12, {per}) AS blocks FROM given))
        PARTITION BY (recording_id, epoch, ch, label, block) ORDER BY (s), 32, 12, {per}, 128.0, 'hamming') ORDER BY ch, win, k""").toPandas()
    want = window_spectra(df, 128, 32, 12, "hamming").select("ch", "win", "k", "re", "im").orderBy("ch", "win", "k").toPandas()
    assert np.allclose(got, want)


def test_runs(spark):
    rows = [("r", s, v) for s, v in zip([1, 2, 3, 5, 6, 7, 8], [True, True, False, False, True, True, False])]
    tables.register(spark)
    spark.createDataFrame(rows, "recording_id string, s long, value boolean").createOrReplaceTempView("given")
    text = "SELECT value, start, stop FROM eeg_runs(TABLE(SELECT *, 0L AS block FROM given {}) PARTITION BY (recording_id, block) ORDER BY (s)) ORDER BY start"
    assert [tuple(r) for r in spark.sql(text.format("")).collect()] == [(True, 1, 2), (False, 3, 3), (False, 5, 5), (True, 6, 7), (False, 8, 8)]
    assert spark.sql(text.format("WHERE s < 0")).count() == 0
