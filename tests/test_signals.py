"""Closed-form signals, metamorphic relations and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import kernels
from oscilla.functions.columns import SAMPLES
from oscilla.operators import agglomeration, bci, clinical, connectivity, epochs, erp, filtering, ica, microstate, plots, sleep, source, spatial, timefreq
from oscilla.plans import queries
from oscilla.plans.pipeline import preprocess
from oscilla.sources import generators
from oscilla.sources.electrodes import SYSTEM_1020, electrodes
from oscilla.sources.views import SR, signal


def samples(spark, data, labels=None, epoch=False):
    """data: (time, channel) or (epoch, time, channel)."""
    data = np.asarray(data, dtype=float)
    data = data if data.ndim == 3 else data[None]
    e, n, c = data.shape
    labels = labels or list(SYSTEM_1020)[:c]
    rows = [("r1", i + 1 if epoch else None, s + 1, k + 1, labels[k], float(data[i, s, k])) for i in range(e) for s in range(n) for k in range(c)]
    return spark.createDataFrame(rows, SAMPLES)


def dense(df, n, c):
    out = np.zeros((n, c))
    for r in df.collect():
        out[r["s"] - 1, r["ch"] - 1] = r["v"]
    return out


RNG = np.random.default_rng(0)


def test_blocks_equal_the_whole(spark):
    x = RNG.normal(size=(700, 2))
    df = samples(spark, x)
    whole = np.stack([kernels.fir(x[:, i], "bandpass", 128, 8, 13) for i in range(2)], axis=1)
    for block in (50, 128, 5000):
        assert np.allclose(dense(filtering.fir_filter(df, "bandpass", 128, 8, 13, block=block), 700, 2), whole, atol=1e-9)


def test_filter_responses(spark):
    t = np.arange(2000) / 250
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 40 * t)
    df = samples(spark, np.stack([slow + fast], axis=1))
    inner = slice(500, 1500)
    for method in ("fir", "iir"):
        low = dense(filtering.eeg_filter(df, 250, highcut=10, method=method), 2000, 1)[:, 0]
        high = dense(filtering.eeg_filter(df, 250, lowcut=20, method=method), 2000, 1)[:, 0]
        assert np.abs(low - slow)[inner].max() < 0.05 and np.abs(high - fast)[inner].max() < 0.05
    gone = dense(filtering.eeg_filter(df, 250, notch=40), 2000, 1)[:, 0]
    assert np.abs(gone - slow)[inner].max() < 0.1
    for bad in ({}, {"lowcut": 20, "highcut": 10}, {"lowcut": 200}, {"notch": 1}):
        with pytest.raises(ValueError):
            filtering.eeg_filter(df, 250, **bad)


def test_butterworth_has_half_power_at_the_cut():
    for low, high, at in ((None, 20, 20), (15, None, 15), (10, 30, 30)):
        for order in (3, 4, 5):
            z = np.exp(-2j * np.pi * at / 200 * np.arange(3))
            f = kernels.butterworth(order, 200, low, high)
            assert abs(abs(np.prod((f[:, :3] @ z) / (f[:, 3:] @ z))) - math.sqrt(0.5)) < 1e-6


def test_recursive_filter_is_stable_and_equals_plain_recursion():
    x = np.random.default_rng(1).normal(size=60_000)
    y = kernels.forward_backward(x, kernels.butterworth(4, 1000, 0.1, 40))
    assert np.abs(y).max() < 5
    f = kernels.butterworth(4, 200, 10, 30)[0]
    b, a, want, z = f[:3], f[3:], [], np.array([0.3, -0.2])
    for v in x[:1000]:
        want.append(b[0] * v + z[0])
        z = np.array([b[1] * v - a[1] * want[-1] + z[1], b[2] * v - a[2] * want[-1]])
    got, end = kernels.section(b, a, x[:1000], np.array([0.3, -0.2]))
    assert np.allclose(got, want) and np.allclose(end, z)


def test_t_distribution():
    assert abs(kernels.t_quantile(0.975, 10) - 2.2281388520) < 1e-8
    assert abs(kernels.t_quantile(0.95, 3) - 2.3533634348) < 1e-8
    assert abs(kernels.t_cdf(-1.0, 1) - 0.25) < 1e-12


def test_rereference(spark):
    df = samples(spark, RNG.normal(size=(20, 4)), ["Cz", "A1", "A2", "Oz"])
    assert np.abs(dense(spatial.rereference(df), 20, 4).mean(axis=1)).max() < 1e-12
    x = dense(spatial.rereference(df, "mastoids"), 20, 4)
    assert np.abs(x[:, 1] + x[:, 2]).max() < 1e-12
    with pytest.raises(ValueError):
        spatial.rereference(df, "channel", ["none"])
    with pytest.raises(ValueError):
        spatial.rereference(df, exclude=["Cz", "A1", "A2", "Oz"])


def test_bad_channels_and_interpolation(spark):
    t = np.arange(500) / 250
    base = np.sin(2 * np.pi * 10 * t)
    x = np.stack([base + 0.1 * RNG.normal(size=500) for _ in range(8)], axis=1)
    x[:, 1], x[:, 4] = 0, RNG.normal(size=500) * 50
    df = samples(spark, x)
    bad = {r["channel"]: r for r in spatial.bad_channels(df).collect()}
    names = list(SYSTEM_1020)
    assert "flat" in bad[names[1]]["reason"] and "noise" in bad[names[4]]["reason"] and "correlation" in bad[names[4]]["reason"] and not bad[names[0]]["is_bad"]
    pos = electrodes(spark).drop("system").where(F.col("label").isin(names[:8]))
    for method in ("spline", "nearest"):
        y = dense(spatial.interpolate(df, [names[1], names[4]], pos, method), 500, 8)
        assert np.corrcoef(y[:, 1], base)[0, 1] > 0.9
        assert np.allclose(y[:, [0, 2, 3]], x[:, [0, 2, 3]])
    with pytest.raises(ValueError):
        spatial.interpolate(df, names[:6], pos)


def test_montage(spark):
    ch = spark.createDataFrame([("fp1",), ("T7",), ("nowhere",)], "label string")
    got = {r["label"]: r["pos_x"] for r in spatial.montage(ch, "biosemi64").collect()}
    assert got == {"fp1": -0.309, "T7": -1.0, "nowhere": None}
    with pytest.raises(ValueError):
        spatial.montage(ch.where("label = 'nowhere'"))


def test_epochs(spark):
    df = samples(spark, RNG.normal(size=(5000, 2)))
    ev = spark.createDataFrame([("r1", i, t) for i, t in enumerate([0.01, 2.0, 4.0, 9.99])], "recording_id string, pos int, onset_sec double")
    x, table = epochs.epoch_events(df, ev, 500)
    assert table.count() == 2 and x.count() == 2 * 501 * 2
    low = x.where("s <= 101").groupBy("epoch", "ch").agg(F.avg("v").alias("m")).collect()
    assert max(abs(r["m"]) for r in low) < 1e-12
    ints = spark.createDataFrame([("r1", 1, 500), ("r1", 2, 1500), ("r1", 3, 2500)], "recording_id string, pos int, onset_sample int")
    assert epochs.epoch_events(df, ints, 500)[1].count() == 3
    with pytest.raises(ValueError):
        epochs.epoch_events(df, ev.where("pos = 0"), 500)


def test_artifacts(spark):
    x = RNG.normal(size=(5, 100, 2)) * 10
    x[1, 50, 0] = 500
    df = samples(spark, x, epoch=True)
    clean, log, summary = epochs.reject_artifacts(df)
    assert [r["epoch"] for r in log.collect()] == [2] and clean.select("epoch").distinct().count() == 4
    assert summary.first()["rejected_epochs"] == [2]
    assert [r["epoch"] for r in epochs.reject_artifacts(df, "gradient", 250, gradient_uv_ms=50)[1].collect()] == [2]
    assert [r["epoch"] for r in epochs.reject_artifacts(df, "joint_probability", jp_threshold=1.5)[1].collect()] == [2]


def test_potentials(spark):
    x, table = generators.make_erp(spark, 20, 2)
    target = x.join(table.where("condition = 'target'"), ["recording_id", "epoch"]).persist()
    p300, n100 = erp.detect(target, 250, "P300").collect(), erp.detect(target, 250, "N100").collect()
    assert all(250 <= r["latency_ms"] <= 350 for r in p300) and all(70 <= r["latency_ms"] <= 130 for r in n100)
    d = erp.difference(x, x).agg(F.max(F.abs("v"))).first()[0]
    assert d == 0
    with pytest.raises(Exception, match="dimensions differ"):
        erp.difference(x, x.where("s < 100")).collect()
    with pytest.raises(ValueError):
        erp.grand_average([x])
    standard = x.join(table.where("condition = 'standard'"), ["recording_id", "epoch"])
    got = erp.permutation_test(target, standard, 200).toPandas()
    assert got[got.time_sample.between(63, 88)].p_value.min() < 0.05 and got.p_value.between(0, 1).all()
    c = erp.permutation_test(target, standard, 200, method="cluster").toPandas()
    assert c.cluster_p.min() < 0.05


def test_wavelet_finds_the_frequency_and_the_time(spark):
    t = np.arange(1000) / 250
    p = timefreq.wavelet(samples(spark, np.sin(2 * np.pi * 10 * t)[:, None]), 250, list(range(5, 21)))
    assert p.groupBy("freq").agg(F.avg("power").alias("p")).orderBy(F.desc("p")).first()["freq"] == 10
    x = np.zeros(800)
    x[400] = 1
    assert np.abs(kernels.morlet(x, 250, [10.0], 7)[0]).argmax() == 400
    half = math.ceil(3 * 7 / (2 * math.pi * 10) * 250)
    assert np.abs(kernels.morlet(x, 250, [10.0], 7, "reference")[0]).argmax() == 400 - 2 * half


def test_phase_locking_over_epochs(spark):
    t = np.arange(250) / 250
    locked = np.stack([np.sin(2 * np.pi * 10 * t) + 0.1 * RNG.normal(size=250) for _ in range(20)])[:, :, None]
    loose = np.stack([np.sin(2 * np.pi * 10 * t + RNG.uniform(0, 6.28)) for _ in range(20)])[:, :, None]
    value = lambda x: timefreq.itc(samples(spark, x, epoch=True), 250, [10]).where("s between 80 and 170").agg(F.avg("itc")).first()[0]
    assert value(locked) > 0.9 and value(loose) < 0.5


def test_tapers_and_multitaper(spark):
    w = kernels.dpss(128, 4, 7)
    assert np.allclose(w @ w.T, np.eye(7), atol=1e-9)
    t = np.arange(512) / 128
    psd = timefreq.multitaper(samples(spark, np.sin(2 * np.pi * 20 * t)[:, None]), 128)
    assert abs(psd.orderBy(F.desc("psd")).first()["freq"] - 20) <= 1.5


def test_long_tapers():
    def dense(n, nw, k):
        i = np.arange(n)
        off = i[1:] * (n - i[1:]) / 2
        m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * math.cos(2 * math.pi * nw / n)) + np.diag(off, 1) + np.diag(off, -1)
        return np.linalg.eigh(m)[1][:, ::-1][:, :k].T

    for n, nw, k in ((1500, 4, 7), (1501, 2.5, 4), (1500, 12, 23)):
        w = kernels.dpss(n, nw, k)
        assert np.allclose(np.abs((w * dense(n, nw, k)).sum(axis=1)), 1, atol=1e-12) and np.allclose(w @ w.T, np.eye(k), atol=1e-9)
    n, w = 20_000, kernels.dpss(20_000, 4, 7)
    i = np.arange(n)
    off, v = i[1:] * (n - i[1:]) / 2, ((n - 1 - 2 * i) / 2) ** 2 * math.cos(8 * math.pi / n)
    for row in w:
        out = v * row
        out[1:] += off * row[:-1]
        out[:-1] += off * row[1:]
        assert np.abs(out - (row @ out) * row).max() < 1e-11 * n * n


def test_spectra_without_an_oracle_take_the_whole_signal(spark):
    """multitaper and morlet against NumPy on every sample of every channel."""
    d = "/root/testdata/sf0.01"
    x = signal(spark, d).toPandas().sort_values("s")
    psd, power = (queries.QUERIES[q](spark, d).toPandas() for q in ("multitaper", "morlet"))
    for label, one in x.groupby("label"):
        v = one.v.to_numpy()
        got = psd[psd.label == label].sort_values("freq").psd.to_numpy()
        assert np.allclose(got, (np.abs(np.fft.rfft(kernels.dpss(len(v), 4, 7) * v, axis=1)) ** 2).mean(axis=0) / SR, atol=1e-3)
        got = power[(power.label == label) & (power.freq == 10)].sort_values("s").power.to_numpy()
        assert len(got) == len(v) > 512 and np.allclose(got, np.abs(kernels.morlet(v, SR, [10.0], 7)[0]) ** 2, atol=1e-3)


def test_coupling(spark):
    n, t = 2500, np.arange(2500) / 250
    wave, noise = np.sin(2 * np.pi * 10 * t), RNG.normal(size=(n, 2))
    x = np.stack([wave, np.sin(2 * np.pi * 10 * t + math.pi / 4), noise[:, 0], noise[:, 1]], axis=1)
    df = samples(spark, x).persist()
    coh = {(r["ch1"], r["ch2"]): r["value"] for r in connectivity.coherence(df, 250).collect()}
    assert coh["Fp1", "Fp2"] > 0.95 and coh["F7", "F3"] < 0.5
    lock = {(r["channel1"], r["channel2"]): r["plv"] for r in connectivity.plv(df, 250).collect()}
    assert lock["Fp1", "Fp2"] > 0.95 and lock["F7", "F3"] < 0.5
    m = connectivity.connectivity_matrix(df, 250).toPandas().pivot(index="a", columns="b", values="value").to_numpy()
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 1)
    with pytest.raises(ValueError):
        connectivity.coherence(df, 250, band=(8, 200))


def test_granger_orientation(spark):
    x = RNG.normal(size=2000)
    y = np.concatenate([np.zeros(5), 0.7 * x[:-5]]) + RNG.normal(size=2000) * 0.5
    df = samples(spark, np.stack([x, y], axis=1), ["x", "y"])
    g = {(r[1], r[2]): r[3] for r in connectivity.granger(df, 250, 10).collect()}
    assert g["x", "y"] > g["y", "x"] + 0.5
    with pytest.raises(ValueError):
        connectivity.granger(df.where("s < 10"), 250, 10)


def test_sleep(spark):
    literal = spark.createDataFrame([("r1", i + 1, s) for i, s in enumerate("W W N1 N2 N2 N3 N2 REM REM W".split())], "recording_id string, epoch int, stage string")
    got = {r["metric"]: round(r["value"], 2) for r in sleep.sleep_metrics(literal).collect()}
    assert got == {"total_sleep_time": 3.5, "sleep_efficiency": 70.0, "sleep_latency": 1.0, "waso": 0.5, "rem_latency": 2.5, "pct_N1": 14.29, "pct_N2": 42.86, "pct_N3": 14.29, "pct_REM": 28.57, "pct_W": 30.0}
    x, truth = generators.make_sleep(spark, 18_000, 1, 100)
    x = x.persist()
    found = [r["stage"] for r in sleep.sleep_stages(x, 100, 30).orderBy("epoch").collect()]
    assert len(found) == 6 and found[3] == "N3" and found[0] == "W"
    sp = sleep.spindles(x, 100).collect()
    assert sp and all(r["duration_ms"] >= 500 for r in sp) and any(12 < r["frequency_hz"] < 14 for r in sp)
    kc = sleep.k_complexes(x, 100, min_neg_amplitude=30).collect()
    assert all(r["negative_amplitude"] < 0 < r["positive_amplitude"] for r in kc)
    sw = sleep.slow_waves(x, 100, min_amplitude=40).collect()
    assert sw and all(r["negative_peak"] <= -40 for r in sw)
    with pytest.raises(ValueError):
        sleep.sleep_stages(x.where("s < 100"), 100)


def test_clinical(spark):
    t = np.arange(2500) / 250
    alpha = np.sin(2 * np.pi * 10 * t)
    df = samples(spark, np.stack([20 * alpha, 5 * alpha], axis=1), ["F4", "F3"])
    q = clinical.qeeg(df, 250).toPandas()
    assert (q.sort_values("absolute_power").groupby("label").tail(1).band == "alpha").all()
    assert np.allclose(q.groupby("label").relative_power.sum(), 1)
    a = clinical.asymmetry(df, 250).collect()
    assert len(a) == 1 and abs(a[0]["asymmetry_index"] - 2 * math.log(4)) < 1e-6
    slow = clinical.slowing(samples(spark, 50 * np.sin(2 * np.pi * 2 * t)[:, None]), 250, "peak_frequency").first()
    assert slow["value"] < 5 and "slowing" in slow["classification"]
    x = 50 * RNG.normal(size=(5000, 2))
    x[2000:3500] *= 0.001
    seg, bsr = clinical.suppression(samples(spark, x), 250)
    assert [r["type"] for r in seg.orderBy("start_sample").collect()] == ["burst", "suppression", "burst"] and 25 < bsr.first()["bsr"] < 35


def test_spikes_near_the_truth(spark):
    x, truth = generators.make_spikes(spark, 15_000, 4, 500, 6)
    at = [r["sample"] for r in truth.collect()]
    for method in ("morphology", "template"):
        found = clinical.spikes(x, 500, method, min_duration_ms=2).collect()
        hits = [r for r in found if min(abs(r["sample"] - a) for a in at) <= 50]
        assert hits and len(hits) >= 0.8 * len(found)


def test_microstates(spark):
    maps = RNG.normal(size=(3, 6))
    state = np.repeat(RNG.integers(0, 3, 60), 5)
    df = samples(spark, maps[state] * RNG.uniform(1, 3, size=(300, 1)) * RNG.choice([-1, 1], size=(300, 1)) + 0.01 * RNG.normal(size=(300, 6))).persist()
    for method in ("kmeans", "aahc"):
        _, labels = microstate.microstates(df, 3, method)
        got = labels.toPandas().sort_values("s").label.to_numpy()
        assert max(np.mean([p[g - 1] == s for g, s in zip(got, state)]) for p in __import__("itertools").permutations(range(3))) > 0.95
    _, labels = microstate.microstates(df, 3, "pca")
    assert abs(microstate.state_statistics(labels, 250).agg(F.sum("coverage_pct")).first()[0] - 100) < 1e-9
    for r in microstate.state_transitions(labels).groupBy("from_state").agg(F.sum("p").alias("p")).collect():
        assert abs(r["p"] - 1) < 1e-9


def peak_topographies(samples):
    x = samples.toPandas().pivot(index="s", columns="ch", values="v").sort_index().to_numpy()
    g = x.std(axis=1)
    at = np.flatnonzero((g[1:-1] > g[:-2]) & (g[1:-1] >= g[2:]) & (g[1:-1] > np.quantile(g, 0.01))) + 1
    return x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)


def noise(spark, n, channels):
    sites = F.explode(F.sequence(F.lit(1), F.lit(channels))).alias("ch")
    v = (F.pmod(F.xxhash64("s", "ch"), F.lit(1_000_003)) / 1_000_003.0 - 0.5).alias("v")
    return spark.range(1, n + 1, numPartitions=3).select(F.lit("r1").alias("recording_id"), F.col("id").alias("s"), sites).select("*", v, F.col("ch").cast("string").alias("label"))


def test_kmeans_maps_rest_on_all_peaks(spark):
    df = noise(spark, 66_000, 3)
    x = peak_topographies(df)
    assert len(x) > 20_000
    table, _ = microstate.microstates(df, 3, "kmeans")
    maps = table.toPandas().pivot(index="state", columns="ch", values="w").to_numpy()
    own = np.abs(x @ maps.T).argmax(axis=1)
    for j in range(3):  # no round over all peaks changes them
        m = x[own == j]
        mean = (m * np.where(m @ m[0] < 0, -1, 1)[:, None]).mean(axis=0)
        assert np.allclose(maps[j], mean / np.linalg.norm(mean), atol=1e-9)


def test_merged_maps_rest_on_all_peaks(spark):
    df = noise(spark, 3300, 4)
    x = peak_topographies(df)
    assert len(x) > 1000
    sums, n = x.copy(), len(x)
    centres, alive, like = x.copy(), np.ones(n, dtype=bool), np.triu(np.abs(x @ x.T), 1)
    for _ in range(n - 4):
        i, j = np.unravel_index(int(like.argmax()), like.shape)
        sums[i] += sums[j] * (-1 if centres[i] @ centres[j] < 0 else 1)
        centres[i] = sums[i] / np.linalg.norm(sums[i])
        alive[j] = False
        like[j, :] = like[:, j] = -1
        row = np.where(alive, np.abs(centres @ centres[i]), -1)
        like[i, i + 1 :], like[:i, i] = row[i + 1 :], row[:i]
    table, _ = microstate.microstates(df, 4, "aahc")
    maps = table.toPandas().pivot(index="state", columns="ch", values="w").to_numpy()
    assert np.allclose(maps, centres[alive], atol=1e-9)


def plain_merges(x, k):
    sums, n = x.copy(), len(x)
    centres, alive, like = x.copy(), np.ones(n, dtype=bool), np.triu(np.abs(x @ x.T), 1)
    for _ in range(n - k):
        i, j = np.unravel_index(int(like.argmax()), like.shape)
        sums[i] += sums[j] * (-1 if centres[i] @ centres[j] < 0 else 1)
        centres[i] = sums[i] / np.linalg.norm(sums[i])
        alive[j] = False
        like[j, :] = like[:, j] = -1
        row = np.where(alive, np.abs(centres @ centres[i]), -1)
        like[i, i + 1 :], like[:i, i] = row[i + 1 :], row[:i]
    return centres[alive]


@pytest.mark.parametrize("kind", ["noise", "groups", "few found"])
def test_merges_in_tasks_are_the_plain_ones(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    if kind == "groups":  # one close group that its own centre takes in row by row
        x[::2] = [3, 1, 0, 2, 0, 1] + 0.02 * rng.normal(size=(100, 6))
        x *= rng.choice([-1, 1], size=(200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held, plain = [], agglomeration.merge_all
    monkeypatch.setattr(agglomeration, "merge_all", lambda sums, sizes, k: held.append(len(sums)) or plain(sums, sizes, k))
    for name, value in {"FINAL": 60, "PAIRS": 60, "FOUND": 100 if kind == "few found" else 800, "BLOCK": 50, "PROBES": 100}.items():
        monkeypatch.setattr(agglomeration, name, value)
    rows = spark.createDataFrame([("r1", i, v.tolist()) for i, v in enumerate(x)], "recording_id string, s long, x array<double>")
    maps = agglomeration.merge(microstate.distinct(rows, 4, 3), 4)
    assert len(held) == 1 and held[0] <= 60
    assert np.allclose(maps, plain_merges(x, 4), atol=1e-9)


def test_equal_topographies_merge_first(spark):
    x = np.array([[3.0, 4, 0], [0, 0, 2], [-3, -4, 0], [0, 0, 2], [0, 0, 0], [0, 0, 0]])
    rows = spark.createDataFrame([(r, i, v.tolist()) for r in ("r1", "r2") for i, v in enumerate(x, 1)], "recording_id string, s long, x array<double>")
    got = [(r["id"], r["size"], r["x"]) for r in microstate.distinct(rows, 2, 2).orderBy("id").collect()]
    assert [g[:2] for g in got] == [(0, 4), (1, 4), (4, 1), (5, 1), (10, 1), (11, 1)]
    assert np.allclose(got[0][2], [2.4, 3.2, 0]) and np.allclose(got[1][2], [0, 0, 4])
    few = rows.where("s < 5")
    for k in (2, 3, 4):  # the last copies of the last topography are left
        got = [(r["id"], r["x"]) for r in microstate.distinct(few, k, 2).orderBy("id").collect()]
        assert [g[0] for g in got] == [[0, 1], [0, 1, 7], [0, 1, 5, 7]][k - 2]
        assert np.allclose(agglomeration.merge(microstate.distinct(few, k, 2), k), [[0.6, 0.8, 0]] + [[0, 0, 1]] * (k - 1))


@pytest.mark.parametrize("method", ["fastica", "jade", "infomax"])
def test_components(spark, method):
    t = np.arange(1500) / 250
    s = np.stack([np.sin(2 * np.pi * 5 * t), np.sign(np.sin(2 * np.pi * 11 * t)), RNG.laplace(size=1500)], axis=1)
    x = s @ np.array([[1, 0.5, 0.3], [0.2, 1, 0.4], [0.6, 0.1, 1]])
    df = samples(spark, x, ["Fp1", "Cz", "Oz"]).persist()
    model = ica.fit(df, method=method, max_iter=40)
    got = ica.sources(df, model).toPandas().pivot(index="s", columns="component", values="v").to_numpy()
    best = np.abs(np.corrcoef(got.T, s.T)[:3, 3:]).max(axis=0)
    assert np.allclose(model.unmixing @ model.mixing, np.eye(3), atol=1e-6)
    assert (best > 0.7).sum() >= (1 if method == "infomax" else 3)
    assert np.allclose(dense(ica.remove(df, model, []), 1500, 3), x, atol=1e-8)
    assert ica.detect(df, model, "kurtosis").count() == ica.detect(df, model, "spatial").count() == ica.detect(df, model).count() == 3
    with pytest.raises(ValueError):
        ica.fit(df, 4)


def test_sources(spark):
    labels = list(SYSTEM_1020)[:10]
    models = [source.forward_model(labels, m, 20) for m in ("spherical", "bem_simplified")]
    assert all(m.leadfield.shape == (10, 60) for m in models) and not np.allclose(models[0].leadfield, models[1].leadfield)
    assert (np.sqrt((models[0].sources ** 2).sum(axis=1)) <= 0.8).all()
    df = samples(spark, RNG.normal(size=(128, 10)), labels).persist()
    out = [source.estimate(df, models[0], m).toPandas().sort_values(["s", "source_col"]).v.to_numpy() for m in ("mne", "sloreta", "eloreta")]
    assert len(out[0]) == 128 * 60 and not np.allclose(out[0], out[1])
    assert (source.beamformer(df, models[0]).toPandas().power > 0).all() and source.beamformer(df, models[0], "dics", 128).count() == 20
    p = source.source_power(df, models[0], 128, method="mne").toPandas()
    j = out[0].reshape(128, 60)
    f = np.abs(np.fft.rfft(j[:, 4])) ** 2 / 128
    k = np.arange(65)
    assert np.isclose(p[(p.source_id == 5) & (p.band == "alpha")].power.iloc[0], f[(k >= 8) & (k <= 13)].sum())


def test_trials(spark):
    x, table = generators.make_bci(spark, 8)
    x = x.persist()
    labels = {r["epoch"]: r["condition"] for r in table.collect()}
    model = bci.csp(x, labels, 2)
    assert model.filters.shape == (4, 8) and model.features.count() == 16
    out, accuracy = bci.classify(bci.features(x, "bandpower", 256), labels, cv_folds=4)
    assert accuracy > 0.8 and out.count() == 16
    assert len(bci.features(x, "riemannian").first()["features"]) == 36
    best = bci.ssvep(x, 256, [9.0, 12.0, 15.0]).first()["predicted_class"]
    assert best == 12.0
    assert bci.motor_imagery(x, 256).count() == 16 * 8 * 2
    with pytest.raises(ValueError):
        bci.csp(x, {**labels, 1: "third"})


def test_plot_tables(spark):
    df = samples(spark, RNG.normal(size=(100, 3)))
    assert plots.signal_frame(df, 100, time_range=(0.2, 0.4)).count() == 21 * 3
    grid = plots.scalp_frame(df, plots.flat_positions(spark, list(SYSTEM_1020)[:3]), 100, resolution=21).toPandas()
    assert (grid.gx**2 + grid.gy**2 <= 1).all() and grid.value.notna().all()
    assert plots.outline(spark).select("part").distinct().count() == 4
    assert plots.components_frame(df.select("s", F.col("ch").alias("component"), "v"), spark.createDataFrame([(1, "Cz", 0.5), (1, "Oz", -0.9), (2, "Cz", 1.0), (3, "Pz", 1.0)], "component int, label string, w double")).where("name = 'IC1 (Oz)'").count() == 100


def test_pipeline_of_steps(spark):
    t = np.arange(2500) / 250
    x = np.stack([np.sin(2 * np.pi * 10 * t) + 0.2 * RNG.normal(size=2500) for i in range(6)], axis=1)
    x[:, 2] = 0
    pos = electrodes(spark).drop("system").where(F.col("label").isin(list(SYSTEM_1020)[:6]))
    ev = spark.createDataFrame([("r1", 1, 2.0), ("r1", 2, 5.0)], "recording_id string, pos int, onset_sec double")
    out = preprocess(samples(spark, x), 250, 1, 40, positions=pos, events=ev, epoch=True, reject_uv=100)
    assert [k for k, _, _ in out.log] == ["filter", "bad_channels", "interpolate", "rereference", "epoch", "reject"] and out.samples.count() == 2 * 251 * 6
    with pytest.raises(ValueError):
        preprocess(samples(spark, x), 250, epoch=True)


def test_generators(spark):
    assert generators.make_eeg(spark, 500, 3).count() == 1500
    assert generators.make_eeg(spark, 50, 2).collect() == generators.make_eeg(spark, 50, 2).collect()
    assert "sleep" in generators.quick_start() and generators.quick_start("erp").startswith("erp")
    with pytest.raises(ValueError):
        generators.quick_start("nothing")


def test_shapes_are_checked(spark):
    whole, cut = samples(spark, RNG.normal(size=(64, 2))), samples(spark, RNG.normal(size=(2, 64, 2)), epoch=True)
    labels = {1: "a", 2: "b"}
    for needs_epochs in (
        lambda x: erp.detect(x, 128), lambda x: erp.latency(x, 128, (0, 200)), lambda x: erp.baseline(x, 128, (0, 100)), lambda x: erp.permutation_test(x, x, 5),
        lambda x: bci.csp(x, labels), lambda x: bci.motor_imagery(x, 128), lambda x: bci.features(x, "bandpower", 128), lambda x: bci.riemannian(x),
    ):
        with pytest.raises(ValueError, match="epochs"):
            needs_epochs(whole)
    for needs_whole in (
        lambda x: filtering.eeg_filter(x, 128, 4, 20), lambda x: connectivity.coherence(x, 128), lambda x: connectivity.plv(x, 128), lambda x: connectivity.granger(x, 128, 2),
    ):
        with pytest.raises(ValueError, match="continuous"):
            needs_whole(cut)


def maps_by_hand(x, k, seed, rounds):
    maps, old = x[np.random.default_rng(seed).choice(len(x), k, replace=False)], None
    for _ in range(rounds):
        own = np.abs(x @ maps.T).argmax(axis=1)
        if old is not None and (own == old).all():
            break
        sums = [(m * np.where(m @ m[0] < 0, -1, 1)[:, None]).sum(axis=0) if len(m := x[own == j]) else maps[j] for j in range(k)]
        maps, old = np.array([m / np.linalg.norm(m) for m in sums]), own
    return maps


@pytest.mark.parametrize("head", [1, 3, 1024])
def test_kmeans_rounds_by_hand(spark, monkeypatch, head):
    df = noise(spark, 1500, 4).persist()
    x = peak_topographies(df)
    monkeypatch.setattr(microstate, "HEAD", head)  # few: states whose first peak lies beyond the head
    table, _ = microstate.microstates(df, 5, "kmeans", seed=7)
    maps = table.toPandas().pivot(index="state", columns="ch", values="w").to_numpy()
    assert len(x) > 400
    assert np.allclose(maps, maps_by_hand(x, 5, 7, microstate.ROUNDS), atol=1e-9)


@pytest.mark.parametrize("folds", [None, 3])
def test_features_are_made_once(spark, folds):
    """Every pass of a classification reads the features; none makes them again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i + 1, [float(RNG.normal() + i % 2), float(RNG.normal())]) for i in range(60)]
    feats = spark.createDataFrame(rows, "trial int, features array<double>").mapInArrow(counted, "trial int, features array<double>")
    out, _ = bci.classify(feats, {i + 1: "ab"[i % 2] for i in range(60)}, "shrinkage_lda", folds)
    assert out.count() == 60 and made.value == 60


def test_bands_of_many_trials(spark, monkeypatch):
    """Blocks of trials, also of unequal ones, are filtered like each trial alone."""
    monkeypatch.setattr(bci, "BLOCK", 300)
    x = samples(spark, RNG.normal(size=(7, 100, 2)), epoch=True).where("epoch <> 3 OR s <= 80").cache()
    got = {(r["epoch"], r["ch"], r["band"], r["s"]): r["v"] for r in bci._banded(x, 128, bci.BANDS, 100).collect()}
    whole = x.toPandas().sort_values("s")
    assert len(got) == 2 * len(whole)
    for (epoch, ch), p in whole.groupby(["epoch", "ch"]):
        for name, (a, b) in bci.BANDS.items():
            assert np.allclose([got[epoch, ch, name, s] for s in p.s], kernels.fir(p.v.to_numpy(), "bandpass", 128, a, b))
