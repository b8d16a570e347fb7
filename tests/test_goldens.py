"""Operators without oracle SQL against plain NumPy on the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import kernels
from oscilla.operators import bci, connectivity, erp, ica, source, spatial, timefreq
from oscilla.sources.electrodes import SYSTEM_1010, SYSTEM_1020, electrodes
from test_signals import dense, samples

LABELS = list(SYSTEM_1020)


def mixed(n=900, c=4, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / 128
    s = np.stack([np.sign(np.sin(2 * np.pi * 3 * t)), np.sin(2 * np.pi * 7.3 * t), rng.laplace(size=n), rng.uniform(-1, 1, n)][:c], axis=1)
    return s @ rng.normal(size=(c, c)).T * 10 + 5


def plain_granger(x, y, order, sr, band=None):
    """Forward Granger causality of x on y by the definition, on whole vectors."""
    n = len(x)
    z = np.stack([x - x.mean(), y - y.mean()])
    r = [z[:, k:] @ z[:, : n - k].T / n for k in range(order + 1)]
    big = np.block([[r[i - j].T if i >= j else r[j - i] for j in range(order)] for i in range(order)])
    right = np.concatenate([r[k].T[:, 1] for k in range(1, order + 1)])
    own = np.array([m[1, 1] for m in r])
    alone = np.array([[own[abs(i - j)] for j in range(order)] for i in range(order)])
    ridge = lambda m: m + 1e-6 * np.abs(np.diag(m)).max() * np.eye(len(m))
    both, one = np.linalg.solve(ridge(big), right).reshape(order, 2), np.linalg.solve(ridge(alone), own[1:])
    full = z[1, order:] - sum(both[k - 1] @ z[:, order - k : n - k] for k in range(1, order + 1))
    part = z[1, order:] - sum(one[k - 1] * z[1, order - k : n - k] for k in range(1, order + 1))
    freqs = np.linspace(0, sr / 2, 128)
    wave = np.exp(-2j * np.pi * np.outer(freqs, np.arange(1, order + 1)) / sr)
    gain = np.maximum(0, np.log(part.var(ddof=1) / np.abs(1 - wave @ one) ** 2 / (full.var(ddof=1) / np.abs(1 - wave @ both[:, 1]) ** 2)))
    use = np.arange(1, 128) if band is None else (freqs >= band[0]) & (freqs <= band[1])
    return gain[use].mean()


@pytest.mark.parametrize("block", [1 << 14, 100, 7])
def test_granger(spark, monkeypatch, block):
    monkeypatch.setattr(connectivity, "LAGS_BLOCK", block)
    x = mixed(400, 3)
    x[5:, 1] += 0.7 * x[:-5, 0]
    got = {(r["from_channel"], r["to_channel"]): r["gc_value"] for r in connectivity.granger(samples(spark, x), 128, 6).collect()}
    for i in range(3):
        for j in range(3):
            if i != j:
                assert abs(got[LABELS[i], LABELS[j]] - plain_granger(x[:, i], x[:, j], 6, 128)) < 1e-8


@pytest.mark.parametrize("block", [1 << 16, 64, 40])
def test_window_spectra(spark, block):
    x = mixed(333, 2)
    got = timefreq.window_spectra(samples(spark, x), 128, 32, 12, "hamming", (5, 40), block).toPandas()
    k = np.array([k for k in range(17) if 5 <= k * 4 <= 40])
    assert sorted(got.k.unique()) == k.tolist() and got.win.max() == (333 - 32) // 12
    for (ch, win), g in got.groupby(["ch", "win"]):
        z = np.fft.rfft(x[win * 12 : win * 12 + 32, ch - 1] * timefreq.window_weights("hamming", 32))[k]
        g = g.sort_values("k")
        assert np.allclose(g.re + 1j * g.im, z)
    with pytest.raises(ValueError):
        timefreq.window_spectra(samples(spark, x[:20]), 128, 32, 12)


def whitened(x, p):
    cov = np.cov(x.T)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:p]
    return (x - x.mean(0)) @ (vectors[:, top] / np.sqrt(values[top]))


def test_fastica_and_infomax_steps(spark):
    """The iterations on moments are those on the whole matrix."""
    x, p = mixed(), 3
    df = samples(spark, x).persist()
    start = ica.orthogonal(np.random.default_rng(1).normal(size=(p, p)))
    for method in ("fastica", "infomax"):
        z, w = whitened(x, p), start
        for _ in range(200):
            if method == "fastica":
                g = np.tanh(z @ w.T)
                new = ica.orthogonal(g.T @ z / len(z) - (1 - g**2).mean(0)[:, None] * w)
            else:
                u = z @ w.T
                new = w + 0.01 * (np.eye(p) + (1 - 2 / (1 + np.exp(-u))).T @ u / len(z)) @ w
                new /= np.linalg.svd(new, compute_uv=False)[0]
                new /= np.sqrt((new**2).sum(1, keepdims=True))
            done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
            w = new
            if done:
                break
        want = z @ (w if method == "fastica" else ica.orthogonal(w)).T
        got = ica.sources(df, ica.fit(df, p, method)).toPandas().pivot(index="s", columns="component", values="v").to_numpy()
        assert np.allclose(np.abs((got * want).mean(0)), 1, atol=2e-2)


def plain_jade(z, sweeps=200, tol=1e-6, share=4):
    """Sweeps of whole rotation matrices over cumulants taken from the data."""
    n, p = z.shape
    eye, mats = np.eye(p), []
    for k in range(p):
        for m in range(k, p):
            mats.append((z * (z[:, k] * z[:, m])[:, None]).T @ z / n - (k == m) * eye - np.outer(eye[k], eye[m]) - np.outer(eye[m], eye[k]))
    v = eye
    for _ in range(sweeps):
        most = 0
        for i in range(p):
            for j in range(i + 1, p):
                d, o = np.array([m[i, i] - m[j, j] for m in mats]), np.array([m[i, j] + m[j, i] for m in mats])
                a = math.atan2(2 * d @ o, d @ d - o @ o) / share
                if abs(math.sin(a)) > tol:
                    g = np.eye(p)
                    g[i, i] = g[j, j] = math.cos(a)
                    g[j, i], g[i, j] = math.sin(a), -math.sin(a)
                    mats = [g.T @ m @ g for m in mats]
                    v = v @ g
                    most = max(most, abs(math.sin(a)))
        if most < tol:
            break
    return v.T


def test_jade_and_removal(spark):
    x, p = mixed(3000), 4
    df = samples(spark, x)
    z = whitened(x, p)
    for angle, sweeps, share in (("reference", 3, 2), ("optimal", 200, 4)):
        model = ica.fit(df, p, "jade", max_iter=sweeps, angle=angle)
        y = (x - model.mean) @ model.unmixing.T
        want = z @ plain_jade(z, sweeps, share=share).T
        assert np.allclose(np.abs((y * want).mean(0)), 1, atol=1e-3) and np.allclose(np.cov(y.T), np.eye(p), atol=1e-6)
    table = ica.mixing_table(spark, model).toPandas()
    assert np.allclose(table.pivot(index="ch", columns="component", values="w").to_numpy(), model.mixing)
    back = dense(ica.remove(df, model, []), 3000, 4)
    assert np.allclose(back, x)
    gone = dense(ica.remove(df, model, [2]), 3000, 4)
    assert np.allclose(gone, x - np.outer(y[:, 1], model.mixing[:, 1]))


def independent(c, n=20_000, seed=11):
    rng = np.random.default_rng(seed)
    s = np.stack([rng.laplace(size=n) if i % 2 else rng.uniform(-1, 1, n) for i in range(c)], axis=1)
    return s, s @ rng.normal(size=(c, c)).T


def best_matches(y, s):
    """For each source the largest correlation with a component; each component may serve once."""
    r = np.abs(np.corrcoef(y.T, s.T)[: y.shape[1], y.shape[1] :])
    assert len(set(r.argmax(0))) == s.shape[1]
    return r.max(0)


@pytest.mark.parametrize("c", [2, 3, 5])
def test_jade_separates(spark, c):
    s, x = independent(c)
    model = ica.fit(samples(spark, x), c, "jade")
    y = (x - model.mean) @ model.unmixing.T
    assert best_matches(y, s).min() > 0.99
    # kurtosis tells the flat sources (uniform: -1.2) from the peaked ones (Laplace: 3)
    found = {r["component"]: r for r in ica.detect(samples(spark, x), model, "kurtosis").collect()}
    r = np.abs(np.corrcoef(y.T, s.T)[:c, c:])
    for i in range(c):
        flat = r[i].argmax() % 2 == 0
        assert abs(found[i + 1]["score"] - (-1.2 if flat else 3)) < 0.5 and (found[i + 1]["type"] == "artifact") == flat


@pytest.mark.parametrize("c", [2, 3, 5])
def test_jade_sweeps_lower_the_criterion(c):
    _, x = independent(c, 5000)
    z = whitened(x, c)
    m4 = np.einsum("ti,tj,tk,tl->ijkl", z, z, z, z, optimize=True) / len(z)
    beside = lambda w: sum(((t := w @ m @ w.T) ** 2).sum() - (np.diag(t) ** 2).sum() for m in kernels.cumulants(m4))
    falls = [beside(kernels.jade(m4, sweeps=k)) for k in range(6)]
    assert all(b <= a + 1e-12 for a, b in zip(falls, falls[1:])) and falls[-1] < falls[0]
    assert np.allclose(kernels.jade(m4, sweeps=20), kernels.jade(m4, sweeps=200))  # it has stopped turning


def test_artifact_components(spark):
    x = mixed()
    df = samples(spark, x)
    model = ica.fit(df, 3, "jade")
    y = (x - model.mean) @ model.unmixing.T
    kurt = {r["component"]: r["score"] for r in ica.detect(df, model, "kurtosis").collect()}
    centred = y - y.mean(0)
    assert np.allclose([kurt[i] for i in (1, 2, 3)], (centred**4).mean(0) / (centred**2).mean(0) ** 2 - 3)
    corr = {r["component"]: r["score"] for r in ica.detect(df, model, "correlation").collect()}
    front = [i for i, name in enumerate(LABELS[:4]) if name in ica.FRONTAL]
    for i in range(3):
        assert np.isclose(corr[i + 1], max(abs(np.corrcoef(y[:, i], x[:, j])[0, 1]) for j in front))
    spatial_ = {r["component"]: r["score"] for r in ica.detect(df, model, "spatial").collect()}
    a = np.abs(model.mixing)
    assert np.allclose([spatial_[i] for i in (1, 2, 3)], a.max(0) / a.sum(0))


def test_source_estimates(spark):
    x = mixed(200, 4) * 1e-3
    df = samples(spark, x).persist()
    model = source.forward_model(LABELS[:4], n_sources=15)
    lf, lam = model.leadfield, 0.05
    k = lf.T @ np.linalg.inv(lf @ lf.T + lam * np.eye(4))
    kernels_ = {"mne": k, "sloreta": k / np.sqrt(np.abs(np.diag(k @ lf)))[:, None]}
    for method, w in kernels_.items():
        got = source.estimate(df, model, method).toPandas().pivot(index="s", columns="source_col", values="v").to_numpy()
        assert np.allclose(got, x @ w.T)
    z = np.abs(np.fft.rfft(x @ kernels_["mne"].T, axis=0)) ** 2 / 200
    freq = np.fft.rfftfreq(200, 1 / 128)
    power = source.source_power(df, model, 128, method="mne").toPandas()
    for band, (a, b) in source.BANDS.items():
        p = power[power.band == band].sort_values("source_id").power.to_numpy()
        assert np.allclose(p, z[(freq >= a) & (freq <= b)].sum(0))


@pytest.mark.parametrize("scale", [1.0, 2e-5])
def test_beamformers(spark, scale):
    """Power is that of the plain covariance, at volts too."""
    x = mixed(200, 4) * scale
    df = samples(spark, x).persist()
    model = source.forward_model(LABELS[:4], n_sources=10)
    z = np.fft.fft(x, axis=0)[:101]
    freq = np.linspace(0, 64, 101)
    csd = np.mean([np.outer(v, v.conj()).real for v in z[(freq >= 8) & (freq <= 13)]], axis=0)
    for method, c in (("lcmv", np.cov(x.T)), ("dics", csd)):
        inv, want = np.linalg.inv(c + 1e-6 * np.eye(4)), []
        for j in range(10):
            best = 0.0
            for col in model.leadfield[:, 3 * j : 3 * j + 3].T:
                den = col @ inv @ col
                if abs(den) >= 1e-20:
                    w = inv @ col / den
                    best = max(best, w @ c @ w)
            want.append(best)
        got = source.beamformer(df, model, method, 128).orderBy("source").toPandas().power
        assert np.allclose(got, want, rtol=1e-6)


def trials(seed=0, e=12, n=64, c=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(e, n, c))
    x[::2, :, 0] *= 3
    x[1::2, :, 2] *= 2
    return x, {i + 1: "a" if i % 2 == 0 else "b" for i in range(e)}


def test_spatial_patterns_and_tangent_vectors(spark):
    x, labels = trials()
    df = samples(spark, x, epoch=True).persist()
    covs = np.array([np.cov(e.T) for e in x])
    model = bci.csp(df, labels, 1)
    norm = covs / np.trace(covs, axis1=1, axis2=2)[:, None, None]
    a, b = norm[::2].mean(0), norm[1::2].mean(0)
    for w, value in zip(model.filters, model.eigenvalues):  # generalised eigenvectors of a against a + b
        assert np.allclose(a @ w, value * (a + b) @ w)
    var = np.einsum("fc,ncd,fd->nf", model.filters, covs, model.filters)
    got = np.array([r["features"] for r in model.features.orderBy("trial").collect()])
    assert np.allclose(got, np.log(var / var.sum(1, keepdims=True)))
    covs = covs + 1e-6 * np.eye(4)
    mean = kernels.geometric_mean(covs)
    inner = np.linalg.inv(np.linalg.cholesky(mean))
    logs = sum(kernels.log_of(inner @ c @ inner.T) for c in covs)
    assert np.abs(logs).max() < 1e-6  # the logarithms at the mean cancel
    back = kernels.power_of(mean, -0.5)
    want = [[kernels.log_of(back @ c @ back)[i, j] for j in range(4) for i in range(j + 1)] for c in covs]
    assert np.allclose([r["features"] for r in bci.riemannian(df).orderBy("trial").collect()], want)


@pytest.mark.parametrize("shrink", [False, True])
@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_discriminant(shrink, scale):
    rng = np.random.default_rng(4)
    x, first = rng.normal(size=(20, 3)) * scale, np.arange(20) < 9
    x[first, 0] += 2 * scale
    sw = sum(np.outer(v - m, v - m) for part in (x[first], x[~first]) for m in [part.mean(0)] for v in part)
    if shrink:
        alpha = min(1, max(0.01, 3 / 20))
        sw = (1 - alpha) * sw + alpha * np.trace(sw) / 3 * np.eye(3)
    w = np.linalg.inv(sw + 1e-6 * np.eye(3)) @ (x[first].mean(0) - x[~first].mean(0))
    m = bci.train_lda(x, first, ("a", "b"), shrink)
    assert np.allclose(m.w, w) and np.isclose(m.threshold, w @ (x[first].mean(0) + x[~first].mean(0)) / 2)


@pytest.mark.parametrize("method", ["lda", "shrinkage_lda"])
@pytest.mark.parametrize("folds", [None, 4])
def test_classification(spark, method, folds):
    """Models of sums over trials equal models of the trials themselves, fold by fold."""
    rng = np.random.default_rng(6)
    n = 30
    x, own = rng.normal(size=(n, 3)) + 100, rng.permutation(n) < 13
    x[own, 1] += 1.5
    labels = {i + 1: "yes" if own[i] else "no" for i in range(n)}
    feats = spark.createDataFrame([(i + 1, x[i].tolist()) for i in range(n)], "trial int, features array<double>").repartition(3)
    out, accuracy = bci.classify(feats, labels, method, folds, seed=3)
    got = {r["trial"]: r for r in out.collect()}
    classes = (labels[1], "no" if labels[1] == "yes" else "yes")
    first = np.array([labels[i + 1] == classes[0] for i in range(n)])
    fold = np.zeros(n, dtype=int)
    if folds:
        rows = bci.folds_of(feats, folds, 3).collect()
        fold[[r["trial"] - 1 for r in rows]] = [r["fold"] for r in rows]
        assert sorted(np.bincount(fold)) == [7, 7, 8, 8]
    for k in range(folds or 1):
        test = fold == k
        train = ~test if folds else test
        m = bci.train_lda(x[train], first[train], classes, method == "shrinkage_lda")
        d = x[test] @ m.w - m.threshold
        for i, v in zip(np.flatnonzero(test), d):
            r = got[i + 1]
            assert r["predicted_class"] == classes[0 if v > 0 else 1] and r["true_class"] == labels[i + 1] and np.isclose(r["confidence"], abs(v) / np.abs(d).max())
    assert np.isclose(accuracy, np.mean([r["predicted_class"] == r["true_class"] for r in got.values()]))
    with pytest.raises(ValueError):
        bci.classify(feats, {k: v for k, v in labels.items() if k != 5}, method)


def test_canonical_correlation(spark):
    rng = np.random.default_rng(5)
    t = np.arange(128) / 128
    x = rng.normal(size=(3, 128, 3))
    x[:, :, 1] += np.sin(2 * np.pi * 10 * t)
    got = {r["frequency"]: r["correlation"] for r in bci.ssvep(samples(spark, x, epoch=True), 128, [8.0, 10.0], 2).collect()}
    mean = x.mean(0)
    for f in (8.0, 10.0):
        ref = np.stack([g(2 * np.pi * f * k * t) for k in (1, 2) for g in (np.sin, np.cos)], axis=1)
        qs = [np.linalg.qr(m - m.mean(0))[0] for m in (mean, ref)]
        assert abs(got[f] - np.linalg.svd(qs[0].T @ qs[1], compute_uv=False).max()) < 1e-4


def test_baseline_of_event_desynchronisation_is_held_above_zero(spark):
    x = np.zeros((1, 64, 1))
    got = bci.motor_imagery(samples(spark, x, epoch=True), 128, baseline_fraction=0.001).collect()
    assert [r["percent"] for r in got] == [-100.0, -100.0]


def test_permutations(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(8, 30, 2)), rng.normal(size=(6, 30, 2))
    a[:, 10:18] += 2
    x, y = samples(spark, a, epoch=True), samples(spark, b, epoch=True)
    data, first = np.concatenate([a.mean(2), b.mean(2)]).T, np.arange(14) < 8
    t = erp._welch(data, first)
    nulls = np.array([erp._welch(data, np.random.default_rng([1, i]).permutation(first)) for i in range(60)])
    p = (1 + (np.abs(nulls) >= np.abs(t)).sum(0)) / 61
    got = erp.permutation_test(x, y, 60).orderBy("time_sample").toPandas()
    assert np.allclose(got.t_statistic, t) and np.allclose(got.p_value, p)
    limit = kernels.t_quantile(0.975, 12)
    found = erp.clusters(t, limit)
    most = np.array([max((abs(c[2]) for c in erp.clusters(z, limit)), default=0.0) for z in nulls])
    got = erp.permutation_test(x, y, 60, method="cluster").orderBy("time_sample").toPandas()
    for k, (low, high, mass) in enumerate(found):
        assert np.allclose(got.cluster_p[low : high + 1], (1 + (most >= abs(mass)).sum()) / 61) and (got.cluster_id[low : high + 1] == k + 1).all()
    assert found and got.cluster_id.notna().sum() == sum(h - low + 1 for low, h, _ in found)
    with pytest.raises(ValueError):
        erp.permutation_test(x, y.where("s < 20"), 10)


def test_channel_correlations_and_rest(spark):
    x = mixed(300, 4)
    df = samples(spark, np.concatenate([x, np.zeros((300, 1))], axis=1))
    got = {r["label"]: r["mean_r"] for r in spatial.mean_correlations(df).collect()}
    r = np.corrcoef(x.T)
    for i in range(4):
        assert np.isclose(got[LABELS[i]], np.delete(r[i], i).mean())
    assert got[LABELS[4]] is None
    pos = electrodes(spark, "10-10").drop("system")
    names = list(SYSTEM_1010)[:4]
    out = dense(spatial.rereference(samples(spark, x, names), "rest", positions=pos.where(F.col("label").isin(names))), 300, 4)
    p = np.array([SYSTEM_1010[k] for k in names])
    w = 1 / np.where((d := np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))) == 0, np.inf, d)
    w /= w.sum(1, keepdims=True)
    assert np.allclose(out, x - x @ w.T)


def test_multitaper_of_odd_length(spark):
    x = mixed(301, 1)
    got = timefreq.multitaper(samples(spark, x), 128).orderBy("freq").toPandas()
    want = (np.abs(np.fft.fft(kernels.dpss(301, 4, 7) * x[:, 0], axis=1)) ** 2).mean(0)[:151] / 128
    assert np.allclose(got.psd, want) and math.isclose(got.freq.iloc[-1], 150 * 128 / 301)
