"""Coupling of channel pairs. Spectra and phases are computed once per channel; channels meet as frames, whose products are summed in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, length_of
from .filtering import fir_filter
from .ica import channels, frames
from .timefreq import window_spectra
from .transform import analytic


def spectra(samples: DataFrame, sr: float, window_sec: float, overlap: float, band: tuple[float, float] | None = None) -> DataFrame:
    """(recording_id, ch, label, win, k, freq, re, im) of Hann windows, unscaled."""
    n = min(round(window_sec * sr), length_of(samples, False))
    n -= n % 2
    return window_spectra(samples, sr, n, max(1, round(n * (1 - overlap))), band=band).drop("epoch")


SUMS = 1 << 22  # numbers a task holds before it hands them on


def frame_of(spec: DataFrame, by: list[str], inner: list[str] | None = None) -> DataFrame:
    """(by…, re, im): arrays over `inner` and channels."""
    order = [*(inner or []), "ch"]
    x = F.array_sort(F.collect_list(F.struct(*order, "re", "im")))
    return spec.groupBy(*by).agg(x.alias("x")).select(*by, F.transform("x", lambda e: e["re"]).alias("re"), F.transform("x", lambda e: e["im"]).alias("im"))


def pair_sums(rows: DataFrame, by: list[str], c: int, products: dict[str, Callable[[np.ndarray], np.ndarray]], diagonal: bool = False) -> DataFrame:
    """(by…, i, j, <product>…, n): sums over rows (by…, re, im) of matrices of channel pairs, i < j from 1.

    A product maps complex numbers (row, bin, channel) to matrices (channel, channel) summed over
    rows. Tasks hold one matrix for each key and product; no row meets another.
    """
    kinds = dict(rows.dtypes)
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[kinds[k]] for k in by]
    first, second = np.triu_indices(c, 0 if diagonal else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for key, (n, *matrices) in sums.items():
                size = len(first)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([k] * size, t) for k, t in zip(key, types)), pa.array(first + 1, pa.int32()), pa.array(second + 1, pa.int32()),
                     *(pa.array(m[first, second]) for m in matrices), pa.array(np.full(size, n))],
                    [*by, "i", "j", *products, "n"],
                )
            sums.clear()

        for b in batches:
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(b.column(i).to_pylist() for i in range(len(by))))):
                places.setdefault(key, []).append(at)
            re, im = b.column(len(by)), b.column(len(by) + 1)
            for key, at in places.items():
                z = re.take(pa.array(at)).flatten().to_numpy() + 1j * im.take(pa.array(at)).flatten().to_numpy()
                if len(z) % (len(at) * c):
                    raise ValueError("an instant lacks channels that others have")
                z = z.reshape(len(at), -1, c)
                held = sums.setdefault(key, [0, *(0.0 for _ in products)])
                held[0] += len(at)
                for i, fn in enumerate(products.values(), 1):
                    held[i] = held[i] + fn(z)
            if len(sums) * len(products) * c * c > SUMS:
                yield from handed_on()
        yield from handed_on()

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "i int", "j int", *(f"{p} double" for p in products), "n long"])
    parts = rows.select(*by, "re", "im").mapInArrow(run, schema)
    return parts.groupBy(*by, "i", "j").agg(*(F.sum(p).alias(p) for p in products), F.sum("n").alias("n"))


def _cross(z: np.ndarray) -> np.ndarray:
    z = z.reshape(-1, z.shape[2])
    return z.T @ z.conj()


def _energy(z: np.ndarray, axis: int) -> np.ndarray:
    e = (np.abs(z) ** 2).sum(axis=(0, 1))
    return np.broadcast_to(np.expand_dims(e, 1 - axis), (len(e), len(e)))


CROSS = {"re": lambda z: _cross(z).real, "im": lambda z: _cross(z).imag, "x": lambda z: _energy(z, 0), "y": lambda z: _energy(z, 1)}


def named(pairs: DataFrame, chans: list[tuple[int, str]], one: str, two: str) -> DataFrame:
    """The labels of places i and j in the order of channels."""
    names = F.array(*[F.lit(label) for _, label in chans])
    return pairs.withColumns({one: F.element_at(names, F.col("i")), two: F.element_at(names, F.col("j"))})


def _check_band(band: tuple[float, float], sr: float) -> None:
    if not band[0] < band[1]:
        raise ValueError("the band is empty")
    if band[1] > sr / 2:
        raise ValueError("band exceeds the Nyquist frequency")


def coherence_spectra(samples: DataFrame, sr: float, method: str = "coherence", window_sec: float = 2, overlap: float = 0.5, band: tuple[float, float] | None = None) -> DataFrame:
    """(recording_id, freq, ch1, ch2, value) for i < j; windows are frames of channels whose cross-spectra are summed by bin."""
    spec, chans = spectra(samples, sr, window_sec, overlap, band), channels(samples)
    p = pair_sums(frame_of(spec, ["recording_id", "win", "k", "freq"]), ["recording_id", "k", "freq"], len(chans), CROSS)
    p = named(p.select("recording_id", "freq", "i", "j", *((F.col(c) / F.col("n")).alias(c) for c in CROSS)), chans, "ch1", "ch2")
    den = F.greatest(F.col("x") * F.col("y"), F.lit(EPS))
    value = {"coherence": (F.col("re") ** 2 + F.col("im") ** 2) / den, "imaginary": F.abs(F.col("im") / F.sqrt(den))}[method]
    return p.select("recording_id", "freq", "ch1", "ch2", value.alias("value"))


def coherence(samples: DataFrame, sr: float, method: str = "coherence", band: tuple[float, float] = (8, 13), window_sec: float = 2, overlap: float = 0.5) -> DataFrame:
    """(recording_id, ch1, ch2, value): mean over the bins of the band."""
    _check_band(band, sr)
    return coherence_spectra(samples, sr, method, window_sec, overlap, band).groupBy("recording_id", "ch1", "ch2").agg(F.avg("value").alias("value"))


def plv(samples: DataFrame, sr: float, band: tuple[float, float] = (8, 13)) -> DataFrame:
    """(recording_id, channel1, channel2, plv): an instant is a frame of unit phasors of the analytic signals."""
    _check_band(band, sr)
    chans = channels(samples)
    z = analytic(fir_filter(samples, "bandpass", sr, *band), length_of(samples, False))
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    unit = z.select("recording_id", "s", "ch", F.when(size > 0, F.col("re") / size).otherwise(1.0).alias("re"), F.when(size > 0, F.col("im") / size).otherwise(0.0).alias("im"))
    p = pair_sums(frame_of(unit, ["recording_id", "s"]), ["recording_id"], len(chans), {"re": CROSS["re"], "im": CROSS["im"]})
    value = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")
    return named(p, chans, "channel1", "channel2").select("recording_id", "channel1", "channel2", value.alias("plv"))


def _lags(z: np.ndarray) -> np.ndarray:
    """(row, channel, channel): imaginary cross-spectra averaged over bins."""
    return (np.einsum("wki,wkj->wij", z, z.conj()) / z.shape[1]).imag


def wpli(samples: DataFrame, sr: float, band: tuple[float, float] = (8, 13), window_sec: float = 2, overlap: float = 0.5) -> DataFrame:
    """(recording_id, channel1, channel2, wpli, wpli_debiased): a window is one frame of its bins and channels."""
    _check_band(band, sr)
    spec, chans = spectra(samples, sr, window_sec, overlap, band), channels(samples)
    rows = frame_of(spec, ["recording_id", "win"], ["k"])
    w = pair_sums(rows, ["recording_id"], len(chans), {"q": lambda z: _lags(z).sum(axis=0), "size": lambda z: np.abs(_lags(z)).sum(axis=0)})
    w = named(w, chans, "channel1", "channel2").withColumns({"num": F.abs(F.col("q") / F.col("n")), "den": F.col("size") / F.col("n")})
    w = w.withColumn("wpli", F.when(F.col("den") < EPS, 0.0).otherwise(F.try_divide("num", "den")))
    debiased = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.try_divide(F.col("n") * F.col("wpli") ** 2 - 1, F.col("n") - 1)))
    return w.select("recording_id", "channel1", "channel2", "wpli", debiased.alias("wpli_debiased"))


LAGS_BLOCK = 1 << 14  # instants whose lagged products a task sums


def lagged_moments(samples: DataFrame, order: int, c: int) -> dict[str, tuple]:
    """By recording: (instants, means, instants with a past, sums, products, instants at the ends).

    Sums and products are those of (x_t, x_{t-1}, …, x_{t-order}) over all t that have
    their past; blocks of instants carry a halo of `order`. The first and the last
    `order` instants give what full-length autocovariances need besides.
    """
    width = c * (order + 1)
    x = frames(samples).select("recording_id", "s", "x")
    block = F.floor((F.col("s") - 1) / LAGS_BLOCK)
    halo = F.floor((F.col("s") - 1 + order) / LAGS_BLOCK)
    dealt = x.select("recording_id", "s", "x", F.explode(F.array_distinct(F.array(block, halo))).alias("block"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("s")
        low = t["block"][0].as_py() * LAGS_BLOCK + 1
        z = t["x"].combine_chunks().flatten().to_numpy().reshape(-1, c)
        keep = int((t["s"].to_numpy() >= low).sum())  # instants of the block itself
        skip = max(0, order - (len(z) - keep))  # those without a past
        own = np.arange(len(z) - keep + skip, len(z))
        u = np.concatenate([z[own - k] for k in range(order + 1)], axis=1) if len(own) else np.zeros((0, width))
        v = np.concatenate([[keep, len(own)], z[len(z) - keep :].sum(axis=0), u.sum(axis=0), (u.T @ u).ravel()])
        return pa.table({"recording_id": t["recording_id"].take(pa.array([0] * len(v))), "i": np.arange(len(v)), "v": v})

    sums = dealt.groupBy("recording_id", "block").applyInArrow(run, "recording_id string, i long, v double").groupBy("recording_id", "i").agg(F.sum("v").alias("v"))
    size = 2 + c + width + width * width
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # a matrix of lagged channels for each recording
        found.setdefault(r["recording_id"], np.zeros(size))[r["i"]] = r["v"]
    sizes = samples.groupBy("recording_id").agg(F.max("s").alias("n"))
    edge = x.join(sizes, "recording_id").where((F.col("s") <= order) | (F.col("s") > F.col("n") - order)).orderBy("s").collect()  # 2 * order instants a recording
    ends = {name: np.array([r["x"] for r in edge if r["recording_id"] == name]) for name in found}
    return {name: (v[0], v[2 : 2 + c] / v[0], v[1], v[2 + c : 2 + c + width], v[2 + c + width :].reshape(width, width), ends[name]) for name, v in found.items()}


def granger_pairs(n: float, mean: np.ndarray, m: float, total: np.ndarray, products: np.ndarray, ends: np.ndarray, order: int, sr: float, band: tuple[float, float] | None, orientation: str) -> np.ndarray:
    """Causality (from, to) of each pair: mean over frequencies of the log ratio of the spectra of `to` alone and with `from`."""
    c = len(mean)
    centre = np.tile(mean, order + 1)
    sums = total - m * centre
    gram = products - np.outer(total, centre) - np.outer(centre, total) + m * np.outer(centre, centre)
    first = ends[:order] - mean
    r = []  # r[k] = sum of z_t z_{t-k}' over t >= k, divided by n
    for k in range(order + 1):
        early = sum((np.outer(first[t], first[t - k]) for t in range(k, order)), np.zeros((c, c)))
        r.append((gram[:c, k * c : (k + 1) * c] + early) / n)
    lags, freqs = np.abs(np.subtract.outer(np.arange(order), np.arange(order))), np.linspace(0, sr / 2, 128)
    wave = np.exp(-2j * np.pi * np.outer(freqs, np.arange(1, order + 1)) / sr)
    use = np.arange(1, 128) if band is None else np.flatnonzero((freqs >= band[0]) & (freqs <= band[1]))
    ridge = lambda x: x + 1e-6 * np.abs(np.diag(x)).max() * np.eye(len(x))
    turn = (lambda x: x.T) if orientation == "forward" else (lambda x: x)  # else time runs backwards

    def spread(at: list[int], weights: np.ndarray) -> float:
        """Variance of z_to less its prediction from lagged rows of the moments."""
        w = np.zeros(c * (order + 1))
        w[at[0]] = 1
        np.subtract.at(w, at[1:], weights)
        return float((w @ gram @ w - (w @ sums) ** 2 / m) / (m - 1))

    out = np.zeros((c, c))
    for i in range(c):
        for j in range(c):
            if i == j:
                continue
            q = [x[np.ix_([i, j], [i, j])] for x in r]
            big = np.block([[turn(q[a - b]) if a >= b else turn(q[b - a]).T for b in range(order)] for a in range(order)])
            right = np.concatenate([turn(q[k])[:, 1] for k in range(1, order + 1)])
            own = np.array([x[1, 1] for x in q])
            try:
                both, one = np.linalg.solve(ridge(big), right).reshape(order, 2), np.linalg.solve(ridge(own[lags]), own[1:])
            except np.linalg.LinAlgError:
                both, one = np.zeros((order, 2)), np.zeros(order)
            past = [[k * c + i, k * c + j] for k in range(1, order + 1)]
            full_var = spread([j, *(x for p in past for x in p)], both.ravel())
            one_var = spread([j, *(p[1] for p in past)], one)
            s_one, s_full = one_var / np.abs(1 - wave @ one) ** 2, full_var / np.abs(1 - wave @ both[:, 1]) ** 2
            ok = (s_one > EPS) & (s_full > EPS)
            gain = np.maximum(0, np.log(np.where(ok, s_one, 1) / np.where(ok, s_full, 1)))
            out[i, j] = gain[use].mean() if len(use) else 0.0
    return out


def granger(samples: DataFrame, sr: float, order: int = 5, band: tuple[float, float] | None = None, orientation: str = "forward") -> DataFrame:
    """(recording_id, from_channel, to_channel, gc_value) for all ordered pairs; signals meet the driver as lagged moments."""
    if order < 1 or 2 * order + 1 >= length_of(samples, False):
        raise ValueError("model order is too long for the signal")
    chans = channels(samples)
    rows = []
    for name, moments in lagged_moments(samples, order, len(chans)).items():
        g = granger_pairs(*moments, order, sr, band, orientation)
        rows += [(name, a, b, float(g[i, j])) for i, (_, a) in enumerate(chans) for j, (_, b) in enumerate(chans) if i != j]
    return samples.sparkSession.createDataFrame(rows, "recording_id string, from_channel string, to_channel string, gc_value double")


def connectivity_matrix(samples: DataFrame, sr: float, method: str = "coherence", band: tuple[float, float] = (8, 13), **options) -> DataFrame:
    """(recording_id, a, b, value): symmetric, 1 on the diagonal."""
    if method == "coherence":
        p = coherence(samples, sr, "coherence", band, **options).withColumnsRenamed({"ch1": "a", "ch2": "b"})
    elif method == "plv":
        p = plv(samples, sr, band).withColumnsRenamed({"channel1": "a", "channel2": "b", "plv": "value"})
    elif method == "wpli":
        p = wpli(samples, sr, band, **options).withColumnsRenamed({"channel1": "a", "channel2": "b", "wpli": "value"})
    else:
        raise ValueError(f"unknown method {method!r}")
    p = p.select("recording_id", "a", "b", "value")
    same = samples.select("recording_id", F.col("label").alias("a"), F.col("label").alias("b")).distinct().withColumn("value", F.lit(1.0))
    return p.union(p.select("recording_id", F.col("b").alias("a"), F.col("a").alias("b"), "value")).union(same)
