"""Forward models and inverse estimates. Kernels are small matrices; signals are projected as rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, length_of
from ..sources.electrodes import FORWARD_1020
from .connectivity import CROSS, frame_of, pair_sums
from .ica import channels, covariance, partial_sums, project
from .transform import spectrum

# Conductivity, and weights and places of the virtual dipoles of the three-shell model.
SIGMA = 0.33
DIPOLES = {"mu": (0.332, 0.408, -0.74), "lambda": (0.5401, 0.806, 1.0)}
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 50)}


@dataclass
class Forward:
    leadfield: np.ndarray  # (electrode, 3 * source)
    sources: np.ndarray
    electrodes: list[tuple[str, float, float, float]]
    method: str


def electrode_places(labels: list[str], positions: dict[str, tuple[float, float, float]] | None = None) -> list[tuple[str, float, float, float]]:
    """Given positions, else the default table by label, else its first rows, else a ring for what is left."""
    table = positions or FORWARD_1020
    if all(x in table for x in labels):
        return [(x, *table[x]) for x in labels]
    rows = [(x, *p) for x, p in FORWARD_1020.items()][: len(labels)]
    extra = len(labels) - len(rows)
    for i in range(extra):
        theta, phi = 2 * np.pi * i / extra, 0.3 + (0.5 * i / (extra - 1) if extra > 1 else 0)
        rows.append((f"E{i + 1}", float(np.sin(phi) * np.cos(theta)), float(np.sin(phi) * np.sin(theta)), float(np.cos(phi))))
    return rows


def source_grid(n_sources: int = 500, seed: int = 42) -> np.ndarray:
    """Uniform in the ball of radius 0.8."""
    rng = np.random.default_rng(seed)
    theta, phi, r = rng.uniform(0, 2 * np.pi, n_sources), np.arccos(rng.uniform(-1, 1, n_sources)), 0.8 * rng.uniform(size=n_sources) ** (1 / 3)
    return np.stack([r * np.sin(phi) * np.cos(theta), r * np.sin(phi) * np.sin(theta), r * np.cos(phi)], axis=1)


def leadfield(places: np.ndarray, sources: np.ndarray, method: str = "spherical") -> np.ndarray:
    shells = zip(*DIPOLES.values()) if method == "bem_simplified" else [(1.0, 1.0)]
    total = 0.0
    for weight, scale in shells:
        d = places[:, None, :] - scale * sources[None, :, :]
        far = np.maximum(np.sqrt((d**2).sum(axis=2, keepdims=True)), 1e-10)
        total = total + weight * d / (4 * np.pi * SIGMA * far**3)
    return total.reshape(len(places), -1)


def forward_model(labels: list[str], method: str = "spherical", n_sources: int = 500, positions: dict | None = None, sources: np.ndarray | None = None, seed: int = 42) -> Forward:
    if method not in ("spherical", "bem_simplified"):
        raise ValueError(f"unknown method {method!r}")
    grid = source_grid(n_sources, seed) if sources is None else sources
    places = electrode_places(labels, positions)
    return Forward(leadfield(np.array([p[1:] for p in places]), grid, method), grid, places, method)


def leadfield_table(electrodes: DataFrame, sources: DataFrame, method: str = "spherical") -> DataFrame:
    """(label, source, axis, value) in SQL: electrodes (label, x, y, z) by sources (source, x, y, z)."""
    shells = list(zip(*DIPOLES.values())) if method == "bem_simplified" else [(1.0, 1.0)]
    e = electrodes.select("label", *[F.col(c).alias(f"e{c}") for c in "xyz"])
    s = sources.select("source", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    j = s.crossJoin(F.broadcast(e))  # as many electrodes as a cap has
    parts = {}
    for axis in "xyz":
        total = F.lit(0.0)
        for w, k in shells:
            far = F.greatest(F.sqrt(sum(((F.col(f"e{c}") - k * F.col(f"s{c}")) * (F.col(f"e{c}") - k * F.col(f"s{c}")) for c in "xyz"), F.lit(0.0))), F.lit(1e-10))
            total = total + w * (F.col(f"e{axis}") - k * F.col(f"s{axis}")) / (4 * np.pi * SIGMA * far * far * far)
        parts[axis] = total
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), v.alias("value")) for a, v in parts.items()])).alias("c")
    return j.select("label", "source", cells).select("label", "source", "c.axis", "c.value")


def inverse_kernel(lf: np.ndarray, method: str = "sloreta", lam: float = 0.05) -> np.ndarray:
    n = len(lf)

    def solve(gram: np.ndarray) -> np.ndarray:
        m = gram + lam * np.eye(n)
        return np.linalg.inv(m if 1 / np.linalg.cond(m, 1) >= EPS else m + 9 * lam * np.eye(n))

    if method in ("mne", "sloreta"):
        k = lf.T @ solve(lf @ lf.T)
        if method == "mne":
            return k
        r = np.abs(np.einsum("ij,ji->i", k, lf))
        return k / np.sqrt(np.maximum(r, 1e-20))[:, None]
    if method != "eloreta":
        raise ValueError(f"unknown method {method!r}")
    w = np.ones(lf.shape[1])
    for _ in range(20):
        r = np.einsum("ij,ji->i", lf.T @ solve((lf * w) @ lf.T), lf) * w
        new = 1 / np.sqrt(np.maximum(np.abs(r), 1e-20))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:, None] * (lf.T @ solve((lf * w) @ lf.T))


def estimate(samples: DataFrame, model: Forward, method: str = "sloreta", lam: float = 0.05) -> DataFrame:
    """(recording_id, epoch, s, source_col, v)."""
    return project(samples, inverse_kernel(model.leadfield, method, lam), channels(samples)).withColumnRenamed("component", "source_col")


def _beam(cov: np.ndarray, lf: np.ndarray) -> np.ndarray:
    """Largest w' C w of each source's three directions; only the inverse is ridged, and directions without gain are left out."""
    inv = np.linalg.inv(cov + 1e-6 * np.eye(len(cov)))
    w = inv @ lf
    gain = (lf * w).sum(axis=0)
    use = np.abs(gain) >= 1e-20
    power = np.divide(((cov @ w) * w).sum(axis=0), gain**2, out=np.zeros(len(gain)), where=use)
    return np.maximum(power, 0).reshape(-1, 3).max(axis=1)


def beamformer(samples: DataFrame, model: Forward, method: str = "lcmv", sr: float | None = None, freq_range: tuple[float, float] = (8, 13)) -> DataFrame:
    """(source, power)."""
    cov, _ = covariance(samples)
    if method == "dics":
        cov = cross_spectrum(samples, sr, freq_range, cov)
    elif method != "lcmv":
        raise ValueError(f"unknown method {method!r}")
    power = _beam(cov, model.leadfield)
    return samples.sparkSession.createDataFrame([(i + 1, float(p)) for i, p in enumerate(power)], "source int, power double")


def cross_spectrum(samples: DataFrame, sr: float, freq_range: tuple[float, float], fallback: np.ndarray) -> np.ndarray:
    """Real part of the cross-spectral density averaged over the bins, or the fallback if there are none."""
    n = length_of(samples)
    step = sr / 2 / max(1, n // 2)  # bins are laid out evenly up to half the rate
    low, high = math.ceil(freq_range[0] / step), min(n // 2, math.floor(freq_range[1] / step))
    if low > high:
        return fallback
    rows = frame_of(spectrum(samples, n, low, high), ["recording_id", "epoch", "k"]).withColumn("all", F.lit(1))
    sums = pair_sums(rows, ["all"], len(fallback), {"re": CROSS["re"]}, diagonal=True)
    out = np.zeros_like(fallback)
    for r in sums.collect():  # channels by channels
        out[r["i"] - 1, r["j"] - 1] = out[r["j"] - 1, r["i"] - 1] = r["re"] / r["n"]
    return out


def source_power(samples: DataFrame, model: Forward, sr: float, bands: dict | None = None, method: str = "sloreta", lam: float = 0.05) -> DataFrame:
    """(source_id, band, power) of every source column; the transform is taken on channels and then projected, which commutes."""
    kernel, n = inverse_kernel(model.leadfield, method, lam), length_of(samples)
    ranges = (bands or BANDS).values()
    low, high = max(0, math.floor(min(a for a, _ in ranges) * n / sr)), min(n // 2, math.ceil(max(b for _, b in ranges) * n / sr))
    table = F.broadcast(samples.sparkSession.createDataFrame([(b, float(x), float(y)) for b, (x, y) in (bands or BANDS).items()], "band string, low double, high double"))
    spec = spectrum(samples, n, min(low, high), high).select("ch", (F.col("k") * sr / n).alias("freq"), *((F.col(c) / math.sqrt(n)).alias(c) for c in ("re", "im")))
    spec = spec.join(table, F.expr("freq BETWEEN low AND high"))
    x = F.array_sort(F.collect_list(F.struct("ch", "re", "im")))
    rows = spec.groupBy("band", "freq").agg(x.alias("x")).select("band", F.flatten(F.transform("x", lambda e: F.array(e["re"], e["im"]))).alias("x"))

    def power(x: np.ndarray) -> np.ndarray:
        z = x.reshape(len(x), -1, 2)
        return ((z[:, :, 0] @ kernel.T) ** 2 + (z[:, :, 1] @ kernel.T) ** 2).sum(axis=0)

    sums = partial_sums(rows, power, len(kernel), ["band"])
    return sums.select((F.col("i") + 1).cast("int").alias("source_id"), "band", F.col("v").alias("power"))
