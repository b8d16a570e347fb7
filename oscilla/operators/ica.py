"""Independent components. Signals meet the driver only as moments: channels by channels, or components to the fourth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS
from ..functions.kernels import jade, orthogonal

FRONTAL = ["Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8"]


def frames(samples: DataFrame) -> DataFrame:
    """(recording_id, epoch, s, x array<double> in order of ch)."""
    x = F.array_sort(F.collect_list(F.struct("ch", "v")))
    return samples.groupBy("recording_id", "epoch", "s").agg(F.transform(x, lambda e: e["v"]).alias("x"))


def partial_sums(rows: DataFrame, fn, size: int, by: list[str] | None = None) -> DataFrame:
    """Sum fn(matrix of the partition's x) over partitions, element by element: (by…, i, v)."""
    by = by or []

    def run(it):
        sums: dict[tuple, np.ndarray] = {}
        for b in it:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))))) or [()] * b.num_rows
            x = b.column(len(by)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for k, at in places.items():
                sums[k] = sums.get(k, 0) + fn(x[at])
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([a] * size, t) for a, t in zip(k, types)), pa.array(np.arange(size)), pa.array(np.asarray(v, dtype=float).ravel())], [*by, "i", "v"])

    kinds = dict(rows.dtypes)
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kinds[k]] for k in by]
    schema = "".join(f"{k} {kinds[k]}, " for k in by) + "i long, v double"
    return rows.select(*by, "x").mapInArrow(run, schema).groupBy(*by, "i").agg(F.sum("v").alias("v"))


def collect_sums(rows: DataFrame, fn, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in partial_sums(rows, fn, size).collect():  # `size` numbers
        out[r["i"]] = r["v"]
    return out


def moments(rows: DataFrame, c: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, covariance)."""
    got = collect_sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + c + c * c)
    n, mean = got[0], got[1 : c + 1] / max(got[0], 1)
    return n, mean, (got[c + 1 :].reshape(c, c) - n * np.outer(mean, mean)) / max(n - 1, 1)


def channels(samples: DataFrame) -> list[tuple[int, str]]:
    return [(r["ch"], r["label"]) for r in samples.select("ch", "label").distinct().orderBy("ch").collect()]


def covariance(samples: DataFrame) -> tuple[np.ndarray, list[int]]:
    chans = [c for c, _ in channels(samples)]
    return moments(frames(samples), len(chans))[2], chans


@dataclass
class Mixing:
    """mixing (channel, component), unmixing (component, channel), channel means, whitening matrix."""

    mixing: np.ndarray
    unmixing: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    method: str
    channels: list[tuple[int, str]]


def _natural_step(w: np.ndarray, slope: np.ndarray, rate: float = 0.01) -> np.ndarray:
    """Natural-gradient ascent, scaled to spectral norm 1, with unit rows."""
    moved = w + rate * (w + slope @ w)
    moved = moved / np.linalg.norm(moved, 2)
    size = np.linalg.norm(moved, axis=1, keepdims=True)
    return moved / np.where(size < EPS, 1, size)


def fit(samples: DataFrame, n_components: int | None = None, method: str = "fastica", max_iter: int = 200, tol: float = 1e-6, seed: int = 1, angle: str = "optimal") -> Mixing:
    """fastica, infomax or jade; `angle` is that of jade's turns ("reference": twice the optimum, as in other software)."""
    chans = channels(samples)
    c = len(chans)
    p = n_components or c
    if p > c:
        raise ValueError("n_components exceeds the number of channels")
    rows = frames(samples).select("x").persist()
    try:
        n, mean, cov = moments(rows, c)
        values, vectors = np.linalg.eigh(cov)
        top = np.argsort(-values)[:p]
        d, v = np.maximum(values[top], EPS), vectors[:, top]
        whiten, back = (v / np.sqrt(d)).T, v * np.sqrt(d)
        white = lambda x: (x - mean) @ whiten.T
        w = orthogonal(np.random.default_rng(seed).normal(size=(p, p)))
        if method == "jade":
            m4 = collect_sums(rows, lambda x: np.einsum("ti,tj,tk,tl->ijkl", *[white(x)] * 4, optimize=True), p**4) / n
            w = jade(m4.reshape(p, p, p, p), tol, max_iter, angle)
        elif method == "fastica":
            for _ in range(max_iter):
                # one pass: E[x g(wx)] and E[g'(wx)]
                def step(x, w=w):
                    z = white(x)
                    g = np.tanh(z @ w.T)
                    return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(axis=0)])

                got = collect_sums(rows, step, p * p + p) / n
                new = orthogonal(got[: p * p].reshape(p, p) - got[p * p :, None] * w)
                done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < tol
                w = new
                if done:
                    break
        elif method == "infomax":
            for _ in range(max_iter):
                def slope(x, w=w):
                    u = white(x) @ w.T
                    return (-np.tanh(u / 2).T @ u).ravel()

                turned = _natural_step(w, collect_sums(rows, slope, p * p).reshape(p, p) / n)
                still = np.abs((turned * w).sum(axis=1))
                w = turned
                if np.abs(still - 1).max() < tol:
                    break
            w = orthogonal(w)
        else:
            raise ValueError(f"unknown method {method!r}")
    finally:
        rows.unpersist()
    return Mixing(back @ w.T, w @ whiten, mean, whiten, method, chans)


def project(samples: DataFrame, weights: np.ndarray, chans: list[tuple[int, str]], offset: np.ndarray | None = None) -> DataFrame:
    """(recording_id, epoch, s, component, v) = weights @ (x - offset): one matrix product for each batch of instants."""
    off = np.zeros(len(chans)) if offset is None else offset
    c, p = len(chans), len(weights)
    rows = frames(samples.where(F.col("ch").isin([int(ch) for ch, _ in chans])))

    def run(it):
        for batch in it:
            step = max(1, (1 << 20) // p)  # about a million numbers at once
            for b in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                x = b.column(3).flatten().to_numpy(zero_copy_only=False)
                if len(x) != c * b.num_rows:
                    raise ValueError("an instant lacks channels that others have")
                y = (x.reshape(-1, c) - off) @ weights.T
                at = pa.array(np.repeat(np.arange(b.num_rows), p))
                component = pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), component, pa.array(y.ravel())], ["recording_id", "epoch", "s", "component", "v"])

    return rows.mapInArrow(run, "recording_id string, epoch int, s long, component int, v double")


def mixing_table(spark, model: Mixing) -> DataFrame:
    """(component, ch, label, w, unmixing, mean) of a fitted model."""
    rows = [(i + 1, int(ch), label, float(model.mixing[j, i]), float(model.unmixing[i, j]), float(model.mean[j])) for i in range(len(model.unmixing)) for j, (ch, label) in enumerate(model.channels)]
    return spark.createDataFrame(rows, "component int, ch int, label string, w double, unmixing double, mean double")


def sources(samples: DataFrame, model: Mixing) -> DataFrame:
    return project(samples, model.unmixing, model.channels, model.mean)


def remove(samples: DataFrame, model: Mixing, components: list[int]) -> DataFrame:
    """Samples without the components (1-based)."""
    kept = model.mixing.copy()
    kept[:, [c - 1 for c in components]] = 0
    names = [(int(ch), lab, float(m), i + 1) for i, ((ch, lab), m) in enumerate(zip(model.channels, model.mean))]
    t = F.broadcast(samples.sparkSession.createDataFrame(names, "ch int, label string, m double, component int"))
    out = project(samples, kept @ model.unmixing, model.channels, model.mean).join(t, "component")
    return out.select("recording_id", "epoch", "s", "ch", "label", (F.col("v") + F.col("m")).alias("v"))


def detect(samples: DataFrame, model: Mixing, method: str = "correlation", threshold: float = 0.3) -> DataFrame:
    """(component, type, method, score)."""
    spark = samples.sparkSession
    if method == "spatial":
        a = np.abs(model.mixing)
        score, at = a.max(axis=0) / np.maximum(a.sum(axis=0), EPS), a.argmax(axis=0)
        rows = [(i + 1, "artifact" if model.channels[at[i]][1] in ("Fp1", "Fp2") else "neural", method, float(score[i])) for i in range(a.shape[1])]
        return spark.createDataFrame(rows, "component int, type string, method string, score double")
    x = sources(samples, model)
    if method == "kurtosis":
        out = x.groupBy("component").agg(F.coalesce(F.kurtosis("v"), F.lit(0.0)).alias("score"))
        bad = (F.col("score") > 5) | (F.col("score") < -1)
    elif method == "correlation":
        eye = samples.where(F.col("label").isin(FRONTAL)).select("recording_id", "epoch", "s", "label", F.col("v").alias("y"))
        j = x.join(eye, [x["recording_id"] == eye["recording_id"], x["s"] == eye["s"], x["epoch"].eqNullSafe(eye["epoch"])])
        r = j.groupBy("component", "label").agg(F.abs(F.try_divide(F.covar_samp("v", "y"), F.sqrt(F.var_samp("v") * F.var_samp("y")))).alias("r"))
        every = spark.range(1, len(model.unmixing) + 1).select(F.col("id").cast("int").alias("component"))
        out = every.join(r.groupBy("component").agg(F.max("r").alias("score")), "component", "left").fillna(0.0, ["score"])
        bad = F.col("score") > threshold
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select("component", F.when(bad, "artifact").otherwise("neural").alias("type"), F.lit(method).alias("method"), "score")
