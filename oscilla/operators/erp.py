"""Event-related potentials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_max, length_of, ms_window, only
from ..functions.kernels import t_quantile

# Component windows in ms and polarity.
COMPONENTS = {
    "N100": ((80, 150), -1), "P300": ((250, 500), 1), "N400": ((300, 500), -1),
    "P600": ((500, 800), 1), "MMN": ((100, 250), -1), "LPP": ((400, 800), 1),
}
BY = ["recording_id", "ch", "label"]


def average(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return samples.groupBy(*BY, *(extra or []), "s").agg(F.avg("v").alias("v"))


def _cut(samples: DataFrame, window: tuple[float, float], sr: float, epoch_start: float, epochs: bool | None = None) -> tuple[int, int, int]:
    n = length_of(samples, epochs)
    a, b = ms_window(window, sr, epoch_start)
    if a > n:
        raise ValueError("window lies outside the epoch")
    return a, min(b, n), n


def _latency(s: str, sr: float, epoch_start: float) -> Column:
    return (F.col(s) - 1) / sr * 1000 + epoch_start


def detect(samples: DataFrame, sr: float, component: str = "P300", channels: list[str] | None = None, epoch_start: float = 0.0) -> DataFrame:
    """(recording_id, channel, component, latency_ms, amplitude) of the first extreme of the component's window."""
    window, sign = COMPONENTS[component]
    a, b, _ = _cut(samples, window, sr, epoch_start, True)
    m = average(only(samples, channels).where(F.col("s").between(a, b)))
    m = m.groupBy(*BY).agg(first_max(F.col("v") * sign).alias("peak"), (F.max(F.col("v") * sign) * sign).alias("amplitude"))
    return m.select("recording_id", F.col("label").alias("channel"), F.lit(component).alias("component"), _latency("peak", sr, epoch_start).alias("latency_ms"), "amplitude")


def measure(samples: DataFrame, sr: float, window: tuple[float, float], method: str = "peak", polarity: str = "positive", channels: list[str] | None = None, epoch_start: float = 0.0) -> DataFrame:
    """(recording_id, channel, amplitude, latency_ms, method): peak, mean or adaptive_mean."""
    a, b, n = _cut(samples, window, sr, epoch_start)
    sign = 1 if polarity == "positive" else -1
    m = average(only(samples, channels))
    inside = m.where(F.col("s").between(a, b))
    if method == "mean":
        out = inside.groupBy(*BY).agg(F.avg("v").alias("amplitude")).withColumn("latency_ms", F.lit((window[0] + window[1]) / 2.0))
    else:
        out = inside.groupBy(*BY).agg(first_max(F.col("v") * sign).alias("peak"), (F.max(F.col("v") * sign) * sign).alias("amplitude"))
        out = out.withColumn("latency_ms", _latency("peak", sr, epoch_start))
        if method == "adaptive_mean":
            half = round(25 / 1000 * sr)
            around = F.explode(F.sequence(F.greatest(F.col("peak") - half, F.lit(1)), F.least(F.col("peak") + half, F.lit(n))))
            at = out.select(*BY, "latency_ms", around.alias("s"))
            out = at.join(m, [*BY, "s"]).groupBy(*BY, "latency_ms").agg(F.avg("v").alias("amplitude"))
        elif method != "peak":
            raise ValueError(f"unknown method {method!r}")
    return out.select("recording_id", F.col("label").alias("channel"), "amplitude", "latency_ms", F.lit(method).alias("method"))


def latency(samples: DataFrame, sr: float, window: tuple[float, float], fraction: float = 0.5, polarity: str = "positive", channels: list[str] | None = None, epoch_start: float = 0.0) -> DataFrame:
    """(recording_id, channel, latency_ms, fraction): first sample with that part of the rectified area."""
    a, b, _ = _cut(samples, window, sr, epoch_start, True)
    sign = 1 if polarity == "positive" else -1
    m = average(only(samples, channels).where(F.col("s").between(a, b))).withColumn("v", F.greatest(F.col("v") * sign, F.lit(0.0)))
    w = Window.partitionBy(*BY)
    m = m.withColumns({"cum": F.sum("v").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("v").over(w)})
    hit = F.min(F.when((F.col("total") > 0) & (F.col("cum") >= F.col("total") * fraction), F.col("s")))
    m = m.groupBy(*BY).agg(hit.alias("hit"))
    ms = F.coalesce(_latency("hit", sr, epoch_start), F.lit((window[0] + window[1]) / 2.0))
    return m.select("recording_id", F.col("label").alias("channel"), ms.alias("latency_ms"), F.lit(float(fraction)).alias("fraction"))


def difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """x - y, sample by sample; a sample that only one of them has is an error when the result is read."""
    key = ["recording_id", "epoch", "s", "ch"]
    b = y.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("v").alias("_v"), F.lit(True).alias("_there"))
    a = x.select(*key, "label", "v", F.lit(True).alias("_here"))
    on = [a[k].eqNullSafe(b[f"_{k}"]) if k == "epoch" else a[k] == b[f"_{k}"] for k in key]
    alone = F.raise_error(F.lit("dimensions differ")).cast("double")
    value = F.when(F.col("_here").isNull() | F.col("_there").isNull(), alone).otherwise(F.col("v") - F.col("_v"))
    return a.join(b, on, "full").select(*key, "label", value.alias("v"))


def baseline(samples: DataFrame, sr: float, window: tuple[float, float] = (-200, 0), epoch_start: float = 0.0) -> DataFrame:
    if window[0] >= window[1]:
        raise ValueError("bad baseline")
    length_of(samples, True)
    a, b = ms_window(window, sr, epoch_start)
    mean = F.avg(F.when(F.col("s").between(a, b), F.col("v"))).over(Window.partitionBy("recording_id", "epoch", "ch"))
    return samples.withColumn("v", F.col("v") - mean)


def grand_average(frames: list[DataFrame]) -> DataFrame:
    if len(frames) < 2:
        raise ValueError("at least two inputs are needed")
    cols = ["recording_id", "epoch", "s", "ch", "label", "v"]
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    out = out.groupBy("epoch", "s", "ch", "label").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    if not out.where(F.col("n") % len(frames) != 0).isEmpty():
        raise ValueError("dimensions differ")
    return out.drop("n")


def welch_t(x: DataFrame, y: DataFrame) -> DataFrame:
    """(time_sample, t_statistic) of channel means, over epochs; 0 where the error is 0."""
    side = lambda d, name: d.groupBy("epoch", "s").agg(F.avg("v").alias("v")).groupBy("s").agg(F.avg("v").alias(f"m{name}"), F.var_samp("v").alias(f"q{name}"), F.count(F.lit(1)).alias(f"n{name}"))
    j = side(x, "x").join(side(y, "y"), "s")
    se = F.sqrt(F.col("qx") / F.col("nx") + F.col("qy") / F.col("ny"))
    return j.select(F.col("s").alias("time_sample"), F.when(se > 0, F.try_divide(F.col("mx") - F.col("my"), se)).otherwise(0.0).alias("t_statistic"))


def _welch(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    x, y = data[:, first], data[:, ~first]
    se = np.sqrt(x.var(axis=1, ddof=1) / x.shape[1] + y.var(axis=1, ddof=1) / y.shape[1])
    return np.divide(x.mean(axis=1) - y.mean(axis=1), se, out=np.zeros(len(data)), where=se > 0)


def clusters(t: np.ndarray, limit: float) -> list[tuple[int, int, float]]:
    """Runs of |t| above the limit, whatever their sign: (first, last, sum of t)."""
    hot = np.concatenate([[False], np.abs(t) > limit, [False]])
    edge = np.flatnonzero(hot[1:] != hot[:-1])
    return [(a, b - 1, float(t[a:b].sum())) for a, b in zip(edge[::2], edge[1::2])]


def permutation_test(x: DataFrame, y: DataFrame, n_perm: int = 1000, alpha: float = 0.05, method: str = "permutation", cluster_alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(time_sample, t_statistic, p_value, significant[, cluster_id, cluster_p]) of two conditions.

    A task holds one sample of all channel-averaged epochs and draws every permutation
    for it from (seed, permutation), so that all samples see the same ones. Only a
    sample's counts, or a permutation's largest cluster, are summed up.
    """
    mean = lambda d, first: d.groupBy("epoch", "s").agg(F.avg("v").alias("v")).withColumn("first", F.lit(first))
    both = mean(x, True).unionByName(mean(y, False))
    sizes = both.groupBy("s").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b"), F.count_if(F.col("epoch").isNull()).alias("c")).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.max("c")).first()
    if sizes[0] != sizes[1] or sizes[2] != sizes[3] or not sizes[0] or not sizes[2]:
        raise ValueError("dimensions differ")
    if sizes[4]:
        raise ValueError("a continuous recording has no epochs")
    spark, df = x.sparkSession, sizes[0] + sizes[2] - 2

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["first", "epoch"], ascending=[False, True])
        data, first = p.v.to_numpy()[None], p["first"].to_numpy()
        null = np.array([_welch(data, np.random.default_rng([seed, i]).permutation(first))[0] for i in range(n_perm)])
        t = _welch(data, first)[0]
        return pd.DataFrame({"s": [p.s.iloc[0]], "t": [t], "hits": [int((np.abs(null) >= abs(t)).sum())], "null": [null if method == "cluster" else []]})

    each = both.groupBy("s").applyInPandas(run, "s long, t double, hits long, null array<double>").persist()
    try:
        rows = each.select("s", "t", "hits").orderBy("s").collect()  # the samples of an epoch
        t = np.array([r["t"] for r in rows])
        if method == "permutation":
            p = [(r["hits"] + 1) / (n_perm + 1) for r in rows]
            out = [(i + 1, float(t[i]), p[i], p[i] < alpha) for i in range(len(t))]
            return spark.createDataFrame(out, "time_sample int, t_statistic double, p_value double, significant boolean")
        limit = t_quantile(1 - cluster_alpha / 2, df)
        found = clusters(t, limit)
        seen = np.array([abs(c[2]) for c in found])

        def largest(p: pd.DataFrame) -> pd.DataFrame:
            most = max((abs(c[2]) for c in clusters(p.sort_values("s").t.to_numpy(), limit)), default=0.0)
            return pd.DataFrame({"k": np.flatnonzero(most >= seen)}, dtype="int64")

        null = each.select("s", F.posexplode("null").alias("perm", "t"))
        counts = dict(null.groupBy("perm").applyInPandas(largest, "k long").groupBy("k").count().collect())
    finally:
        each.unpersist()
    own = {i: k for k, (a, b, _) in enumerate(found) for i in range(a, b + 1)}
    out = []
    for i in range(len(t)):
        p = (counts.get(own[i], 0) + 1) / (n_perm + 1) if i in own else 1.0
        out.append((i + 1, float(t[i]), p, p < alpha, own[i] + 1 if i in own else None, p if i in own else None))
    return spark.createDataFrame(out, "time_sample int, t_statistic double, p_value double, significant boolean, cluster_id int, cluster_p double")
