"""Montage, re-referencing, channel quality and interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import spline_weights
from ..sources.electrodes import electrodes
from .ica import channels, frames, partial_sums, project

INSTANT = ["recording_id", "epoch", "s"]


def montage(names: DataFrame, system: str = "10-20", positions: DataFrame | None = None) -> DataFrame:
    """names (…, label) with pos_x, pos_y, pos_z of the site of the same name, letter case aside.

    The first of equal names in the table wins; unknown sites get nulls; none at all is an error.
    """
    table = positions if system == "custom" else electrodes(names.sparkSession, system)
    if table is None:
        raise ValueError("a custom montage needs positions")
    table = table.select(F.upper("label").alias("_site"), "pos_x", "pos_y", "pos_z").dropDuplicates(["_site"])
    out = names.drop("pos_x", "pos_y", "pos_z").withColumn("_site", F.upper("label")).join(F.broadcast(table), "_site", "left").drop("_site")
    if out.where("pos_x is not null").isEmpty():
        raise ValueError("no channel label matches the montage")
    return out


def _minus(samples: DataFrame, weight: Column) -> DataFrame:
    ref = F.avg(F.when(weight, F.col("v"))).over(Window.partitionBy(*INSTANT))
    return samples.withColumn("v", F.col("v") - ref)


def rereference(samples: DataFrame, ref_type: str = "average", refs: list[str] | None = None, exclude: list[str] | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Subtract a reference from every channel: average, channel, mastoids, cz or rest."""
    label = F.col("label")
    if ref_type == "average":
        if exclude and samples.where(~label.isin(exclude)).isEmpty():
            raise ValueError("all channels are excluded")
        return _minus(samples, ~label.isin(exclude) if exclude else F.lit(True))
    if ref_type == "rest":
        if positions is None:
            raise ValueError("rest needs electrode positions")
        weights = {(r["dst"], r["src"]): r["w"] for r in distance_weights(positions, positions, floor=None).collect()}  # electrodes by electrodes
        placed = {dst for dst, _ in weights}
        chans = [(ch, name) for ch, name in channels(samples) if name in placed]
        m = np.array([[float(a == b) - weights.get((a, b), 0.0) for _, b in chans] for _, a in chans])
        names = F.broadcast(samples.sparkSession.createDataFrame([(i + 1, int(ch), name) for i, (ch, name) in enumerate(chans)], "component int, ch int, label string"))
        return project(samples, m, chans).join(names, "component").select("recording_id", "epoch", "s", "ch", "label", "v")
    if ref_type == "mastoids":
        present = {r[0] for r in samples.select("label").distinct().collect()}  # the channels of the montage
        refs = next((list(p) for p in (("M1", "M2"), ("A1", "A2"), ("TP9", "TP10")) if set(p) <= present), None)
        if not refs:
            raise ValueError("no complete pair of mastoid channels")
    elif ref_type == "cz":
        refs = ["Cz"]
    elif ref_type != "channel":
        raise ValueError(f"unknown reference {ref_type!r}")
    if not refs or samples.where(label.isin(refs)).isEmpty():
        raise ValueError("reference channels not found")
    return _minus(samples, label.isin(refs))


def distance_weights(targets: DataFrame, sources: DataFrame, floor: float | None) -> DataFrame:
    """(dst, src, w): inverse-distance weights of sources for each target, summing to 1; floor None leaves the target itself out."""
    a = targets.select(F.col("label").alias("dst"), F.col("pos_x").alias("x1"), F.col("pos_y").alias("y1"), F.col("pos_z").alias("z1"))
    b = sources.select(F.col("label").alias("src"), F.col("pos_x").alias("x2"), F.col("pos_y").alias("y2"), F.col("pos_z").alias("z2"))
    pairs = a.crossJoin(F.broadcast(b))  # electrodes by electrodes
    if floor is None:
        pairs = pairs.where("dst <> src")
    d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2) + F.pow(F.col("z1") - F.col("z2"), 2))
    pairs = pairs.withColumn("w", 1.0 / F.greatest(d, F.lit(floor or 1e-10)))
    return pairs.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dst"))).select("dst", "src", "w")


def interpolate(samples: DataFrame, bad: list[str], positions: DataFrame, method: str = "spline") -> DataFrame:
    """Bad channels replaced by weighted good ones: spherical spline, or inverse distance ("nearest")."""
    rows = positions.select("label", "pos_x", "pos_y", "pos_z").where("pos_x is not null").collect()  # one row for each electrode
    good, lost = [r for r in rows if r["label"] not in bad], [r for r in rows if r["label"] in bad]
    if not rows:
        raise ValueError("electrode positions are needed")
    if not lost:
        return samples
    if len(good) < 3:
        raise ValueError("fewer than three good channels")
    xyz = lambda rs: np.array([[r["pos_x"], r["pos_y"], r["pos_z"]] for r in rs])
    if method == "spline":
        w = spline_weights(xyz(good), xyz(lost))
    elif method == "nearest":
        d = np.maximum(np.sqrt(((xyz(lost)[:, None] - xyz(good)[None]) ** 2).sum(-1)), 1e-10)
        w = (1 / d) / (1 / d).sum(axis=1, keepdims=True)
    else:
        raise ValueError(f"unknown method {method!r}")
    table = [(b["label"], g["label"], float(w[i, j])) for i, b in enumerate(lost) for j, g in enumerate(good)]
    weights = F.broadcast(samples.sparkSession.createDataFrame(table, "dst string, src string, w double"))
    made = samples.join(weights, samples["label"] == weights["src"]).groupBy(*INSTANT, "dst").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    names = samples.where(F.col("label").isin([r["label"] for r in lost])).select(F.col("label").alias("dst"), "ch").distinct()
    made = made.join(F.broadcast(names), "dst").withColumnRenamed("dst", "label")
    kept = samples.where(~F.col("label").isin([r["label"] for r in lost]))
    cols = [*INSTANT, "ch", "label", "v"]
    return kept.select(*cols).unionByName(made.select(*cols))


def mean_correlations(samples: DataFrame) -> DataFrame:
    """(recording_id, label, mean_r): each channel's mean correlation with the others, from one pass of moments."""
    chans = channels(samples)
    c = len(chans)
    gram = lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    found: dict[str, np.ndarray] = {}
    for r in partial_sums(frames(samples), gram, 1 + c + c * c, ["recording_id"]).collect():  # channels by channels for each recording
        found.setdefault(r["recording_id"], np.zeros(1 + c + c * c))[r["i"]] = r["v"]
    rows = []
    for name, g in found.items():
        n, total = g[0], g[1 : c + 1]
        cov = g[c + 1 :].reshape(c, c) - np.outer(total, total) / n
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        flat = ~(np.diag(cov) > 1e-12 * np.maximum(np.diag(g[c + 1 :].reshape(c, c)), 1e-300))
        r = np.divide(cov, scale, out=np.full((c, c), np.nan), where=~(flat[:, None] | flat[None]))
        np.fill_diagonal(r, np.nan)
        for i, (_, label) in enumerate(chans):
            known = r[i][~np.isnan(r[i])]
            rows.append((name, label, float(known.mean()) if len(known) else None))
    return samples.sparkSession.createDataFrame(rows, "recording_id string, label string, mean_r double")


def bad_channels(samples: DataFrame, method: str = "all", flat_threshold: float = 1e-6, noise_threshold: float = 4.0, corr_threshold: float = 0.4) -> DataFrame:
    """One row per channel: channel, is_bad, reason, score (flat, noise, correlation, in that order)."""
    by = ["recording_id"]
    stats = samples.groupBy(*by, "label").agg(F.var_samp("v").alias("var"))
    mid = stats.groupBy(*by).agg(F.percentile("var", F.lit(0.5)).alias("mid"))
    off = stats.join(F.broadcast(mid), by).withColumn("off", F.abs(F.col("var") - F.col("mid")))
    mad = off.groupBy(*by).agg(F.greatest(F.percentile("off", F.lit(0.5)), F.lit(1e-12)).alias("mad"))
    stats = off.join(F.broadcast(mad), by).withColumn("z", (F.col("var") - F.col("mid")) / F.col("mad"))
    stats = stats.join(F.broadcast(mean_correlations(samples)), [*by, "label"], "left")
    use = lambda m: F.lit(method in ("all", m))
    flat = use("flat") & (F.col("var") < flat_threshold)
    noise = use("noise") & (F.col("z") > noise_threshold)
    corr = use("correlation") & F.coalesce(F.col("mean_r") < corr_threshold, F.lit(False))
    reason = F.concat_ws("; ", F.when(flat, "flat"), F.when(noise, "noise"), F.when(corr, "correlation"))
    score = F.coalesce(F.when(flat, F.col("var")), F.when(noise, F.col("z")), F.when(corr, F.col("mean_r")))
    return stats.select(*by, F.col("label").alias("channel"), (flat | noise | corr).alias("is_bad"), reason.alias("reason"), score.alias("score"))
