"""Cutting epochs around events and rejecting those with artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import length_of


def epoch_events(samples: DataFrame, events: DataFrame, sr: float, limits: tuple[float, float] = (-0.2, 0.8), baseline: tuple[float, float] | None = (-0.2, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(epoched samples, epoch table). events: recording_id, pos (order) and onset_sec or onset_sample.

    Events whose epoch crosses an end of the recording are left out; epochs are numbered in
    the order of pos. Samples are found by an equi-join on exploded positions, not by a range.
    """
    if "onset_sample" in events.columns:
        onset = F.col("onset_sample").cast("long")
    elif "onset_sec" in events.columns:
        onset = (F.rint(F.col("onset_sec") * sr) + 1).cast("long")
    else:
        raise ValueError("events need onset_sec or onset_sample")
    a, b = round(limits[0] * sr), round(limits[1] * sr)
    n = length_of(samples)
    table = events.withColumn("onset", onset).where((F.col("onset") + a >= 1) & (F.col("onset") + b <= n))
    table = table.withColumn("epoch", F.row_number().over(Window.partitionBy("recording_id").orderBy("pos")).cast("int"))
    if table.isEmpty():
        raise ValueError("no event lies within the recording")
    at = table.select("recording_id", "epoch", "onset", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("off"))
    at = at.select("recording_id", "epoch", (F.col("onset") + F.col("off")).alias("s"), (F.col("off") - a + 1).cast("long").alias("place"))
    x = samples.drop("epoch").join(at, ["recording_id", "s"]).drop("s").withColumnRenamed("place", "s")
    if baseline:
        low, high = max(1, round(baseline[0] * sr) - a + 1), min(b - a + 1, round(baseline[1] * sr) - a + 1)
        if low > high:
            raise ValueError("baseline lies outside the epoch")
        base = F.avg(F.when(F.col("s").between(low, high), F.col("v"))).over(Window.partitionBy("recording_id", "epoch", "ch"))
        x = x.withColumn("v", F.col("v") - base)
    return x.select("recording_id", "epoch", "s", "ch", "label", "v"), table


def artifact_scores(samples: DataFrame, method: str = "threshold", sr: float | None = None) -> DataFrame:
    """(recording_id, epoch, value): largest amplitude, largest step, or z-score of log power over epochs."""
    by = ["recording_id", "epoch"]
    if method == "threshold":
        return samples.groupBy(*by).agg(F.max(F.abs("v")).alias("value"))
    if method == "gradient":
        w = Window.partitionBy(*by, "ch").orderBy("s")
        return samples.withColumn("d", F.abs(F.col("v") - F.lag("v").over(w))).groupBy(*by).agg(F.max("d").alias("value"))
    if method == "joint_probability":
        p = samples.groupBy(*by).agg(F.log(F.greatest(F.avg(F.col("v") ** 2), F.lit(1e-20))).alias("p"))
        all_ = p.groupBy("recording_id").agg(F.avg("p").alias("m"), F.greatest(F.coalesce(F.stddev_samp("p"), F.lit(0.0)), F.lit(1e-12)).alias("d"))
        return p.join(F.broadcast(all_), "recording_id").select(*by, ((F.col("p") - F.col("m")) / F.col("d")).alias("value"))
    raise ValueError(f"unknown method {method!r}")


def reject_artifacts(samples: DataFrame, method: str = "threshold", sr: float | None = None, threshold_uv: float = 100, gradient_uv_ms: float = 50, jp_threshold: float = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean samples, log of rejected epochs, summary)."""
    if method == "gradient" and not sr:
        raise ValueError("gradient rejection needs the sampling rate")
    limit = {"threshold": threshold_uv, "gradient": gradient_uv_ms * 1000 / (sr or 1), "joint_probability": jp_threshold}
    scores = artifact_scores(samples, method, sr)
    log = scores.where(F.abs("value") > limit[method]).select("recording_id", "epoch", F.lit(method).alias("reason"), "value")
    clean = samples.join(log.select("recording_id", "epoch"), ["recording_id", "epoch"], "left_anti")
    bad = F.abs("value") > limit[method]
    summary = scores.groupBy("recording_id").agg(
        F.lit(method).alias("method"), F.count(F.lit(1)).alias("n_total"), F.count_if(bad).alias("n_rejected"), F.count_if(~bad).alias("n_retained"),
        F.array_sort(F.collect_list(F.when(bad, F.col("epoch")))).alias("rejected_epochs"),
    )
    return clean, log, summary
