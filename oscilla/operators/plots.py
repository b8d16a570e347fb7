"""The tables that plots draw: signals, potentials, scalp maps, spectrograms, graphs, hypnograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, TRACE, length_of, only
from ..sources.electrodes import FLAT_1020
from .timefreq import window_spectra

# Height of a stage in a hypnogram.
STAGE_HEIGHT = {"N3": 1, "N2": 2, "N1": 3, "REM": 4, "W": 5}


def signal_frame(samples: DataFrame, sr: float, channels: list[str] | None = None, time_range: tuple[float, float] | None = None, scale: float = 1.0) -> DataFrame:
    """(label, time_sec, v, shown): channels stacked at (k - i) * 3 sd; epochs show the first one."""
    x = only(samples, channels).where("epoch is null or epoch = 1")
    x = x.withColumn("time_sec", (F.col("s") - 1) / sr)
    order = x.groupBy("label").agg(F.min("ch").alias("ch"), F.stddev_samp("v").alias("sd"))
    order = order.select("label", F.row_number().over(Window.orderBy("ch")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("k"), F.avg("sd").over(Window.partitionBy()).alias("mean_sd"), "sd")
    x = x.join(F.broadcast(order), "label")
    x = x if time_range is None else x.where(F.col("time_sec").between(*time_range))
    return x.select("recording_id", "label", "time_sec", "v", (F.col("v") + (F.col("k") - F.col("i")) * scale * 3 * F.col("sd")).alias("shown"))


def erp_frame(samples: DataFrame, conditions: DataFrame, channels: list[str] | None = None, z: float = 1.959963984540054) -> DataFrame:
    """(condition, s, mean, low, high): channel mean of each epoch, then mean and interval over epochs."""
    x = only(samples, channels).groupBy("recording_id", "epoch", "s").agg(F.avg("v").alias("v")).join(F.broadcast(conditions), ["recording_id", "epoch"])
    x = x.groupBy("recording_id", "condition", "s").agg(F.avg("v").alias("mean"), (z * F.coalesce(F.stddev_samp("v"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("half"))
    return x.select("recording_id", "condition", "s", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def scalp_grid(values: DataFrame, resolution: int = 100) -> DataFrame:
    """(gx, gy, value) inside the unit disc from (x, y, value): inverse squared distance, exact at an electrode."""
    spark = values.sparkSession
    step = 2.0 / (resolution - 1)
    axis = lambda n: spark.range(resolution).select((F.lit(-1.0) + F.col("id") * step).alias(n))
    grid = axis("gx").crossJoin(axis("gy")).where(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") <= 1)
    d2 = (F.col("gx") - F.col("x")) * (F.col("gx") - F.col("x")) + (F.col("gy") - F.col("y")) * (F.col("gy") - F.col("y"))
    j = grid.crossJoin(F.broadcast(values.select("x", "y", "value"))).withColumn("d2", d2)  # one row for each electrode
    near = F.col("d2") < 1e-20
    w = F.when(~near, 1.0 / F.col("d2"))
    j = j.groupBy("gx", "gy").agg(F.min(F.when(near, F.col("value"))).alias("exact"), (F.sum(w * F.col("value")) / F.sum(w)).alias("mixed"))
    return j.select("gx", "gy", F.coalesce("exact", "mixed").alias("value"))


def flat_positions(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(label, x, y): the default table, a ring for sites it lacks."""
    rest = [x for x in labels if x not in FLAT_1020]
    ring = {x: (0.9 * math.cos(2 * math.pi * i / len(rest)), 0.9 * math.sin(2 * math.pi * i / len(rest))) for i, x in enumerate(rest)}
    return spark.createDataFrame([(x, *map(float, (FLAT_1020 | ring)[x])) for x in labels], "label string, x double, y double")


def scalp_frame(samples: DataFrame, positions: DataFrame, sr: float, time_sec: float | None = None, resolution: int = 100) -> DataFrame:
    """The map at a time, or of the mean over time."""
    n = length_of(samples)
    at = samples if time_sec is None else samples.where(F.col("s") == min(n, max(1, round(time_sec * sr) + 1)))
    return scalp_grid(at.groupBy("label").agg(F.avg("v").alias("value")).join(F.broadcast(positions), "label"), resolution)


def scalp_series(samples: DataFrame, positions: DataFrame, sr: float, times: list[float], resolution: int = 50) -> DataFrame:
    out = None
    for t in times:
        f = scalp_frame(samples, positions, sr, t, resolution).withColumn("time_sec", F.lit(float(t)))
        out = f if out is None else out.unionByName(f)
    return out


def spectrogram_frame(samples: DataFrame, sr: float, window_sec: float = 0.5) -> DataFrame:
    """(…, time_sec, freq, db): hop of a quarter window, power over the window length."""
    n = round(window_sec * sr)
    hop = max(1, n // 4)
    spec = window_spectra(samples, sr, n, hop)
    p = (F.col("re") ** 2 + F.col("im") ** 2) / n
    return spec.select(*TRACE, ((F.col("win") * hop + n / 2) / sr).alias("time_sec"), "freq", (10 * F.log10(F.greatest(p, F.lit(EPS)))).alias("db"))


def connectivity_frame(matrix: DataFrame, style: str = "heatmap", threshold: float = 0.0) -> DataFrame:
    """heatmap: (a, b, value), small ones null; circle: edges above the threshold with ring places."""
    if style == "heatmap":
        return matrix.withColumn("value", F.when(F.abs("value") >= threshold, F.col("value")))
    names = matrix.select("a").distinct()
    w = Window.orderBy("a")
    ring = names.select("a", (2 * math.pi * (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy())).alias("angle"))
    ring = ring.select(F.col("a").alias("node"), F.cos("angle").alias("x"), F.sin("angle").alias("y"))
    e = matrix.where((F.col("a") < F.col("b")) & (F.abs("value") > threshold))
    for side in "ab":
        e = e.join(F.broadcast(ring.withColumnsRenamed({"node": side, "x": f"x_{side}", "y": f"y_{side}"})), side)
    return e.select("a", "b", "value", "x_a", "y_a", "x_b", "y_b")


def hypnogram_frame(stages: DataFrame, epoch_sec: float = 30) -> DataFrame:
    height = F.create_map(*[F.lit(x) for p in STAGE_HEIGHT.items() for x in p])[F.col("stage")]
    return stages.select("recording_id", "epoch", "stage", ((F.col("epoch") - 1) * epoch_sec / 60).alias("time_min"), height.alias("height"))


def components_frame(sources: DataFrame, mixing: DataFrame, first: int = 10) -> DataFrame:
    """First components stacked at 3 sd, each named with the channel of its largest weight; mixing: component, label, w."""
    name = mixing.groupBy("component").agg(F.max_by("label", F.abs("w")).alias("site"))
    x = sources.where(F.col("component") <= first).join(F.broadcast(name), "component")
    sd = F.stddev_samp("v").over(Window.partitionBy("component"))
    return x.select("s", "component", F.format_string("IC%d (%s)", "component", "site").alias("name"), (F.col("v") + (first - F.col("component")) * 3 * sd).alias("shown"))


def source_frame(sources: DataFrame, threshold_pct: float = 80, style: str = "scatter") -> DataFrame:
    """Sources (x, y, amplitude) at or above the percentile of their absolute amplitude, as points or a flat map."""
    cut = sources.agg(F.percentile(F.abs("amplitude"), F.lit(threshold_pct / 100)).alias("cut"))
    top = sources.crossJoin(F.broadcast(cut)).where(F.abs("amplitude") >= F.col("cut")).drop("cut")
    if style == "flatmap" and top.limit(3).count() == 3:
        return scalp_grid(top.withColumnRenamed("amplitude", "value"), 80)
    return top


def outline(spark: SparkSession, points: int = 100) -> DataFrame:
    """(part, i, x, y): head circle, nose and ears."""
    angle = 2 * math.pi * F.col("id") / (points - 1)
    head = spark.range(points).select(F.lit("head").alias("part"), F.col("id").cast("int").alias("i"), F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    nose = [("nose", i, x, y) for i, (x, y) in enumerate([(-0.1, 0.995), (0.0, 1.15), (0.1, 0.995)])]
    ears = [(f"ear_{n}", i, k * (1.0 + 0.08 * math.sin(math.pi * i / 8)), 0.2 * math.cos(math.pi * i / 8)) for n, k in (("left", -1), ("right", 1)) for i in range(9)]
    return head.union(spark.createDataFrame(nose + ears, "part string, i int, x double, y double"))
