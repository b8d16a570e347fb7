"""Synthetic recordings as DataFrames.

Fixed values: the amplitudes, frequencies, widths and times of the waveforms below (rhythms,
potentials, spindles, complexes, spikes) are those by which such recordings are known.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .electrodes import SYSTEM_1020

BCI_SITES = ["C3", "Cz", "C4", "P3", "Pz", "P4", "O1", "O2"]
CYCLE = ["W", "N1", "N2", "N3", "N2", "REM"]
TAU = 2 * math.pi


def _labels(n: int) -> Column:
    pool = list(SYSTEM_1020)
    names = pool[:n] if n <= len(pool) else [f"EEG{i}" for i in range(1, n + 1)]
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.col("ch"))


def _grid(spark: SparkSession, n_time: int, n_channels: int, epochs: int | None = None) -> DataFrame:
    x = spark.range(1, n_time + 1).withColumnRenamed("id", "s")
    upto = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    x = x.withColumn("ch", upto(n_channels))
    x = x.withColumn("epoch", upto(epochs) if epochs else F.lit(None).cast("int"))
    return x.withColumns({"recording_id": F.lit("r1"), "label": _labels(n_channels)})


def _noise(seed: int, sd: float) -> Column:
    """Standard normal from hashes, so that a value depends on its place alone."""
    u = lambda k: (F.pmod(F.xxhash64("s", "ch", "epoch", F.lit(seed * 2 + k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return sd * F.sqrt(-2 * F.log(u(0))) * F.cos(TAU * u(1))


def _done(x: DataFrame, v: Column) -> DataFrame:
    return x.withColumn("v", v).select("recording_id", "epoch", "s", "ch", "label", "v")


def _phase(seed: int) -> Column:
    return TAU * F.pmod(F.xxhash64("ch", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


def make_eeg(spark: SparkSession, n_time: int = 5000, n_channels: int = 19, sr: float = 500, seed: int = 1) -> DataFrame:
    """Alpha and beta rhythms, a random walk and noise."""
    x = _grid(spark, n_time, n_channels)
    t, ring = (F.col("s") - 1) / sr, TAU * F.col("ch") / n_channels
    w = Window.partitionBy("ch")
    walk = F.sum(_noise(seed, 2)).over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("walk", walk).withColumn("walk", F.col("walk") - F.avg("walk").over(w))
    v = (10 + 5 * F.sin(ring)) * F.sin(TAU * 10 * t + _phase(seed)) + (3 + 2 * F.cos(ring)) * F.sin(TAU * 20 * t + _phase(seed + 1)) + F.col("walk") + _noise(seed + 2, 1)
    return _done(x, 0.5 * v)


def make_erp(spark: SparkSession, n_epochs: int = 40, n_channels: int = 19, sr: float = 250, epoch_sec: float = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, epochs): N100 and P300 in noise, conditions alternating target and standard."""
    x = _grid(spark, round(sr * epoch_sec), n_channels, n_epochs)
    t = (F.col("s") - 1) / sr
    bump = lambda at, sd: F.exp(-((t - at) * (t - at)) / (2 * sd * sd))
    p300 = F.when(F.col("epoch") % 2 == 1, 12.0).otherwise(3.0)
    epochs = spark.range(1, n_epochs + 1).select(F.lit("r1").alias("recording_id"), F.col("id").cast("int").alias("epoch"), F.when(F.col("id") % 2 == 1, "target").otherwise("standard").alias("condition"))
    return _done(x, _noise(seed, 5) - 8 * bump(0.1, 0.015) + p300 * bump(0.3, 0.03)), epochs


def make_sleep(spark: SparkSession, n_time: int = 150_000, n_channels: int = 2, sr: float = 500, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, stages): 30-s epochs through the cycle; a short last one stays 0."""
    n = int(30 * sr)
    whole = n_time // n
    x = _grid(spark, n_time, n_channels)
    k, t = F.floor((F.col("s") - 1) / n), ((F.col("s") - 1) % n) / sr
    stage = F.element_at(F.array(*[F.lit(c) for c in CYCLE]), (k % len(CYCLE) + 1).cast("int"))
    wave = lambda a, f: a * F.sin(TAU * f * t)
    spindle = F.when((t >= 5) & (F.pmod(t - 5, F.lit(10.0)) < 1), wave(25, 13) * F.sin(math.pi * F.pmod(t - 5, F.lit(10.0)))).otherwise(0.0)
    u = F.pmod(t - 8, F.lit(15.0))
    bump = lambda at, sd: F.exp(-((u - at) * (u - at)) / (2 * sd * sd))
    complex_ = F.when(t >= 8, -40 * bump(0.2, 0.08) + 20 * bump(0.9, 0.15)).otherwise(0.0)
    shapes = {"W": wave(20, 10) + wave(5, 20), "N1": wave(15, 6) + wave(5, 10), "N2": wave(10, 5) + spindle + complex_, "N3": wave(50, 1) + wave(30, 0.5), "REM": wave(12, 6) + wave(4, 18)}
    v = F.lit(0.0)
    for name, shape in shapes.items():
        v = F.when(stage == name, shape + _noise(seed, 2)).otherwise(v)
    stages = spark.range(whole).select(F.lit("r1").alias("recording_id"), (F.col("id") + 1).cast("int").alias("epoch"), F.element_at(F.array(*[F.lit(c) for c in CYCLE]), (F.col("id") % len(CYCLE) + 1).cast("int")).alias("stage"), (F.col("id") * n + 1).alias("start_sample"), ((F.col("id") + 1) * n).alias("end_sample"))
    return _done(x, F.when(k < whole, v).otherwise(0.0)), stages


def make_bci(spark: SparkSession, n_trials: int = 30, n_channels: int = 8, sr: float = 256, trial_sec: float = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, epochs): mu rhythm weaker over the side opposite to the imagined hand; 12 Hz at O1 and O2."""
    x = _grid(spark, round(sr * trial_sec), n_channels, 2 * n_trials)
    sites = F.array(*[F.lit(BCI_SITES[i] if i < len(BCI_SITES) else f"EEG{i + 1}") for i in range(n_channels)])
    x = x.withColumn("label", F.element_at(sites, F.col("ch")))
    t, left = (F.col("s") - 1) / sr, F.col("epoch") <= n_trials
    weak, strong = F.when(left, "C4").otherwise("C3"), F.when(left, "C3").otherwise("C4")
    amp = F.when(F.col("label") == weak, 8 * 0.3).when(F.col("label") == strong, 8 * 1.5).otherwise(8.0)
    v = amp * F.sin(TAU * 10 * t) + F.when(F.col("label").isin("O1", "O2"), 6 * F.sin(TAU * 12 * t)).otherwise(0.0) + _noise(seed, 3)
    epochs = spark.range(1, 2 * n_trials + 1).select(F.lit("r1").alias("recording_id"), F.col("id").cast("int").alias("epoch"), F.when(F.col("id") <= n_trials, "left").otherwise("right").alias("condition"))
    return _done(x, v), epochs


def make_spikes(spark: SparkSession, n_time: int = 30_000, n_channels: int = 19, sr: float = 500, n_spikes: int = 15, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(samples, spikes: spike_id, sample, time_sec, channels): sharp waves on one to three channels; the peak gets both slopes."""
    rise, fall = int(0.02 * sr), int(0.07 * sr)
    gap = (n_time - 2 * (rise + fall)) // n_spikes
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003))
    at = F.lit(rise + fall) + F.col("id") * gap + h(0) % max(1, gap - rise - fall)
    first = (h(1) % n_channels + 1).cast("int")
    chans = F.array_distinct(F.transform(F.sequence(F.lit(0), (h(2) % 3).cast("int")), lambda i: ((first + i * 5 - 1) % n_channels + 1).cast("int")))
    spikes = spark.range(n_spikes).select((F.col("id") + 1).cast("int").alias("spike_id"), at.alias("sample"), ((at - 1) / sr).alias("time_sec"), chans.alias("channels"), (80 + 70 * h(3) / 1_000_003.0).alias("amp"))
    off = F.explode(F.sequence(F.lit(-rise), F.lit(fall)))
    shape = spikes.select("sample", "amp", F.explode("channels").alias("ch")).select("sample", "amp", "ch", off.alias("o"))
    up = F.when(F.col("o") <= 0, F.pow(1 + F.col("o") / rise, 2)).otherwise(0.0)
    down = F.when(F.col("o") >= 0, F.exp(-3.0 * F.col("o") / fall)).otherwise(0.0)
    shape = shape.groupBy((F.col("sample") + F.col("o")).alias("s"), "ch").agg(F.sum(F.col("amp") * (up + down)).alias("add"))
    x = _grid(spark, n_time, n_channels).join(F.broadcast(shape), ["s", "ch"], "left")
    v = 10 * F.sin(TAU * 10 * (F.col("s") - 1) / sr + _phase(seed)) + _noise(seed, 5) + F.coalesce("add", F.lit(0.0))
    return _done(x, v), spikes.drop("amp")


GUIDES = {
    "erp": ["epochs.epoch_events", "erp.baseline", "erp.detect", "erp.permutation_test"],
    "sleep": ["filtering.eeg_filter", "sleep.sleep_stages", "sleep.spindles", "sleep.sleep_metrics"],
    "bci": ["bci.features", "bci.classify", "bci.ssvep"],
    "connectivity": ["connectivity.coherence", "connectivity.plv", "connectivity.granger"],
}


def quick_start(workflow: str = "all") -> str:
    """The operators of a workflow in order."""
    if workflow != "all" and workflow not in GUIDES:
        raise ValueError(f"unknown workflow {workflow!r}; one of {', '.join(GUIDES)}, all")
    return "\n".join(f"{w}: " + " -> ".join(steps) for w, steps in GUIDES.items() if workflow in ("all", w))
