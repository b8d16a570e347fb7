"""Clinical measures: spikes, band power, asymmetry, suppression, slowing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, halo, length_of, merge_runs, runs
from .filtering import in_blocks
from .timefreq import window_energy, window_spectra
from .transform import spectrum

KEY = ["recording_id", "ch", "label"]
# Default bands in Hz, both ends inclusive.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 50)}


def spikes(samples: DataFrame, sr: float, method: str = "morphology", threshold_sd: float = 4, min_duration_ms: float = 20, max_duration_ms: float = 200, min_amplitude: float = 50) -> DataFrame:
    """(recording_id, channel, sample, time_sec, amplitude, duration_ms, confidence); the amplitude is absolute."""
    if min_duration_ms >= max_duration_ms:
        raise ValueError("min_duration_ms must be below max_duration_ms")
    if method == "template":
        return _template_spikes(samples, sr, max_duration_ms, min_amplitude)
    low, high, n = max(1, round(min_duration_ms / 1000 * sr)), round(max_duration_ms / 1000 * sr), length_of(samples)
    x = halo(samples, KEY, 0, 1, lambda w: {"d": F.abs(F.coalesce(F.lead("v").over(w) - F.col("v"), F.lit(0.0)))})
    stats = x.groupBy(*KEY).agg((F.avg("d") + threshold_sd * F.stddev_samp("d")).alias("limit"), (F.avg(F.abs("v")) + 2 * F.stddev_samp("v")).alias("ref"))
    hits = x.join(F.broadcast(stats), KEY).where("d > limit").withColumns({"value": F.lit(True), "start": F.col("s"), "stop": F.col("s")})
    g = merge_runs(hits, KEY, {"ref": F.first("ref")}, high)
    g = g.withColumn("n", F.col("stop") - F.col("start") + 1).where(F.col("n").between(low, high))
    at = g.withColumn("s", F.explode(F.sequence(F.greatest(F.col("start") - low, F.lit(1)), F.least(F.col("stop") + low, F.lit(n)))))
    p = at.join(samples.select(*KEY, "s", "v"), [*KEY, "s"]).groupBy(*KEY, "start", "ref", "n").agg(F.max_by(F.struct("s", "v"), F.struct(F.abs("v"), -F.col("s"))).alias("p"))
    p = p.where(F.abs("p.v") >= min_amplitude)
    return p.select("recording_id", F.col("ch").alias("channel"), F.col("p.s").alias("sample"), ((F.col("p.s") - 1) / sr).alias("time_sec"), F.abs("p.v").alias("amplitude"), (F.col("n") / sr * 1000).alias("duration_ms"), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs("p.v"), F.col("ref")), F.lit(1.0))).alias("confidence"))


def spike_template(sr: float, max_duration_ms: float) -> np.ndarray:
    n = max(2, round(max_duration_ms / 1000 * sr))
    peak = max(1, int(0.2 * n)) - 1
    t = (np.arange(n) - peak) / sr * 1000
    x = np.where(t <= 0, np.exp(-(t**2) / (2 * 2.0**2)), np.exp(-t / 20.0))
    return x / np.sqrt((x**2).sum())


def _template_spikes(samples: DataFrame, sr: float, max_duration_ms: float, min_amplitude: float, block: int | None = None) -> DataFrame:
    template = spike_template(sr, max_duration_ms)
    n = len(template)

    def alike(x: np.ndarray) -> list[np.ndarray]:
        view = np.lib.stride_tricks.sliding_window_view(x, n)
        norm = np.sqrt((view**2).sum(axis=1))
        return [np.divide(view @ template, norm, out=np.zeros(len(norm)), where=norm > 0)]

    total = length_of(samples)
    like = in_blocks(samples, total, 0, n - 1, alike, ["v"], block).where(F.col("s") <= total - n + 1).where("v > 0.7")
    likest = F.struct("v", (-F.col("s")).alias("s")).alias("best")
    hits = like.select(*KEY, F.lit(True).alias("value"), F.col("s").alias("start"), F.col("s").alias("stop"), likest)
    best = merge_runs(hits, KEY, {"best": F.max("best")}, n).select(*KEY, F.col("start").alias("session"), (-F.col("best.s")).alias("at"), F.col("best.v").alias("confidence"))
    inside = best.withColumn("s", F.explode(F.sequence(F.col("at"), F.col("at") + n - 1)))
    p = inside.join(samples.select(*KEY, "s", "v"), [*KEY, "s"]).groupBy(*KEY, "session", "confidence").agg(F.max_by(F.struct("s", "v"), F.struct(F.abs("v"), -F.col("s"))).alias("p"))
    p = p.where(F.abs("p.v") >= min_amplitude)
    return p.select("recording_id", F.col("ch").alias("channel"), F.col("p.s").alias("sample"), ((F.col("p.s") - 1) / sr).alias("time_sec"), F.abs("p.v").alias("amplitude"), F.lit(n / sr * 1000).alias("duration_ms"), "confidence")


def qeeg(samples: DataFrame, sr: float, bands: dict[str, tuple[float, float]] | None = None, window_sec: float = 2, overlap: float = 0.5) -> DataFrame:
    """(recording_id, ch, label, band, absolute_power, relative_power) of Welch spectra; band ends are inclusive."""
    total = length_of(samples)
    n = min(round(window_sec * sr), total)
    hop = max(1, round(n * (1 - overlap)))
    spec = window_spectra(samples, sr, n, hop).where(F.col("k") < n // 2)
    psd = spec.groupBy(*KEY, "freq").agg((F.avg(F.col("re") ** 2 + F.col("im") ** 2) / (sr * window_energy("hanning", n))).alias("p"))
    table = samples.sparkSession.createDataFrame([(b, float(x), float(y)) for b, (x, y) in (bands or BANDS).items()], "band string, low double, high double")
    out = psd.crossJoin(F.broadcast(table)).groupBy(*KEY, "band").agg(F.sum(F.when(F.col("freq").between(F.col("low"), F.col("high")), F.col("p")).otherwise(0.0)).alias("absolute_power"))
    all_ = F.sum("absolute_power").over(Window.partitionBy(*KEY))
    return out.withColumn("relative_power", F.when(all_ > 0, F.try_divide("absolute_power", all_)).otherwise(0.0))


def periodogram(samples: DataFrame, sr: float, band: tuple[float, float] | None = None) -> DataFrame:
    """(recording_id, ch, label, freq, p) of whole traces, each transformed by many tasks; the band's ends are inclusive."""
    n = length_of(samples)
    low, high = (0, n // 2) if band is None else (max(0, math.floor(band[0] * n / sr)), min(n // 2, math.ceil(band[1] * n / sr)))
    freq = F.col("k") * sr / n
    p = spectrum(samples, n, min(low, high), high).select(*KEY, freq.alias("freq"), ((F.col("re") ** 2 + F.col("im") ** 2) / n).alias("p"))
    return p if band is None else p.where(F.col("freq").between(*band))


def band_power(samples: DataFrame, sr: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(recording_id, ch, label, <band>...): whole-signal periodogram sums, ends inclusive."""
    sums = [F.sum(F.when(F.col("freq").between(a, b), F.col("p")).otherwise(0.0)).alias(name) for name, (a, b) in bands.items()]
    inside = periodogram(samples, sr, (min(a for a, _ in bands.values()), max(b for _, b in bands.values()))).groupBy(*KEY).agg(*sums)
    every = samples.select(*KEY).distinct()  # a band without a bin has no power
    return every.join(inside, KEY, "left").fillna(0.0, list(bands))


def asymmetry(samples: DataFrame, sr: float, pairs: list[tuple[str, str]] | None = None, band: tuple[float, float] = (8, 13)) -> DataFrame:
    """ln(right) - ln(left) band power of (right, left) pairs; pairs without both channels are left out."""
    pairs = pairs or [("F4", "F3"), ("F8", "F7")]
    p = band_power(samples, sr, {"p": band}).select("recording_id", "label", F.greatest("p", F.lit(EPS)).alias("p"))
    t = F.broadcast(samples.sparkSession.createDataFrame([(f"{r}-{x}", r, x) for r, x in pairs], "pair string, right_channel string, left_channel string"))
    out = t.join(p.select("recording_id", F.col("label").alias("right_channel"), F.col("p").alias("right_power")), "right_channel")
    out = out.join(p.select("recording_id", F.col("label").alias("left_channel"), F.col("p").alias("left_power")), ["recording_id", "left_channel"])
    return out.select("recording_id", "pair", "left_channel", "right_channel", "left_power", "right_power", (F.log("right_power") - F.log("left_power")).alias("asymmetry_index"))


def suppression(samples: DataFrame, sr: float, threshold: float = 10, min_duration_ms: float = 500, window_ms: float = 500) -> tuple[DataFrame, DataFrame]:
    """(segments, burst-suppression ratio). Short suppressions turn into bursts before neighbours merge."""
    n, total = max(1, round(window_ms / 1000 * sr)), length_of(samples)
    x = samples.withColumn("s", F.floor((F.col("s") - 1) / n) + 1).where(F.col("s") <= total // n)
    x = x.groupBy("recording_id", "s").agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"))
    first = runs(x, ["recording_id"], F.col("rms") < threshold).withColumn("n", F.col("stop") - F.col("start") + 1)
    long_ = F.col("value") & (F.col("n") * n / sr * 1000 >= min_duration_ms)
    x = merge_runs(first.withColumn("value", long_), ["recording_id"], {})
    seg = x.select("recording_id", F.col("value").alias("quiet"), ((F.col("start") - 1) * n + 1).alias("start_sample"), (F.col("stop") * n).alias("end_sample"))
    seg = seg.select("recording_id", F.when(F.col("quiet"), "suppression").otherwise("burst").alias("type"), "start_sample", "end_sample", ((F.col("end_sample") - F.col("start_sample") + 1) / sr * 1000).alias("duration_ms"))
    bsr = seg.groupBy("recording_id").agg((F.sum(F.when(F.col("type") == "suppression", F.col("duration_ms")).otherwise(0.0)) * 100 / (total / sr * 1000)).alias("bsr"))
    return seg, bsr


def slowing(samples: DataFrame, sr: float, method: str = "tdr") -> DataFrame:
    """(recording_id, channel, metric, value, classification): tdr, dtar or peak_frequency."""
    inf = F.lit(float("inf"))
    if method == "peak_frequency":
        p = periodogram(samples, sr, (1, 30)).groupBy(*KEY).agg(F.max_by("freq", F.struct("p", -F.col("freq"))).alias("value"))
        c = F.when(F.col("value") >= 8, "normal").when(F.col("value") >= 6, "mild_slowing").when(F.col("value") >= 4, "moderate_slowing").otherwise("severe_slowing")
    elif method in ("tdr", "dtar"):
        b = band_power(samples, sr, {k: BANDS[k] for k in ("delta", "theta", "alpha", "beta")})
        num, den = (F.col("theta"), F.col("delta")) if method == "tdr" else (F.col("delta") + F.col("theta"), F.col("alpha") + F.col("beta"))
        p = b.select(*KEY, F.when(den > EPS, F.try_divide(num, den)).otherwise(inf).alias("value"))
        v = F.col("value")
        c = F.when(v > 1, "mild_slowing").otherwise("normal") if method == "tdr" else F.when(v < 1, "normal").when(v < 2, "mild_slowing").when(v < 4, "moderate_slowing").otherwise("severe_slowing")
    else:
        raise ValueError(f"unknown method {method!r}")
    return p.select("recording_id", F.col("ch").alias("channel"), F.lit(method).alias("metric"), "value", c.alias("classification"))
