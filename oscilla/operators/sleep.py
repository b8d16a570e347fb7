"""Sleep staging and event detection. Detectors threshold on per-channel statistics joined back, then find runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, halo, length_of, neighbours, runs
from .filtering import fir_filter
from .timefreq import window_spectra

KEY = ["recording_id", "ch", "label"]


def _lengths(sr: float, min_ms: float, max_ms: float) -> tuple[int, int]:
    if min_ms >= max_ms:
        raise ValueError("min_duration_ms must be below max_duration_ms")
    return max(1, round(min_ms / 1000 * sr)), round(max_ms / 1000 * sr)


# Bands in Hz; theta excludes its ends' neighbours, delta its upper end.
STAGE_BANDS = {"delta": "freq >= 0.5 AND freq < 4", "theta": "freq >= 4 AND freq < 8", "alpha": "freq >= 8 AND freq <= 13", "sigma": "freq >= 12 AND freq <= 16", "beta": "freq >= 16 AND freq <= 30", "total": "true"}


def stage_rule() -> Column:
    t = F.when(F.col("total") < EPS, 1.0).otherwise(F.col("total"))
    return (
        F.when(F.col("delta") / t > 0.4, "N3").when(F.col("alpha") / t > 0.3, "W").when(F.col("sigma") / t > 0.05, "N2")
        .when((F.col("theta") > F.col("delta")) & (F.col("alpha") / t < 0.2), "REM").otherwise("N1")
    )


def sleep_stages(samples: DataFrame, sr: float, epoch_sec: float = 30) -> DataFrame:
    """(recording_id, epoch, stage, start_sample, end_sample, <band>_power) of tumbling windows; a short tail is left out."""
    n = int(epoch_sec * sr)
    total = length_of(samples)
    if total < n:
        raise ValueError("signal is shorter than one epoch")
    spec = window_spectra(samples, sr, n, n, "rectangular").where(F.col("k") < n // 2)
    power = (F.col("re") ** 2 + F.col("im") ** 2) / n
    per = spec.groupBy("recording_id", "ch", "win").agg(*[F.sum(F.when(F.expr(c), power).otherwise(0.0)).alias(b) for b, c in STAGE_BANDS.items()])
    mean = per.groupBy("recording_id", "win").agg(*[F.avg(b).alias(b) for b in STAGE_BANDS])
    shown = [F.col(b).alias(f"{b}_power") for b in STAGE_BANDS if b != "total"]
    return mean.select("recording_id", (F.col("win") + 1).alias("epoch"), stage_rule().alias("stage"), (F.col("win") * n + 1).cast("long").alias("start_sample"), ((F.col("win") + 1) * n).cast("long").alias("end_sample"), *shown)


def spindles(samples: DataFrame, sr: float, freq_range: tuple[float, float] = (11, 16), min_duration_ms: float = 500, max_duration_ms: float = 2000, threshold_sd: float = 1.5) -> DataFrame:
    """Runs of the band's RMS envelope above mean + threshold_sd * sd."""
    shortest, longest = _lengths(sr, min_duration_ms, max_duration_ms)
    x = fir_filter(samples, "bandpass", sr, *freq_range)
    half = max(1, round(0.2 * sr)) // 2
    x = halo(x, KEY, max(half, 1), half, lambda w: {"env": F.sqrt(F.avg(F.col("v") ** 2).over(w.rowsBetween(-half, half))), "prev": F.lag("v").over(w)})
    limit = x.groupBy(*KEY).agg((F.avg("env") + threshold_sd * F.stddev_samp("env")).alias("limit"))
    x = x.join(F.broadcast(limit), KEY).where("env > limit")
    turn = F.coalesce(F.signum("v") != F.signum("prev"), F.lit(False)).cast("int")  # the first of a run is none
    x = x.select(*KEY, "s", F.struct("env", (-F.col("s")).alias("s")).alias("peak"), turn.alias("turns"), F.struct("s", turn.alias("turn")).alias("head"))
    r = runs(x, KEY, F.lit(True), {"peak": F.max("peak"), "turns": F.sum("turns"), "head": F.min("head")})
    r = r.select(*KEY, F.col("start").alias("start_sample"), F.col("stop").alias("end_sample"), (-F.col("peak.s")).alias("peak_sample"), F.col("peak.env").alias("peak_amplitude"), (F.col("turns") - F.col("head.turn")).alias("turns"))
    size = F.col("end_sample") - F.col("start_sample") + 1
    r = r.where(size.between(shortest, longest)).withColumn("duration_ms", size / sr * 1000)
    return r.select("recording_id", F.col("ch").alias("channel"), "start_sample", "end_sample", "duration_ms", "peak_sample", "peak_amplitude", (F.col("turns") / 2 / (F.col("duration_ms") / 1000)).alias("frequency_hz"))


def k_complexes(samples: DataFrame, sr: float, min_neg_amplitude: float = 75, min_duration_ms: float = 500, max_duration_ms: float = 1500) -> DataFrame:
    """Deep local minima followed by a positive peak 0.5 to 1.5 s later; search positions are joined by equality."""
    shortest, longest = _lengths(sr, min_duration_ms, max_duration_ms)
    x = fir_filter(samples, "lowpass", sr, high=4)
    n = length_of(x)
    low = halo(x, KEY, 1, 1, lambda w: {"p": F.lag("v").over(w), "q": F.lead("v").over(w)}).where((F.col("v") < F.col("p")) & (F.col("v") <= F.col("q")) & (F.col("v") < -min_neg_amplitude))
    a, b = round(0.5 * sr), round(1.5 * sr)
    at = low.where(F.col("s") + a < F.least(F.col("s") + b, F.lit(n))).select(*KEY, F.col("s").alias("np"), F.col("v").alias("na"), F.explode(F.sequence(F.col("s") + a, F.least(F.col("s") + b, F.lit(n)))).alias("s"))
    hit = at.join(x.select(*KEY, "s", "v"), [*KEY, "s"]).groupBy(*KEY, "np", "na").agg(F.max_by("s", F.struct("v", -F.col("s"))).alias("pp"), F.max("v").alias("pa"))
    size = F.col("pp") - F.col("np")
    hit = hit.where((F.col("pa") > 0) & size.between(shortest, longest)).withColumn("duration_ms", size / sr * 1000)
    return hit.select("recording_id", F.col("ch").alias("channel"), F.col("np").alias("negative_peak_sample"), F.col("pp").alias("positive_peak_sample"), F.col("na").alias("negative_amplitude"), F.col("pa").alias("positive_amplitude"), "duration_ms")


def slow_waves(samples: DataFrame, sr: float, min_amplitude: float = 75, freq_range: tuple[float, float] = (0.5, 2), min_duration_ms: float = 250, max_duration_ms: float = 1000) -> DataFrame:
    """Half waves between sign changes that are deep and long enough, with the next half wave's maximum.

    A wave starts and ends at the last samples before its two crossings; after the last
    crossing the maximum is sought in as many samples as a wave may have.
    """
    shortest, longest = _lengths(sr, min_duration_ms, max_duration_ms)
    x = fir_filter(samples, "bandpass", sr, *freq_range)
    sign = F.when(F.col("v") < 0, -1).otherwise(1)
    h = runs(x.withColumns({"low": F.col("v"), "high": F.col("v")}), KEY, sign, {"low": F.min("low"), "high": F.max("high")})
    # the last half wave counts as far as a wave may reach
    last = h.groupBy(*KEY).agg(F.max_by(F.struct("start", "stop"), "start").alias("e"))
    reach = last.select(*KEY, F.col("e.start").alias("tail"), F.explode(F.sequence(F.col("e.start"), F.least(F.col("e.stop"), F.col("e.start") + longest - 1))).alias("s"))
    soon = reach.join(x.select(*KEY, "s", "v"), [*KEY, "s"]).groupBy(*KEY, "tail").agg(F.max("v").alias("soon"))
    h = neighbours(h, KEY, ["high"], "start").join(soon, KEY)
    peak = F.when(F.col("next.start") == F.col("tail"), F.col("soon")).otherwise(F.col("next.high"))
    h = h.where("prev IS NOT NULL AND next IS NOT NULL").withColumns({"positive_peak": peak, "start_sample": F.col("start") - 1, "end_sample": F.col("stop")})
    size = F.col("end_sample") - F.col("start_sample")
    h = h.where((F.col("low") <= -min_amplitude) & size.between(shortest, longest)).withColumn("duration_ms", size / sr * 1000)
    return h.select("recording_id", F.col("ch").alias("channel"), "start_sample", "end_sample", F.col("low").alias("negative_peak"), "positive_peak", "duration_ms", ((F.col("positive_peak") - F.col("low")) / F.col("duration_ms")).alias("slope"))


def sleep_metrics(stages: DataFrame, epoch_sec: float = 30) -> DataFrame:
    """Ten rows (recording_id, metric, value, unit) of a hypnogram (recording_id, epoch, stage)."""
    m = epoch_sec / 60.0
    asleep = F.col("stage") != "W"
    first = stages.groupBy("recording_id").agg(F.min(F.when(asleep, F.col("epoch"))).alias("onset"), F.max(F.when(asleep, F.col("epoch"))).alias("offset"))
    x = stages.join(F.broadcast(first), "recording_id")
    a = x.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(asleep).alias("tst"), F.first("onset").alias("onset"), F.min("epoch").alias("e0"),
        F.count_if(~asleep & (F.col("epoch") > F.col("onset"))).alias("waso"), F.min(F.when(F.col("stage") == "REM", F.col("epoch"))).alias("rem_at"),
        *[F.count_if(F.col("stage") == s).alias(s) for s in ("N1", "N2", "N3", "REM", "W")],
    )
    pct = lambda c, of: F.when(F.col(of) > 0, 100.0 * F.col(c) / F.greatest(F.col(of), F.lit(1))).otherwise(0.0)
    rows = [
        ("total_sleep_time", F.col("tst") * m, "min"), ("sleep_efficiency", pct("tst", "n"), "%"),
        ("sleep_latency", F.coalesce(F.col("onset") - F.col("e0"), F.col("n")) * m, "min"), ("waso", F.col("waso") * m, "min"),
        ("rem_latency", (F.col("rem_at") - F.col("onset")) * m, "min"), *[(f"pct_{s}", pct(s, "tst"), "%") for s in ("N1", "N2", "N3", "REM")], ("pct_W", pct("W", "n"), "%"),
    ]
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit")) for k, v, u in rows])).alias("x")
    return a.select("recording_id", made).select("recording_id", "x.metric", "x.value", "x.unit")
