"""A query for each operator on the driver's tables, with oracle SQL where SQL can say it.

All doubles are rounded in both; results of eigenvectors or random draws have no oracle
and are tested against NumPy or by property.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.columns import length_of
from ..functions.kernels import butterworth, cascade, fir_length, fir_taps, spline_weights
from ..operators import bci, clinical, connectivity, epochs, erp, filtering, ica, microstate, plots, sleep, source, spatial, timefreq
from ..sources.electrodes import FLAT_1020, SYSTEM_1010, SYSTEM_1020, electrodes
from ..sources.views import EPOCH_LEN, EPOCHED_SQL, POSITIONS_SQL, SIGNAL_SQL, SR, STAGES_SQL, TOPO_SQL, epoched, signal, stages, topographies
from .pipeline import preprocess

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PI = repr(math.pi)
ORDER = 61  # taps of the filter queries


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    def shown(c: str, kind: str):
        return F.round(F.col(c), digits).alias(c) if kind == "double" else F.col(c)

    return df.select(*[shown(c, k) for c, k in df.dtypes if c != "recording_id"])


def r(x: str, digits: int = 4) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def query(name: str, sql: str | None = None, digits: int = 4):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def positions(spark: SparkSession) -> DataFrame:
    return electrodes(spark, "10-10").drop("system")


# --- spatial -------------------------------------------------------------------


def _reref_sql(weight: str) -> str:
    return f"WITH {TOPO_SQL} SELECT s, ch, label, {r(f'v - avg(CASE WHEN {weight} THEN v END) OVER (PARTITION BY s)')} AS v FROM topo"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("s", "ch", "label", "v")


query("reref_average", _reref_sql("true"))(lambda s, d: _shown(spatial.rereference(topographies(s, d))))
query("reref_exclude", _reref_sql("label NOT IN ('Fp1', 'Oz')"))(lambda s, d: _shown(spatial.rereference(topographies(s, d), exclude=["Fp1", "Oz"])))
query("reref_channel", _reref_sql("label IN ('Pz', 'C3')"))(lambda s, d: _shown(spatial.rereference(topographies(s, d), "channel", ["Pz", "C3"])))
query("reref_mastoids", _reref_sql("label IN ('M1', 'M2')"))(lambda s, d: _shown(spatial.rereference(topographies(s, d), "mastoids")))
query("reref_cz", _reref_sql("label = 'Cz'"))(lambda s, d: _shown(spatial.rereference(topographies(s, d), "cz")))
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
query("reref_rest", f"""WITH {TOPO_SQL}, w0 AS (SELECT a.label AS dst, b.label AS src, 1 / greatest({DIST}, 1e-10) AS w FROM pos a JOIN pos b ON a.label <> b.label),
w AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM w0),
m AS (SELECT s, dst, sum(v * w) AS ref FROM topo JOIN w ON w.src = topo.label GROUP BY s, dst)
SELECT topo.s, ch, label, {r('v - ref')} AS v FROM topo JOIN m ON m.s = topo.s AND m.dst = topo.label""")(
    lambda s, d: _shown(spatial.rereference(topographies(s, d), "rest", positions=positions(s).where(F.col("label") != "TP10")))
)
BAD = ["Fz", "P3", "Oz"]
query("interpolate_nearest", f"""WITH {TOPO_SQL}, w0 AS (SELECT a.label AS dst, b.label AS src, 1 / greatest({DIST}, 1e-10) AS w FROM pos a, pos b WHERE a.label IN {tuple(BAD)} AND b.label NOT IN {tuple(BAD)}),
w AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM w0),
m AS (SELECT s, dst AS label, sum(v * w) AS v FROM topo JOIN w ON w.src = topo.label GROUP BY s, dst)
SELECT m.s, p.ch, m.label, {r('m.v')} AS v FROM m JOIN pos p USING (label) UNION ALL SELECT s, ch, label, {r('v')} FROM topo WHERE label NOT IN {tuple(BAD)}""")(
    lambda s, d: _shown(spatial.interpolate(topographies(s, d), BAD, positions(s).where(F.col("label") != "TP10"), "nearest"))
)


def _spline_sql() -> str:
    sites = {k: SYSTEM_1010[k] for k in list(SYSTEM_1010)[:64]}
    good = [k for k in sites if k not in BAD]
    w = spline_weights(np.array([sites[k] for k in good]), np.array([sites[k] for k in sites if k in BAD]))
    rows = ", ".join(f"('{b}', '{g}', {float(w[i, j])!r}::DOUBLE)" for i, b in enumerate(k for k in sites if k in BAD) for j, g in enumerate(good))
    return f"""WITH {TOPO_SQL}, w(dst, src, w) AS (VALUES {rows}), m AS (SELECT s, dst AS label, sum(v * w) AS v FROM topo JOIN w ON w.src = topo.label GROUP BY s, dst)
SELECT m.s, p.ch, m.label, {r('m.v')} AS v FROM m JOIN pos p USING (label) UNION ALL SELECT s, ch, label, {r('v')} FROM topo WHERE label NOT IN {tuple(BAD)}"""


query("interpolate_spline", _spline_sql())(lambda s, d: _shown(spatial.interpolate(topographies(s, d), BAD, positions(s).where(F.col("label") != "TP10"))))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of the topographies with the number of their samples; some in lower case, some under a name of their own."""
    name = F.when(F.col("ch") % 7 == 0, F.concat(F.lit("X"), "label")).when(F.col("ch") % 2 == 0, F.lower("label")).otherwise(F.col("label"))
    return topographies(spark, sf_dir).groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n"))


query("montage_join", f"""WITH {TOPO_SQL}, c AS (SELECT CASE WHEN ch % 7 = 0 THEN 'X' || label WHEN ch % 2 = 0 THEN lower(label) ELSE label END AS label, count(*) AS n FROM topo GROUP BY 1)
SELECT c.label, n, x AS pos_x, y AS pos_y, z AS pos_z FROM c LEFT JOIN pos ON upper(c.label) = upper(pos.label)""")(
    lambda s, d: spatial.montage(_channels(s, d), "10-10").select("label", "n", "pos_x", "pos_y", "pos_z")
)


def _with_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signal(spark, sf_dir)
    return x.unionByName(x.where("ch = 1").withColumns({"ch": F.lit(6), "label": F.lit("flat"), "v": F.lit(0.0)}))


query("bad_channels", f"""WITH {SIGNAL_SQL}, x AS (SELECT ch, label, s, v FROM sig UNION ALL SELECT 6, 'flat', s, 0.0 FROM sig WHERE ch = 1),
st AS (SELECT label, var_samp(v) AS var FROM x GROUP BY label), o AS (SELECT *, median(var) OVER () AS mid FROM st),
q AS (SELECT label, var, (var - mid) / greatest((SELECT median(abs(var - mid)) FROM o), 1e-12) AS z FROM o),
p AS (SELECT a.label AS l1, b.label AS l2, CASE WHEN var_samp(a.v) * var_samp(b.v) > 0 THEN covar_samp(a.v, b.v) / sqrt(var_samp(a.v) * var_samp(b.v)) END AS c FROM x a JOIN x b ON a.s = b.s AND a.label <> b.label GROUP BY 1, 2),
m AS (SELECT l1 AS label, avg(c) AS r FROM p GROUP BY 1),
f AS (SELECT label, var, z, r, var < 1e-6 AS f1, z > 4 AS f2, coalesce(r < 0.4, false) AS f3 FROM q JOIN m USING (label))
SELECT label AS channel, f1 OR f2 OR f3 AS is_bad, concat_ws('; ', CASE WHEN f1 THEN 'flat' END, CASE WHEN f2 THEN 'noise' END, CASE WHEN f3 THEN 'correlation' END) AS reason,
{r('CASE WHEN f1 THEN var WHEN f2 THEN z WHEN f3 THEN r END')} AS score FROM f""")(lambda s, d: spatial.bad_channels(_with_flat(s, d)))

# --- filters -------------------------------------------------------------------

FILTERS = {"bandpass": (8.0, 13.0), "lowpass": (None, 20.0), "highpass": (4.0, None), "notch": (28.0, 32.0)}


def _filter_sql(kind: str) -> str:
    low, high = FILTERS[kind]
    taps = ", ".join(f"({i - ORDER // 2}, {float(h)!r}::DOUBLE)" for i, h in enumerate(fir_taps(kind, SR, low, high, ORDER)))
    return f"""WITH {SIGNAL_SQL}, taps(m, h) AS (VALUES {taps}), n AS (SELECT max(s) AS n FROM sig),
src AS (SELECT ch, label, s, h, least(greatest(s - m, 1), n) AS at FROM sig, taps, n)
SELECT src.s, src.ch, src.label, {r('sum(h * sig.v)')} AS v FROM src JOIN sig ON sig.ch = src.ch AND sig.s = src.at GROUP BY ALL"""


def _fir_sql(kind: str, low: float | None, high: float | None, view: str = "sig", by: str = "ch, label", n: int = 10**9) -> str:
    """nn (samples of a trace), f: the filter of default length over traces of view, ends held; for signals longer than the filter."""
    taps = fir_taps(kind, SR, low, high, fir_length(SR, high if kind == "lowpass" else low, n))
    rows = ", ".join(f"({i - len(taps) // 2}, {float(h)!r}::DOUBLE)" for i, h in enumerate(taps))
    return f"""tp(m, h) AS (VALUES {rows}), nn AS (SELECT max(s) AS n FROM {view}), tapped AS (SELECT {by}, s, h, least(greatest(s - m, 1), n) AS spot FROM {view}, tp, nn),
f AS (SELECT {by}, tapped.s, sum(h * y.v) AS v FROM tapped JOIN (SELECT {by}, s AS spot, v FROM {view}) y USING ({by}, spot) GROUP BY {by}, tapped.s)"""


for _kind, (_low, _high) in FILTERS.items():
    query(f"fir_{_kind}", _filter_sql(_kind))(lambda s, d, k=_kind, a=_low, b=_high: _shown(filtering.fir_filter(signal(s, d), k, SR, a, b, ORDER, block=512)))


def _iir_sql(low: float, high: float) -> str:
    """Both directions as sums over the impulse response: a steady start is a first sample that has always come in."""
    sections = butterworth(4, SR, low, high)
    response, _ = cascade(np.concatenate([[1.0], np.zeros(4095)]), sections, np.zeros(2 * len(sections)))
    size = int(np.flatnonzero(np.abs(response) > 1e-16).max()) + 1
    taps, pad = ", ".join(f"({m}, {float(h)!r}::DOUBLE)" for m, h in enumerate(response[:size])), 3 * (2 * len(sections) + 1)
    turned = "2 * e.v - x.v FROM sig x JOIN sig e ON e.ch = x.ch JOIN nn ON"
    passed = lambda view, spot: f"SELECT ch, label, t.s, sum(h * y.v) AS v FROM (SELECT ch, label, s, h, {spot} AS spot FROM {view}, tp, nn) t JOIN (SELECT ch, label, s AS spot, v FROM {view}) y USING (ch, label, spot) GROUP BY ch, label, t.s"
    return f"""WITH {SIGNAL_SQL}, tp(m, h) AS (VALUES {taps}), nn AS (SELECT max(s) AS n FROM sig),
ex AS (SELECT ch, label, s + {pad} AS s, v FROM sig UNION ALL SELECT x.ch, x.label, {pad + 2} - x.s, {turned} e.s = 1 WHERE x.s BETWEEN 2 AND {pad + 1}
UNION ALL SELECT x.ch, x.label, 2 * n + {pad} - x.s, {turned} e.s = n WHERE x.s BETWEEN n - {pad} AND n - 1),
y1 AS ({passed('ex', 'greatest(s - m, 1)')}), y2 AS ({passed('y1', f'least(s + m, n + {2 * pad})')})
SELECT y2.s - {pad} AS s, ch, label, {r('v')} AS v FROM y2, nn WHERE y2.s BETWEEN {pad + 1} AND n + {pad}"""


query("iir_bandpass", _iir_sql(4, 20))(lambda s, d: _shown(filtering.eeg_filter(signal(s, d), SR, 4, 20, method="iir")))

# --- epochs and artifacts --------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event every 2.25 s of the whole signal, the last one beyond its end."""
    n = length_of(signal(spark, sf_dir))
    return spark.range(n // 288 + 1).select(F.lit("r1").alias("recording_id"), F.col("id").cast("int").alias("pos"), (0.5 + 2.25 * F.col("id")).alias("onset_sec"))


A, B = round(-0.2 * SR), round(0.8 * SR)
CUT = f"""ev AS (SELECT i AS pos, 65 + 288 * i AS onset FROM (SELECT unnest(range((SELECT max(s) // 288 + 1 FROM sig))) AS i)), k AS (SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS epoch, onset FROM ev WHERE onset + {A} >= 1 AND onset + {B} <= (SELECT max(s) FROM sig)),
x AS (SELECT epoch, s - onset - {A} + 1 AS s, ch, label, v FROM k JOIN sig ON s BETWEEN onset + {A} AND onset + {B})"""
query("epoch_baseline", f"""WITH {SIGNAL_SQL}, {CUT}
SELECT epoch, CAST(s AS BIGINT) AS s, ch, label, {r(f'v - avg(CASE WHEN s <= {1 - A} THEN v END) OVER (PARTITION BY epoch, ch)')} AS v FROM x""")(
    lambda s, d: epochs.epoch_events(signal(s, d), _events(s, d), SR)[0]
)
SCORES = {
    "threshold": ("max(abs(v))", "ep", 400.0), "gradient": ("max(d)", "(SELECT epoch, abs(v - lag(v) OVER (PARTITION BY epoch, ch ORDER BY s)) AS d FROM ep)", 350.0),
    "joint_probability": (None, None, 1.0),
}


def _scores_sql(method: str) -> str:
    value, src, limit = SCORES[method]
    if method == "joint_probability":
        sc = "p AS (SELECT epoch, ln(greatest(avg(v * v), 1e-20)) AS p FROM ep GROUP BY epoch), sc AS (SELECT epoch, (p - avg(p) OVER ()) / greatest(stddev_samp(p) OVER (), 1e-12) AS value FROM p)"
    else:
        sc = f"sc AS (SELECT epoch, {value} AS value FROM {src} GROUP BY epoch)"
    return f"WITH {EPOCHED_SQL}, {sc}, bad AS (SELECT * FROM sc WHERE abs(value) > {limit})"


# a gradient limit of x per ms is x * 1000 / sr per sample
LIMITS = {"threshold": {"threshold_uv": 400.0}, "gradient": {"gradient_uv_ms": 350.0 * SR / 1000}, "joint_probability": {"jp_threshold": 1.0}}
for _m, _kw in LIMITS.items():
    query(f"artifact_{_m}", f"{_scores_sql(_m)} SELECT epoch, '{_m}' AS reason, {r('value')} AS value FROM bad")(lambda s, d, m=_m, kw=_kw: epochs.reject_artifacts(epoched(s, d), m, SR, **kw)[1])
query("artifact_clean", f"{_scores_sql('joint_probability')} SELECT epoch, s, ch, label, {r('v')} AS v FROM ep WHERE epoch NOT IN (SELECT epoch FROM bad)")(
    lambda s, d: epochs.reject_artifacts(epoched(s, d), "joint_probability", SR, **LIMITS["joint_probability"])[0].select("epoch", "s", "ch", "label", "v")
)
query("artifact_summary", f"""{_scores_sql('joint_probability')} SELECT 'joint_probability' AS method, count(*) AS n_total, count(bad.epoch) AS n_rejected, count(*) - count(bad.epoch) AS n_retained,
string_agg(CAST(bad.epoch AS VARCHAR), ',' ORDER BY bad.epoch) AS rejected_epochs FROM sc LEFT JOIN bad USING (epoch)""")(
    lambda s, d: epochs.reject_artifacts(epoched(s, d), "joint_probability", SR, **LIMITS["joint_probability"])[2].withColumn("rejected_epochs", F.array_join(F.col("rejected_epochs").cast("array<string>"), ","))
)

# --- potentials ------------------------------------------------------------------

AVG = f"WITH {EPOCHED_SQL}, m AS (SELECT ch, label, s, avg(v) AS v FROM ep GROUP BY ch, label, s)"


def _ms(a: float, b: float) -> tuple[int, int]:
    return tuple(max(1, math.floor(x / 1000 * SR) + 1) for x in (a, b))


for _c, (_w, _sign) in erp.COMPONENTS.items():
    _a, _b = _ms(*_w)
    query(f"erp_detect_{_c.lower()}", f"""{AVG}, p AS (SELECT label, arg_max(s, {_sign} * v) AS s, {_sign} * max({_sign} * v) AS v FROM (SELECT * FROM m WHERE s BETWEEN {_a} AND {_b} ORDER BY s) GROUP BY label)
SELECT label AS channel, '{_c}' AS component, {r(f'(s - 1) / {SR} * 1000')} AS latency_ms, {r('v')} AS amplitude FROM p""")(lambda s, d, c=_c: erp.detect(epoched(s, d), SR, c))
_a, _b = _ms(200, 600)
PEAK = f"p AS (SELECT ch, label, arg_max(s, v) AS s, max(v) AS v FROM (SELECT * FROM m WHERE s BETWEEN {_a} AND {_b} ORDER BY s) GROUP BY ch, label)"
HALF = round(0.025 * SR)
query("erp_measure_peak", f"{AVG}, {PEAK} SELECT label AS channel, {r('v')} AS amplitude, {r(f'(s - 1) / {SR} * 1000')} AS latency_ms, 'peak' AS method FROM p")(lambda s, d: erp.measure(epoched(s, d), SR, (200, 600), "peak"))
query("erp_measure_mean", f"{AVG} SELECT label AS channel, {r('avg(v)')} AS amplitude, CAST(400.0 AS DOUBLE) AS latency_ms, 'mean' AS method FROM m WHERE s BETWEEN {_a} AND {_b} GROUP BY label")(lambda s, d: erp.measure(epoched(s, d), SR, (200, 600), "mean"))
query("erp_measure_adaptive", f"{AVG}, {PEAK} SELECT p.label AS channel, {r('avg(m.v)')} AS amplitude, {r(f'(p.s - 1) / {SR} * 1000')} AS latency_ms, 'adaptive_mean' AS method FROM p JOIN m ON m.ch = p.ch AND m.s BETWEEN p.s - {HALF} AND p.s + {HALF} GROUP BY p.label, p.s")(
    lambda s, d: erp.measure(epoched(s, d), SR, (200, 600), "adaptive_mean")
)
query("erp_latency", f"""{AVG}, c AS (SELECT label, s, sum(greatest(v, 0)) OVER (PARTITION BY label ORDER BY s) AS cum, sum(greatest(v, 0)) OVER (PARTITION BY label) AS total FROM m WHERE s BETWEEN {_a} AND {_b})
SELECT label AS channel, {r(f'coalesce((min(CASE WHEN total > 0 AND cum >= total * 0.5 THEN s END) - 1) / {SR} * 1000, 400)')} AS latency_ms, CAST(0.5 AS DOUBLE) AS fraction FROM c GROUP BY label""")(
    lambda s, d: erp.latency(epoched(s, d), SR, (200, 600))
)


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Epochs 1, 3, 5… and 2, 4, 6… as two recordings of equal shape, both numbered 1, 2, 3…"""
    x = epoched(s, d)
    pairs = (x.agg(F.max("epoch")).first()[0] or 0) // 2
    odd = x.where("epoch % 2 = 1").withColumn("epoch", ((F.col("epoch") + 1) / 2).cast("int")).where(F.col("epoch") <= pairs)
    even = x.where("epoch % 2 = 0").withColumn("epoch", (F.col("epoch") / 2).cast("int"))
    return odd, even


TWO = f"WITH {EPOCHED_SQL}, a AS (SELECT CAST((epoch + 1) // 2 AS INTEGER) AS epoch, s, ch, label, v FROM ep WHERE epoch % 2 = 1 AND epoch < (SELECT max(epoch) // 2 * 2 FROM ep)), b AS (SELECT CAST(epoch // 2 AS INTEGER) AS epoch, s, ch, label, v FROM ep WHERE epoch % 2 = 0)"
query("erp_difference", f"{TWO} SELECT epoch, s, ch, a.label, {r('a.v - b.v')} AS v FROM a JOIN b USING (epoch, s, ch)")(lambda s, d: erp.difference(*_halves(s, d)))
query("erp_grand_average", f"{TWO} SELECT epoch, s, ch, a.label, {r('(a.v + b.v) / 2')} AS v FROM a JOIN b USING (epoch, s, ch)")(lambda s, d: erp.grand_average(list(_halves(s, d))))
_a, _b = _ms(0, 200)
query("erp_baseline", f"WITH {EPOCHED_SQL} SELECT epoch, s, ch, label, condition, {r(f'v - avg(CASE WHEN s BETWEEN {_a} AND {_b} THEN v END) OVER (PARTITION BY epoch, ch)')} AS v FROM ep")(
    lambda s, d: erp.baseline(epoched(s, d), SR, (0, 200))
)
query("erp_welch_t", f"""WITH {EPOCHED_SQL}, c AS (SELECT epoch, condition, s, avg(v) AS v FROM ep GROUP BY ALL), g AS (SELECT condition, s, avg(v) AS m, var_samp(v) AS q, count(*) AS n FROM c GROUP BY ALL)
SELECT x.s AS time_sample, {r('(x.m - y.m) / sqrt(x.q / x.n + y.q / y.n)')} AS t_statistic FROM g x JOIN g y ON x.s = y.s AND x.condition = 'target' AND y.condition = 'standard'""")(
    lambda s, d: erp.welch_t(epoched(s, d).where("condition = 'target'"), epoched(s, d).where("condition = 'standard'"))
)
for _m in ("permutation", "cluster"):
    query(f"erp_{_m}")(lambda s, d, m=_m: erp.permutation_test(epoched(s, d).where("condition = 'target'"), epoched(s, d).where("condition = 'standard'"), method=m))

# --- spectra -----------------------------------------------------------------------


def _dft_sql(view: str, by: str, n: int, hop: int, bins_: int, window: str = "0.5 - 0.5 * cos(2 * {pi} * t / ({n} - 1))", limit: str = "") -> str:
    w = window.format(pi=PI, n=n)
    return f"""wn AS (SELECT unnest(range(0, CAST((SELECT (max(s) - {n}) // {hop} + 1 FROM {view}) AS BIGINT))) AS win),
wx0 AS (SELECT {by}, win, s - 1 - win * {hop} AS t, v FROM {view} JOIN wn ON s BETWEEN win * {hop} + 1 AND win * {hop} + {n}),
wx AS (SELECT {by}, win, t, v * ({w}) AS v FROM wx0), bn AS (SELECT k, k * {SR} / {n} AS freq FROM (SELECT unnest(range({bins_})) AS k) {limit}),
sp AS (SELECT {by}, win, k, freq, sum(v * cos(-2 * {PI} / {n} * ((k * t) % {n}))) AS re, sum(v * sin(-2 * {PI} / {n} * ((k * t) % {n}))) AS im FROM wx, bn GROUP BY {by}, win, k, freq)"""


N_STFT = 64
query("stft", f"""WITH {SIGNAL_SQL}, {_dft_sql('sig', 'ch, label', N_STFT, 16, N_STFT // 2 + 1)}
SELECT CAST(NULL AS INTEGER) AS epoch, ch, label, CAST(win + 1 AS INTEGER) AS time_bin, {r(f'(win * 16 + 32.0) / {SR}')} AS time_sec, {r('freq')} AS freq, {r(f"(re * re + im * im) / {timefreq.window_energy('hanning', N_STFT)!r}")} AS power FROM sp""")(lambda s, d: timefreq.stft(signal(s, d), SR))
N_W = 256
WELCH = f"WITH {SIGNAL_SQL}, {_dft_sql('sig', 'ch, label', N_W, N_W // 2, N_W // 2 + 1)}"
_bands = ", ".join(f"('{b}', {x}, {y})" for b, (x, y) in clinical.BANDS.items())
query("qeeg", f"""WITH {SIGNAL_SQL}, {_dft_sql('sig', 'ch, label', N_W, N_W // 2, N_W // 2)}, psd AS (SELECT ch, label, freq, avg(re * re + im * im) / ({SR} * {timefreq.window_energy('hanning', N_W)!r}) AS p FROM sp GROUP BY ALL),
bd(band, low, high) AS (VALUES {_bands}), a AS (SELECT ch, label, band, sum(CASE WHEN freq BETWEEN low AND high THEN p ELSE 0 END) AS p FROM psd, bd GROUP BY ALL)
SELECT ch, label, band, {r('p')} AS absolute_power, {r('p / sum(p) OVER (PARTITION BY ch)')} AS relative_power FROM a""")(lambda s, d: clinical.qeeg(signal(s, d), SR))
WHOLE = f"""WITH {SIGNAL_SQL}, nn AS (SELECT max(s) AS n FROM sig), bn AS (SELECT k, k * {SR} / n AS freq, n FROM nn, (SELECT unnest(range((SELECT n // 2 + 1 FROM nn))) AS k)),
sp AS (SELECT ch, label, k, freq, n, sum(v * cos(-2 * {PI} / n * ((k * (s - 1)) % n))) AS re, sum(v * sin(-2 * {PI} / n * ((k * (s - 1)) % n))) AS im FROM sig, bn GROUP BY ALL),
pg AS (SELECT ch, label, freq, (re * re + im * im) / n AS p FROM sp)"""


def _sum(a: float, b: float) -> str:
    return f"sum(CASE WHEN freq BETWEEN {a} AND {b} THEN p ELSE 0 END)"


query("band_power", f"{WHOLE} SELECT ch, label, " + ", ".join(f"{r(_sum(*v))} AS {k}" for k, v in clinical.BANDS.items()) + " FROM pg GROUP BY ch, label")(lambda s, d: clinical.band_power(signal(s, d), SR, clinical.BANDS))
query("asymmetry", f"""{WHOLE}, b AS (SELECT label, greatest({_sum(8, 13)}, 2.220446049250313e-16) AS p FROM pg GROUP BY label)
SELECT 'view-click' AS pair, 'click' AS left_channel, 'view' AS right_channel, {r('y.p')} AS left_power, {r('x.p')} AS right_power, {r('ln(x.p) - ln(y.p)')} AS asymmetry_index FROM b x, b y WHERE x.label = 'view' AND y.label = 'click'""")(
    lambda s, d: clinical.asymmetry(signal(s, d), SR, [("view", "click"), ("nothing", "click")])
)
query("slowing_tdr", f"{WHOLE}, b AS (SELECT ch, {_sum(4, 8)} / {_sum(1, 4)} AS v FROM pg GROUP BY ch) SELECT ch AS channel, 'tdr' AS metric, {r('v')} AS value, CASE WHEN v > 1 THEN 'mild_slowing' ELSE 'normal' END AS classification FROM b")(lambda s, d: clinical.slowing(signal(s, d), SR, "tdr"))
query("slowing_dtar", f"""{WHOLE}, b AS (SELECT ch, ({_sum(1, 4)} + {_sum(4, 8)}) / ({_sum(8, 13)} + {_sum(13, 30)}) AS v FROM pg GROUP BY ch)
SELECT ch AS channel, 'dtar' AS metric, {r('v')} AS value, CASE WHEN v < 1 THEN 'normal' WHEN v < 2 THEN 'mild_slowing' WHEN v < 4 THEN 'moderate_slowing' ELSE 'severe_slowing' END AS classification FROM b""")(lambda s, d: clinical.slowing(signal(s, d), SR, "dtar"))
query("slowing_peak", f"""{WHOLE}, b AS (SELECT ch, arg_max(freq, p) AS v FROM pg WHERE freq BETWEEN 1 AND 30 GROUP BY ch)
SELECT ch AS channel, 'peak_frequency' AS metric, {r('v')} AS value, CASE WHEN v >= 8 THEN 'normal' WHEN v >= 6 THEN 'mild_slowing' WHEN v >= 4 THEN 'moderate_slowing' ELSE 'severe_slowing' END AS classification FROM b""")(lambda s, d: clinical.slowing(signal(s, d), SR, "peak_frequency"))
query("multitaper")(lambda s, d: timefreq.multitaper(signal(s, d), SR))


def _wavelet_sql(view: str, by: str, freqs: list[float], n_cycles: float = 7) -> str:
    """cf: coefficients of unit-energy wavelets centred on each sample, nothing beyond the ends."""
    rows = []
    for f in freqs:
        sigma = n_cycles / (2 * math.pi * f)
        half = math.ceil(3 * sigma * SR)
        w = {m: math.exp(-((m / SR) ** 2) / (2 * sigma**2)) for m in range(-half, half + 1)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [f"({float(f)!r}::DOUBLE, {m}, {x / norm * math.cos(2 * math.pi * f * m / SR)!r}::DOUBLE, {-x / norm * math.sin(2 * math.pi * f * m / SR)!r}::DOUBLE)" for m, x in w.items()]
    return f"wv(freq, m, a, b) AS (VALUES {', '.join(rows)}), cf AS (SELECT {by}, s - m AS s, freq, sum(v * a) AS re, sum(v * b) AS im FROM {view}, wv WHERE s - m BETWEEN 1 AND (SELECT max(s) FROM {view}) GROUP BY ALL)"


FAINT = 1e-6  # power below which a phase says nothing
query("morlet", f"""WITH {SIGNAL_SQL}, {_wavelet_sql('sig', 'ch, label', [4, 10, 20])} SELECT CAST(NULL AS INTEGER) AS epoch, ch, label, s, freq, {r('re * re + im * im')} AS power, CASE WHEN re * re + im * im > {FAINT} THEN {r('atan2(im, re)')} END AS phase FROM cf""")(
    lambda s, d: timefreq.wavelet(signal(s, d), SR, [4, 10, 20]).withColumn("phase", F.when(F.col("power") > FAINT, F.col("phase")))
)
EPW = f"WITH {EPOCHED_SQL}, {_wavelet_sql('ep', 'ch, label, epoch', [8, 16])}"
query("ersp", f"{EPW}, p AS (SELECT s, freq, ch, label, avg(re * re + im * im) AS p FROM cf GROUP BY ALL) SELECT s, freq, ch, label, {r('10 * log10(p / greatest(avg(CASE WHEN s BETWEEN 1 AND 50 THEN p END) OVER (PARTITION BY ch, freq), 2.220446049250313e-16))')} AS ersp_db FROM p")(
    lambda s, d: timefreq.ersp(epoched(s, d), SR, [8, 16])
)
query("itc", f"{EPW}, u AS (SELECT s, freq, ch, label, avg(re / sqrt(re * re + im * im)) AS x, avg(im / sqrt(re * re + im * im)) AS y FROM cf GROUP BY ALL) SELECT s, freq, ch, label, {r('sqrt(x * x + y * y)')} AS itc FROM u")(
    lambda s, d: timefreq.itc(epoched(s, d), SR, [8, 16])
)

# --- coupling ------------------------------------------------------------------------

PAIRS = f"""{WELCH}, pr AS (SELECT a.label AS ch1, b.label AS ch2, a.win, a.k, a.freq, a.re * b.re + a.im * b.im AS c, a.im * b.re - a.re * b.im AS q, a.re * a.re + a.im * a.im AS x, b.re * b.re + b.im * b.im AS y
FROM sp a JOIN sp b ON a.win = b.win AND a.k = b.k AND a.ch < b.ch WHERE a.freq BETWEEN 8 AND 13),
cs AS (SELECT ch1, ch2, k, avg(c) AS c, avg(q) AS q, avg(x) AS x, avg(y) AS y FROM pr GROUP BY ALL),
co AS (SELECT ch1, ch2, avg((c * c + q * q) / greatest(x * y, 2.220446049250313e-16)) AS coh, avg(abs(q / sqrt(greatest(x * y, 2.220446049250313e-16)))) AS img FROM cs GROUP BY ALL)"""
query("coherence", f"{PAIRS} SELECT ch1, ch2, {r('coh')} AS value FROM co")(lambda s, d: connectivity.coherence(signal(s, d), SR))
query("imag_coherence", f"{PAIRS} SELECT ch1, ch2, {r('img')} AS value FROM co")(lambda s, d: connectivity.coherence(signal(s, d), SR, "imaginary"))
query("connectivity_matrix", f"{PAIRS} SELECT ch1 AS a, ch2 AS b, {r('coh')} AS value FROM co UNION ALL SELECT ch2, ch1, {r('coh')} FROM co UNION ALL SELECT DISTINCT label, label, CAST(1 AS DOUBLE) FROM sig")(lambda s, d: connectivity.connectivity_matrix(signal(s, d), SR))
query("wpli", f"""{PAIRS}, w AS (SELECT ch1, ch2, win, avg(q) AS q FROM pr GROUP BY ALL), z AS (SELECT ch1, ch2, CASE WHEN avg(abs(q)) < 2.220446049250313e-16 THEN 0 ELSE abs(avg(q)) / avg(abs(q)) END AS v, count(*) AS n FROM w GROUP BY ALL)
SELECT ch1 AS channel1, ch2 AS channel2, {r('v')} AS wpli, {r('greatest(0, (n * v * v - 1) / (n - 1))')} AS wpli_debiased FROM z""")(lambda s, d: connectivity.wpli(signal(s, d), SR))
query("plv", f"""WITH {SIGNAL_SQL}, {_fir_sql('bandpass', 8.0, 13.0)}, hk AS (SELECT m, CASE WHEN m = 0 THEN 0 ELSE 2.0::DOUBLE / n * sin({PI} * m / n * ((n - 1) // 2)) * sin({PI} * m / n * ((n - 1) // 2 + 1)) / sin({PI} * m / n) END AS h FROM (SELECT unnest(range((SELECT n FROM nn))) AS m), nn),
pt AS (SELECT f.ch, f.label, f.s, f.v, g.v AS w, (f.s - g.s + n) % n AS m FROM f JOIN f g ON g.ch = f.ch CROSS JOIN nn),
an AS (SELECT ch, label, s, any_value(v) AS re, sum(w * h) AS im FROM pt JOIN hk USING (m) GROUP BY ch, label, s),
ph AS (SELECT ch, label, s, re / sqrt(re * re + im * im) AS c, im / sqrt(re * re + im * im) AS q FROM an)
SELECT a.label AS channel1, b.label AS channel2, {r('sqrt(avg(a.c * b.c + a.q * b.q) * avg(a.c * b.c + a.q * b.q) + avg(a.q * b.c - a.c * b.q) * avg(a.q * b.c - a.c * b.q))')} AS plv FROM ph a JOIN ph b ON a.s = b.s AND a.ch < b.ch GROUP BY ALL""")(lambda s, d: connectivity.plv(signal(s, d), SR))
query("granger")(lambda s, d: connectivity.granger(signal(s, d), SR))
query("connectivity_heatmap", f"{PAIRS}, mx AS (SELECT ch1 AS a, ch2 AS b, coh AS v FROM co UNION ALL SELECT ch2, ch1, coh FROM co UNION ALL SELECT DISTINCT label, label, 1.0 FROM sig) SELECT a, b, CASE WHEN v >= 0.2 THEN {r('v')} END AS value FROM mx")(
    lambda s, d: plots.connectivity_frame(connectivity.connectivity_matrix(signal(s, d), SR), "heatmap", 0.2)
)
query("connectivity_edges", f"""{PAIRS}, nd AS (SELECT label, 2 * {PI} * (row_number() OVER (ORDER BY label) - 1) / count(*) OVER () AS g FROM (SELECT DISTINCT label FROM sig))
SELECT least(ch1, ch2) AS a, greatest(ch1, ch2) AS b, {r('coh')} AS value, {r('cos(x.g)')} AS x_a, {r('sin(x.g)')} AS y_a, {r('cos(y.g)')} AS x_b, {r('sin(y.g)')} AS y_b
FROM co JOIN nd x ON x.label = least(ch1, ch2) JOIN nd y ON y.label = greatest(ch1, ch2) WHERE coh > 0.01""")(lambda s, d: plots.connectivity_frame(connectivity.connectivity_matrix(signal(s, d), SR), "circle", 0.01))

# --- sleep and clinical -----------------------------------------------------------------

N_S = 128
query("sleep_stage", f"""WITH {SIGNAL_SQL}, {_dft_sql('sig', 'ch', N_S, N_S, N_S // 2, '1.0')}, b AS (SELECT ch, win, """ + ", ".join(f"sum(CASE WHEN {c} THEN (re * re + im * im) / {N_S} ELSE 0 END) AS {n}" for n, c in sleep.STAGE_BANDS.items()) + f""" FROM sp GROUP BY ch, win),
m AS (SELECT win, """ + ", ".join(f"avg({n}) AS {n}" for n in sleep.STAGE_BANDS) + f""" FROM b GROUP BY win)
SELECT CAST(win + 1 AS INTEGER) AS epoch, CASE WHEN delta / total > 0.4 THEN 'N3' WHEN alpha / total > 0.3 THEN 'W' WHEN sigma / total > 0.05 THEN 'N2' WHEN theta > delta AND alpha / total < 0.2 THEN 'REM' ELSE 'N1' END AS stage,
CAST(win * {N_S} + 1 AS BIGINT) AS start_sample, CAST((win + 1) * {N_S} AS BIGINT) AS end_sample, """ + ", ".join(f"{r(n)} AS {n}_power" for n in sleep.STAGE_BANDS if n != "total") + " FROM m")(lambda s, d: sleep.sleep_stages(signal(s, d), SR, 1))
query("sleep_metrics", f"""WITH {STAGES_SQL}, o AS (SELECT min(CASE WHEN stage <> 'W' THEN epoch END) AS onset FROM st),
a AS (SELECT count(*) AS n, count(*) FILTER (stage <> 'W') AS tst, min(epoch) AS e0, min(onset) AS onset, count(*) FILTER (stage = 'W' AND epoch > onset) AS waso, min(CASE WHEN stage = 'REM' THEN epoch END) AS rem,
count(*) FILTER (stage = 'N1') AS n1, count(*) FILTER (stage = 'N2') AS n2, count(*) FILTER (stage = 'N3') AS n3, count(*) FILTER (stage = 'REM') AS nr, count(*) FILTER (stage = 'W') AS w FROM st, o)
SELECT metric, {r('CAST(value AS DOUBLE)')} AS value, unit FROM a, LATERAL (VALUES ('total_sleep_time', tst * 0.5::DOUBLE, 'min'), ('sleep_efficiency', 100.0::DOUBLE * tst / n, '%'), ('sleep_latency', (onset - e0) * 0.5::DOUBLE, 'min'), ('waso', waso * 0.5::DOUBLE, 'min'), ('rem_latency', (rem - onset) * 0.5::DOUBLE, 'min'),
('pct_N1', 100.0::DOUBLE * n1 / tst, '%'), ('pct_N2', 100.0::DOUBLE * n2 / tst, '%'), ('pct_N3', 100.0::DOUBLE * n3 / tst, '%'), ('pct_REM', 100.0::DOUBLE * nr / tst, '%'), ('pct_W', 100.0::DOUBLE * w / n, '%')) x(metric, value, unit)""")(lambda s, d: sleep.sleep_metrics(stages(s, d)))
query("hypnogram", f"WITH {STAGES_SQL} SELECT epoch, stage, {r('(epoch - 1) * 30 / 60.0')} AS time_min, CAST(CASE stage WHEN 'N3' THEN 1 WHEN 'N2' THEN 2 WHEN 'N1' THEN 3 WHEN 'REM' THEN 4 WHEN 'W' THEN 5 END AS INTEGER) AS height FROM st")(lambda s, d: plots.hypnogram_frame(stages(s, d)))
_half = max(1, round(0.2 * SR)) // 2
_short, _long = round(0.1 * SR), round(2 * SR)
query("spindles", f"""WITH {SIGNAL_SQL}, {_fir_sql('bandpass', 11, 16)}, e AS (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY ch ORDER BY s ROWS BETWEEN {_half} PRECEDING AND {_half} FOLLOWING)) AS env FROM f),
l AS (SELECT ch, avg(env) + 0.5 * stddev_samp(env) AS lim FROM e GROUP BY ch), h AS (SELECT ch, s, v, env, s - row_number() OVER (PARTITION BY ch ORDER BY s) AS g FROM e JOIN l USING (ch) WHERE env > lim),
t AS (SELECT *, lag(v) OVER (PARTITION BY ch, g ORDER BY s) AS p FROM h), q AS (SELECT ch, min(s) AS a, max(s) AS b, max(s) - min(s) + 1 AS n, arg_max(s, env) AS pk, max(env) AS amp, count(*) FILTER (sign(v) <> sign(p)) AS turns FROM t GROUP BY ch, g)
SELECT ch AS channel, a AS start_sample, b AS end_sample, {r(f'n / {SR} * 1000')} AS duration_ms, pk AS peak_sample, {r('amp')} AS peak_amplitude, {r(f'turns / 2 / (n / {SR})')} AS frequency_hz FROM q WHERE n BETWEEN {_short} AND {_long}""")(
    lambda s, d: sleep.spindles(signal(s, d), SR, threshold_sd=0.5, min_duration_ms=100)
)
query("k_complexes", f"""WITH {SIGNAL_SQL}, {_fir_sql('lowpass', None, 4)}, w AS (SELECT *, lag(v) OVER (PARTITION BY ch ORDER BY s) AS p, lead(v) OVER (PARTITION BY ch ORDER BY s) AS q FROM f),
lo AS (SELECT ch, s AS np, v AS na, s + {round(0.5 * SR)} AS a, least(s + {round(1.5 * SR)}, n) AS b FROM w, nn WHERE v < p AND v <= q AND v < 60),
hi AS (SELECT lo.ch, np, na, arg_max(f.s, f.v) AS pp, max(f.v) AS pa FROM lo JOIN f ON f.ch = lo.ch AND f.s BETWEEN a AND b WHERE a < b GROUP BY ALL)
SELECT ch AS channel, np AS negative_peak_sample, pp AS positive_peak_sample, {r('na')} AS negative_amplitude, {r('pa')} AS positive_amplitude, {r(f'(pp - np) / {SR} * 1000')} AS duration_ms FROM hi WHERE pa > 0 AND pp - np BETWEEN {_short} AND {round(1.5 * SR)}""")(
    lambda s, d: sleep.k_complexes(signal(s, d), SR, min_neg_amplitude=-60, min_duration_ms=100)
)
query("slow_waves", f"""WITH {SIGNAL_SQL}, {_fir_sql('bandpass', 0.5, 2)}, g AS (SELECT *, CASE WHEN v < 0 THEN -1 ELSE 1 END AS sg FROM f), z AS (SELECT ch, s, row_number() OVER (PARTITION BY ch ORDER BY s) AS i FROM (SELECT ch, s, sg <> lead(sg) OVER (PARTITION BY ch ORDER BY s) AS turn FROM g) WHERE turn),
w AS (SELECT a.ch, a.s AS a, b.s AS b, coalesce(c.s, least((SELECT n FROM nn), b.s + {SR:.0f})) AS c FROM z a JOIN z b ON b.ch = a.ch AND b.i = a.i + 1 LEFT JOIN z c ON c.ch = a.ch AND c.i = a.i + 2),
x AS (SELECT w.ch, a, b, min(CASE WHEN s <= b THEN v END) AS lo, max(CASE WHEN s > b THEN v END) AS hi FROM w JOIN f ON f.ch = w.ch AND s BETWEEN a + 1 AND c GROUP BY ALL)
SELECT ch AS channel, a AS start_sample, b AS end_sample, {r('lo')} AS negative_peak, {r('hi')} AS positive_peak, {r(f'(b - a) / {SR} * 1000')} AS duration_ms, {r(f'(hi - lo) / ((b - a) / {SR} * 1000)')} AS slope FROM x WHERE lo <= -1 AND b - a BETWEEN {round(0.25 * SR)} AND {SR:.0f}""")(
    lambda s, d: sleep.slow_waves(signal(s, d), SR, min_amplitude=1)
)


def _centred(s: SparkSession, d: str) -> DataFrame:
    return signal(s, d).withColumn("v", F.col("v") - 60)


LOW, HIGH = 1, round(0.2 * SR)
query("spikes_morphology", f"""WITH {SIGNAL_SQL}, x AS (SELECT ch, s, v - 60 AS v FROM sig), dd AS (SELECT *, abs(coalesce(lead(v) OVER (PARTITION BY ch ORDER BY s) - v, 0)) AS d FROM x),
st AS (SELECT ch, avg(d) + 1.0 * stddev_samp(d) AS lim, avg(abs(v)) + 2 * stddev_samp(v) AS ref FROM dd GROUP BY ch),
h AS (SELECT dd.ch, s, ref, CASE WHEN s - lag(s) OVER (PARTITION BY dd.ch ORDER BY s) > {HIGH} THEN 1 ELSE 0 END AS new FROM dd JOIN st USING (ch) WHERE d > lim),
g0 AS (SELECT *, sum(new) OVER (PARTITION BY ch ORDER BY s) AS g FROM h), g AS (SELECT ch, g, ref, min(s) AS a, max(s) AS b, max(s) - min(s) + 1 AS n FROM g0 GROUP BY ALL HAVING max(s) - min(s) + 1 BETWEEN {LOW} AND {HIGH}),
p AS (SELECT g.ch, g.g, n, ref, arg_max(x.s, abs(x.v)) AS s, arg_max(x.v, abs(x.v)) AS v FROM g JOIN x ON x.ch = g.ch AND x.s BETWEEN a - {LOW} AND b + {LOW} GROUP BY ALL)
SELECT ch AS channel, s AS sample, {r(f'(s - 1) / {SR}')} AS time_sec, {r('abs(v)')} AS amplitude, {r(f'n / {SR} * 1000')} AS duration_ms, {r('least(1, abs(v) / ref)')} AS confidence FROM p WHERE abs(v) >= 50""")(
    lambda s, d: clinical.spikes(_centred(s, d), SR, threshold_sd=1, min_duration_ms=5)
)
_template = [float(x) for x in clinical.spike_template(SR, 40)]
_rows = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(_template))
query("spikes_template", f"""WITH {SIGNAL_SQL}, x AS (SELECT ch, s, v - 60 AS v FROM sig), tp(i, h) AS (VALUES {_rows}),
k AS (SELECT x.ch, x.s, CASE WHEN sum(y.v * y.v) > 0 THEN sum(h * y.v) / sqrt(sum(y.v * y.v)) ELSE 0 END AS c FROM x CROSS JOIN tp JOIN x y ON y.ch = x.ch AND y.s = x.s + i GROUP BY x.ch, x.s HAVING count(*) = {len(_template)}),
h AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY ch ORDER BY s) > {round(0.04 * SR)} THEN 1 ELSE 0 END AS new FROM k WHERE c > 0.7), g AS (SELECT *, sum(new) OVER (PARTITION BY ch ORDER BY s) AS g FROM h),
b AS (SELECT ch, g, arg_max(s, c) AS a, max(c) AS c FROM g GROUP BY ch, g), p AS (SELECT b.ch, g, c, arg_max(x.s, abs(x.v)) AS s, max(abs(x.v)) AS v FROM b JOIN x ON x.ch = b.ch AND x.s BETWEEN a AND a + {len(_template) - 1} GROUP BY ALL)
SELECT ch AS channel, s AS sample, {r(f'(s - 1) / {SR}')} AS time_sec, {r('v')} AS amplitude, {r(f'{len(_template)} / {SR} * 1000')} AS duration_ms, {r('c')} AS confidence FROM p WHERE v >= 50""")(
    lambda s, d: clinical.spikes(_centred(s, d), SR, "template", max_duration_ms=40)
)
query("suppression", f"""WITH {SIGNAL_SQL}, wd AS (SELECT (s - 1) // 8 + 1 AS s, sqrt(avg(v * v)) < 60 AS q FROM sig WHERE (s - 1) // 8 + 1 <= (SELECT max(s) // 8 FROM sig) GROUP BY 1),
a AS (SELECT *, s - row_number() OVER (PARTITION BY q ORDER BY s) AS g FROM wd), b AS (SELECT s, q AND count(*) OVER (PARTITION BY q, g) * 8 / {SR} * 1000 >= 125 AS q FROM a),
c AS (SELECT *, s - row_number() OVER (PARTITION BY q ORDER BY s) AS g FROM b)
SELECT CASE WHEN q THEN 'suppression' ELSE 'burst' END AS type, CAST((min(s) - 1) * 8 + 1 AS BIGINT) AS start_sample, CAST(max(s) * 8 AS BIGINT) AS end_sample, {r(f'(max(s) - min(s) + 1) * 8 / {SR} * 1000')} AS duration_ms FROM c GROUP BY q, g""")(
    lambda s, d: clinical.suppression(signal(s, d), SR, 60, 125, 62.5)[0]
)

# --- microstates -------------------------------------------------------------------------

GFP = f"WITH {TOPO_SQL}, gf AS (SELECT s, stddev_pop(v) AS gfp FROM topo GROUP BY s)"
MAPS = "mp AS (SELECT CAST(class + 1 AS INTEGER) AS state, ch, avg(v) AS w FROM topo GROUP BY ALL)"
FIT = f"{GFP}, {MAPS}, nm AS (SELECT state, greatest(sqrt(sum(w * w)), 1e-10) AS n FROM mp GROUP BY state), ft AS (SELECT s, state, abs(sum(v * w)) / any_value(n) AS c FROM topo JOIN mp USING (ch) JOIN nm USING (state) GROUP BY s, state), lb AS (SELECT s, arg_max(state, c) AS label FROM ft GROUP BY s)"


def _labels(s: SparkSession, d: str) -> DataFrame:
    x = topographies(s, d)
    return microstate.backfit(x, x.groupBy((F.col("class") + 1).alias("state"), "ch").agg(F.avg("v").alias("w")))


RUNS = "rn AS (SELECT label, count(*) AS n FROM (SELECT label, s - row_number() OVER (PARTITION BY label ORDER BY s) AS g FROM lb) GROUP BY label, g)"
query("gfp_peaks", f"{GFP}, w AS (SELECT s, gfp, lag(gfp) OVER (ORDER BY s) AS p, lead(gfp) OVER (ORDER BY s) AS q, (SELECT quantile_cont(gfp, 0.1) FROM gf) AS lim FROM gf) SELECT s, {r('gfp')} AS gfp FROM w WHERE gfp > p AND gfp >= q AND gfp > lim")(lambda s, d: microstate.peaks(microstate.field_power(topographies(s, d)), 10))
query("microstate_backfit", f"{FIT} SELECT s, label FROM lb")(_labels)
query("microstate_stats", f"{FIT}, {RUNS} SELECT label AS state, {r(f'avg(n) / {SR} * 1000')} AS duration_ms, {r(f'count(*) / ((SELECT count(*) FROM lb) / {SR})')} AS occurrence_per_sec, {r('sum(n) * 100.0 / (SELECT count(*) FROM lb)')} AS coverage_pct FROM rn GROUP BY label")(lambda s, d: microstate.state_statistics(_labels(s, d), SR))
query("microstate_transitions", f"{FIT}, t AS (SELECT label AS from_state, lead(label) OVER (ORDER BY s) AS to_state FROM lb), c AS (SELECT from_state, to_state, count(*) AS n FROM t WHERE from_state <> to_state GROUP BY ALL) SELECT from_state, to_state, {r('n / sum(n) OVER (PARTITION BY from_state)')} AS p FROM c")(lambda s, d: microstate.state_transitions(_labels(s, d)))
query("microstate_sequence", f"{FIT} SELECT s, chr(label + 64) AS state FROM lb")(lambda s, d: microstate.state_letters(_labels(s, d)))
for _m in ("kmeans", "aahc", "pca"):
    query(f"microstates_{_m}")(lambda s, d, m=_m: microstate.microstates(topographies(s, d), 4, m)[1])

# --- components, sources, trials ------------------------------------------------------------

for _m in ("fastica", "infomax", "jade"):
    query(f"ica_{_m}")(lambda s, d, m=_m: ica.sources(signal(s, d), ica.fit(signal(s, d), 3, m)))
for _m in ("correlation", "kurtosis", "spatial"):
    query(f"ica_detect_{_m}")(lambda s, d, m=_m: ica.detect(signal(s, d), ica.fit(signal(s, d), 3, "jade"), m))
query("ica_remove")(lambda s, d: _shown(ica.remove(signal(s, d), ica.fit(signal(s, d), 3, "jade"), [1])))
# sources at the first three numbers of each embedding
GRID_SQL = POSITIONS_SQL + ", sr AS (SELECT vec_id + 1 AS source, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _leadfield_sql(method: str) -> str:
    shells = list(zip(*source.DIPOLES.values())) if method == "bem_simplified" else [(1.0, 1.0)]
    parts = []
    for axis in "xyz":
        terms = []
        for w, k in shells:
            far = "greatest(sqrt(" + " + ".join(f"(e.{c} - {k} * s.{c}) * (e.{c} - {k} * s.{c})" for c in "xyz") + "), 1e-10)"
            terms.append(f"{w} * (e.{axis} - {k} * s.{axis}) / (4 * {PI} * {source.SIGMA} * {far} * {far} * {far})")
        parts.append(f"SELECT e.label, CAST(s.source AS INTEGER) AS source, '{axis}' AS axis, {r(' + '.join(terms))} AS value FROM pos e, sr s")
    return f"WITH {GRID_SQL} " + " UNION ALL ".join(parts)


def _leadfield(s: SparkSession, d: str, method: str) -> DataFrame:
    e = positions(s).where(F.col("label") != "TP10").select("label", F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z"))
    places = s.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") + 1).cast("int").alias("source"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    return source.leadfield_table(e, places, method)


query("leadfield_spherical", _leadfield_sql("spherical"))(lambda s, d: _leadfield(s, d, "spherical"))
query("leadfield_bem", _leadfield_sql("bem_simplified"))(lambda s, d: _leadfield(s, d, "bem_simplified"))


def _forward(n: int = 500) -> source.Forward:
    labels = list(SYSTEM_1010)[:64]
    return source.forward_model(labels, n_sources=n, positions={k: SYSTEM_1010[k] for k in labels})


for _m in ("mne", "sloreta", "eloreta"):
    query(f"source_{_m}")(lambda s, d, m=_m: source.estimate(topographies(s, d), _forward(), m))
query("lcmv")(lambda s, d: source.beamformer(topographies(s, d), _forward()))
query("dics")(lambda s, d: source.beamformer(topographies(s, d), _forward(), "dics", SR))
query("source_power")(lambda s, d: source.source_power(topographies(s, d), _forward(), SR))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return epoched(s, d).select(F.col("epoch").alias("trial"), F.col("condition").alias("label")).distinct()


query("ica_mixing")(lambda s, d: ica.mixing_table(s, ica.fit(signal(s, d), 3, "jade")))


def _ica_frame(s: SparkSession, d: str) -> DataFrame:
    model = ica.fit(signal(s, d), 3, "jade")
    return plots.components_frame(ica.sources(signal(s, d), model), ica.mixing_table(s, model).select("component", "label", "w"))


query("ica_frame")(_ica_frame)
query("csp")(lambda s, d: bci.csp(epoched(s, d), _classes(s, d), 2).features)
query("riemannian")(lambda s, d: bci.riemannian(epoched(s, d)))
for _m in ("cca", "fbcca"):
    query(f"ssvep_{_m}")(lambda s, d, m=_m: bci.ssvep(epoched(s, d), SR, [8.0, 10.0, 12.0], method=m))


def _banded_sql(value: str, name: str) -> str:
    parts = [f"(WITH {_fir_sql('bandpass', a, b, 'ep', 'ch, label, epoch', EPOCH_LEN)} SELECT epoch AS trial, label, '{k}' AS band, {value} FROM f GROUP BY epoch, label)" for k, (a, b) in bci.BANDS.items()]
    return f"WITH {EPOCHED_SQL}, fb AS ({' UNION ALL '.join(parts)}) SELECT trial, label, band, {name}"


_cut = EPOCH_LEN // 4
query("erd_ers", _banded_sql(f"greatest(avg(CASE WHEN s <= {_cut} THEN v * v END), 1e-20) AS base, avg(CASE WHEN s > {_cut} THEN v * v END) AS task", f"{r('(task - base) / base * 100')} AS percent FROM fb"))(lambda s, d: bci.motor_imagery(epoched(s, d), SR))
query("bandpower_features", _banded_sql("ln(greatest(var_samp(v), 1e-20)) AS value", f"{r('value')} AS value FROM fb"))(lambda s, d: bci.band_features(epoched(s, d), SR))
query("lda")(lambda s, d: bci.classify(bci.features(epoched(s, d), "bandpower", SR), _classes(s, d), cv_folds=3)[0])
query("shrinkage_lda")(lambda s, d: bci.classify(bci.features(epoched(s, d), "bandpower", SR), _classes(s, d), "shrinkage_lda")[0])

# --- plot tables ----------------------------------------------------------------------------

query("signal_stack_frame", f"""WITH {SIGNAL_SQL}, o AS (SELECT label, row_number() OVER (ORDER BY min(ch)) AS i, count(*) OVER () AS k, stddev_samp(v) AS sd FROM sig GROUP BY label)
SELECT label, {r(f'(s - 1) / {SR}')} AS time_sec, {r('v')} AS v, {r('v + (k - i) * 3 * sd')} AS shown FROM sig JOIN o USING (label) WHERE (s - 1) / {SR} BETWEEN 1 AND 4""")(lambda s, d: plots.signal_frame(signal(s, d), SR, time_range=(1, 4)))
query("erp_ci_frame", f"""WITH {EPOCHED_SQL}, c AS (SELECT epoch, condition, s, avg(v) AS v FROM ep GROUP BY ALL), g AS (SELECT condition, s, avg(v) AS m, 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) AS h FROM c GROUP BY ALL)
SELECT condition, s, {r('m', 6)} AS mean, {r('m - h', 6)} AS low, {r('m + h', 6)} AS high FROM g""", 6)(lambda s, d: plots.erp_frame(epoched(s, d).drop("condition"), epoched(s, d).select("recording_id", "epoch", "condition").distinct()))
_flat = ", ".join(f"('{k}', {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in FLAT_1020.items())


def _grid_sql(size: int, where: str = "true", extra: str = "") -> str:
    return f"""(WITH va AS (SELECT x, y, avg(v) AS value FROM topo JOIN fl USING (label) WHERE {where} GROUP BY x, y),
ax AS (SELECT -1.0::DOUBLE + i * (2.0::DOUBLE / {size - 1}) AS g FROM (SELECT unnest(range({size})) AS i)), gr AS (SELECT a.g AS gx, b.g AS gy FROM ax a, ax b WHERE a.g * a.g + b.g * b.g <= 1),
dd AS (SELECT gx, gy, value, (gx - x) * (gx - x) + (gy - y) * (gy - y) AS d FROM gr, va)
SELECT {r('gx')} AS gx, {r('gy')} AS gy, {r('coalesce(min(CASE WHEN d < 1e-20 THEN value END), sum(CASE WHEN d >= 1e-20 THEN value / d END) / sum(CASE WHEN d >= 1e-20 THEN 1 / d END))')} AS value{extra} FROM dd GROUP BY dd.gx, dd.gy)"""


FLAT = f"WITH {TOPO_SQL}, fl(label, x, y) AS (VALUES {_flat})"
query("topomap_grid", f"{FLAT} SELECT * FROM {_grid_sql(40)}")(
    lambda s, d: plots.scalp_frame(topographies(s, d), plots.flat_positions(s, list(FLAT_1020)), SR, resolution=40)
)
query("topomap_series", f"{FLAT} " + " UNION ALL ".join(f"SELECT * FROM {_grid_sql(20, f's = {round(t * SR) + 1}', f', {t}::DOUBLE AS time_sec')}" for t in (0.5, 1.0)))(
    lambda s, d: plots.scalp_series(topographies(s, d), plots.flat_positions(s, list(FLAT_1020)), SR, [0.5, 1.0], 20)
)
query("spectrogram_frame", f"""WITH {SIGNAL_SQL}, {_dft_sql('sig', 'ch, label', 64, 16, 33)}
SELECT CAST(NULL AS INTEGER) AS epoch, ch, label, {r(f'(win * 16 + 32.0) / {SR}')} AS time_sec, {r('freq')} AS freq, {r('10 * log10(greatest((re * re + im * im) / 64, 2.220446049250313e-16))')} AS db FROM sp""")(lambda s, d: plots.spectrogram_frame(signal(s, d), SR))


def _by_instant(s: SparkSession, d: str) -> DataFrame:
    x = topographies(s, d).groupBy("s").agg(F.avg("v").alias("amplitude"))
    return x.select((F.col("s") % 41 / 20.5 - 1).alias("x"), (F.col("s") % 37 / 18.5 - 1).alias("y"), "amplitude")


query("source_frame", f"""WITH {TOPO_SQL}, x AS (SELECT CAST(s AS DOUBLE) AS x, avg(v) AS amplitude FROM topo GROUP BY s) SELECT {r('x')} AS x, CAST(0 AS DOUBLE) AS y, {r('amplitude')} AS amplitude FROM x WHERE abs(amplitude) >= (SELECT quantile_cont(abs(amplitude), 0.8) FROM x)""")(
    lambda s, d: plots.source_frame(topographies(s, d).groupBy("s").agg(F.avg("v").alias("amplitude")).select(F.col("s").cast("double").alias("x"), F.lit(0.0).alias("y"), "amplitude"))
)
query("source_flatmap", f"""WITH {TOPO_SQL}, pt AS (SELECT s % 41 / 20.5 - 1 AS x, s % 37 / 18.5 - 1 AS y, avg(v) AS value FROM topo GROUP BY s),
va AS (SELECT * FROM pt WHERE abs(value) >= (SELECT quantile_cont(abs(value), 0.8) FROM pt)),
ax AS (SELECT -1.0::DOUBLE + i * (2.0::DOUBLE / 79) AS g FROM (SELECT unnest(range(80)) AS i)), gr AS (SELECT a.g AS gx, b.g AS gy FROM ax a, ax b WHERE a.g * a.g + b.g * b.g <= 1),
dd AS (SELECT gx, gy, value, (gx - x) * (gx - x) + (gy - y) * (gy - y) AS d FROM gr, va)
SELECT {r('gx')} AS gx, {r('gy')} AS gy, {r('coalesce(min(CASE WHEN d < 1e-20 THEN value END), sum(CASE WHEN d >= 1e-20 THEN value / d END) / sum(CASE WHEN d >= 1e-20 THEN 1 / d END))')} AS value FROM dd GROUP BY dd.gx, dd.gy""")(
    lambda s, d: plots.source_frame(_by_instant(s, d), style="flatmap")
)
for _system, _table in (("10-20", SYSTEM_1020), ("10-10", SYSTEM_1010)):
    _sites = ", ".join(f"('{k}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in _table.items())
    query(f"electrodes_{_system.replace('-', '')}", f"""WITH {TOPO_SQL}, el(label, x, y, z) AS (VALUES {_sites}), c AS (SELECT label, count(*) AS n FROM topo GROUP BY label)
    SELECT '{_system}' AS system, label, n, x AS pos_x, y AS pos_y, z AS pos_z FROM c JOIN el USING (label)""")(
        lambda s, d, system=_system: topographies(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(electrodes(s, system)), "label").select("system", "label", "n", "pos_x", "pos_y", "pos_z")
    )


def _preprocessed(s: SparkSession, d: str) -> DataFrame:
    """Band-pass, bad channels, average reference and epochs of the whole signal."""
    out = preprocess(signal(s, d), SR, 1, 40, events=_events(s, d), epoch=True)
    return out.samples.select("epoch", "s", "ch", "label", "v")


query("preprocess", f"""WITH {SIGNAL_SQL.replace('sig AS (', 'raw AS (')}, {_fir_sql('bandpass', 1, 40, 'raw')}, sig AS (SELECT s, ch, label, v - avg(v) OVER (PARTITION BY s) AS v FROM f), {CUT}
SELECT epoch, CAST(s AS BIGINT) AS s, ch, label, {r(f'v - avg(CASE WHEN s <= {1 - A} THEN v END) OVER (PARTITION BY epoch, ch)')} AS v FROM x""")(_preprocessed)


# --- operators called from SQL -----------------------------------------------------------


def _sql(text: str) -> Query:
    """A query in SQL alone on the view eeg_signal, with the table functions of the session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark)
        x = signal(spark, sf_dir)
        x.createOrReplaceTempView("eeg_signal")
        return spark.sql(text)

    return run


SIZED = "(SELECT *, (SELECT max(s) FROM eeg_signal) AS n FROM eeg_signal)"
query("sql_fir_bandpass", ORACLES["fir_bandpass"])(
    _sql(f"""SELECT s, ch, label, v FROM eeg_fir(TABLE(SELECT *, explode(blocks) AS block FROM (SELECT *, eeg_blocks(s, n, {ORDER // 2}, {ORDER // 2}, 65536) AS blocks FROM {SIZED}))
    PARTITION BY (recording_id, epoch, ch, label, block) ORDER BY (s), 'bandpass', {SR}, 8.0, 13.0, {ORDER}, 65536)""")
)
query("sql_stft", ORACLES["stft"])(
    _sql(f"""SELECT epoch, ch, label, win + 1 AS time_bin, (win * 16 + {N_STFT / 2}D) / {SR}D AS time_sec, freq, (re * re + im * im) / {timefreq.window_energy('hanning', N_STFT)!r}D AS power
    FROM eeg_spectra(TABLE(SELECT *, explode(blocks) AS block FROM (SELECT *, eeg_windows(s, n, {N_STFT}, 16, 4096) AS blocks FROM {SIZED}))
    PARTITION BY (recording_id, epoch, ch, label, block) ORDER BY (s), {N_STFT}, 16, 4096, {SR}, 'hanning')""")
)
# the runs of a block are rows; blocks' runs are joined where they touch, twice, as short suppressions turn into bursts
query("sql_suppression", ORACLES["suppression"])(
    _sql(f"""WITH windows AS (SELECT recording_id, CAST(floor((s - 1) / 8) + 1 AS BIGINT) AS s, sqrt(avg(v * v)) < 60 AS value FROM {SIZED}
      WHERE floor((s - 1) / 8) + 1 <= floor(n / 8) GROUP BY 1, 2),
    parts AS (SELECT * FROM eeg_runs(TABLE(SELECT *, CAST(floor((s - 1) / 65536) AS BIGINT) AS block FROM windows) PARTITION BY (recording_id, block) ORDER BY (s))),
    a AS (SELECT *, sum(CASE WHEN value <=> last THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY start) AS run
      FROM (SELECT *, lag(value) OVER (PARTITION BY recording_id ORDER BY start) AS last FROM parts)),
    b AS (SELECT recording_id, min(start) AS start, max(stop) AS stop, first(value) AND (max(stop) - min(start) + 1) * 8 / {SR} * 1000 >= 125 AS value FROM a GROUP BY recording_id, run),
    c AS (SELECT *, sum(CASE WHEN value <=> last THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY start) AS run
      FROM (SELECT *, lag(value) OVER (PARTITION BY recording_id ORDER BY start) AS last FROM b))
    SELECT CASE WHEN first(value) THEN 'suppression' ELSE 'burst' END AS type, (min(start) - 1) * 8 + 1 AS start_sample, max(stop) * 8 AS end_sample,
      CAST((max(stop) - min(start) + 1) * 8 / {SR} * 1000 AS DOUBLE) AS duration_ms FROM c GROUP BY recording_id, run""")
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average reference, staging of one-second windows, and the metrics of the night they make."""
    x = spatial.rereference(signal(spark, sf_dir))
    return sleep.sleep_metrics(sleep.sleep_stages(x, SR, 1).select("recording_id", "epoch", "stage"))


_rereferenced = SIGNAL_SQL.replace("sig AS (", "raw AS (") + ", sig AS (SELECT ch, label, s, v - avg(v) OVER (PARTITION BY s) AS v FROM raw)"
_staged = ORACLES["sleep_stage"].replace(SIGNAL_SQL, _rereferenced)
query("sleep_report", ORACLES["sleep_metrics"].replace(STAGES_SQL, f"st AS (SELECT epoch, stage FROM ({_staged}))"))(flagship)
