"""Streams in pieces, with late rows, give what the batch operators give on the whole signal of events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions.columns import length_of
from oscilla.functions.kernels import fir_length
from oscilla.operators import clinical, sleep
from oscilla.operators.filtering import fir_filter
from oscilla.sources.views import SR, signal
from oscilla.streaming import stateful

DATA = "/root/testdata/sf0.001"
KEY = ["recording_id", "ch", "label"]


@pytest.fixture(scope="module")
def whole(spark):
    x = signal(spark, DATA).drop("epoch").withColumn("v", F.col("v") - 60)
    return x.withColumn("ts", F.timestamp_millis((F.col("s") * 1000 / SR).cast("long"))).persist()


def streamed(spark, tmp_path, data, detector):
    """Pieces of 40 samples in a mixed order, each with a third of its rows a piece late; a last row of another recording moves the clock on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    folder = tmp_path / "in"
    piece = F.floor((F.col("s") - 1) / 40) + F.when(F.hash("s", "ch") % 3 == 0, 1).otherwise(0)
    rows = data.withColumn("piece", piece)
    n = rows.agg(F.max("piece")).first()[0]
    columns = data.columns
    for i in range(n + 1):
        rows.where(F.col("piece") == i).select(*columns).orderBy(F.hash("s", F.lit(7))).coalesce(1).write.mode("append").parquet(str(folder))
    end = data.limit(1).withColumns({"recording_id": F.lit("clock"), "ts": F.timestamp_seconds(F.lit(10_000))})
    end.select(*columns).coalesce(1).write.mode("append").parquet(str(folder))
    again = data.limit(1).withColumns({"recording_id": F.lit("clock"), "ts": F.timestamp_seconds(F.lit(20_000))})
    again.select(*columns).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = (
        detector(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(400) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).where("recording_id <> 'clock'")


def same(got, want):
    columns = sorted(want.columns)
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (got, want))
    assert a and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(np.isclose(u, v) if isinstance(u, float) else u == v for u, v in zip(x, y))


def test_suppression(spark, tmp_path, whole):
    data = whole.withColumn("v", F.col("v") + 60)
    want = clinical.suppression(data, SR, 60, 125, 62.5)[0]
    same(streamed(spark, tmp_path, data, lambda s: stateful.suppression(s, SR, 60, 125, 62.5, "1 seconds", 1000)), want)


def test_spikes(spark, tmp_path, whole):
    want = clinical.spikes(whole.withColumn("epoch", F.lit(None).cast("int")), SR, threshold_sd=1, min_duration_ms=5, max_duration_ms=60)
    d = whole.alias("a").join(whole.alias("b"), F.expr("a.ch = b.ch AND b.s = a.s + 1"), "left").select("a.*", F.abs(F.coalesce(F.expr("b.v - a.v"), F.lit(0.0))).alias("d"))
    stats = d.groupBy(*KEY).agg((F.avg("d") + F.stddev_samp("d")).alias("limit"), (F.avg(F.abs("v")) + 2 * F.stddev_samp("v")).alias("ref"))
    data = whole.join(stats, KEY)
    same(streamed(spark, tmp_path, data, lambda s: stateful.spikes(s, SR, 5, 60, 50, "1 seconds", 1000)), want)


def test_spindles(spark, tmp_path, whole):
    x = whole.withColumn("epoch", F.lit(None).cast("int"))
    want = sleep.spindles(x, SR, threshold_sd=0.5, min_duration_ms=100)
    taps, half = fir_length(SR, 11, length_of(x)), max(1, round(0.2 * SR)) // 2
    y = fir_filter(x, "bandpass", SR, 11, 16).toPandas().sort_values(["ch", "s"])
    limits = []
    for ch, g in y.groupby("ch"):
        v = g.v.to_numpy()
        env = np.array([np.sqrt((v[max(0, i - half) : i + half + 1] ** 2).mean()) for i in range(len(v))])
        limits.append((int(ch), float(env.mean() + 0.5 * env.std(ddof=1))))
    data = whole.join(F.broadcast(spark.createDataFrame(limits, "ch int, limit double")), "ch").select(*whole.columns, "limit")
    same(streamed(spark, tmp_path, data, lambda s: stateful.spindles(s, SR, taps, (11, 16), 100, 2000, "1 seconds", 1000)), want)
