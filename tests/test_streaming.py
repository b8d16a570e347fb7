from pyspark.sql import functions as F

from oscilla.streaming.detect import rms_windows, spike_sessions


def test_windows_and_sessions(spark, tmp_path):
    rows = [("r1", "Cz", i / 100, 100.0 if i in (50, 51, 200) else 1.0 if i < 300 else 30.0) for i in range(500)]
    x = spark.createDataFrame(rows, "recording_id string, label string, sec double, v double")
    x = x.withColumn("ts", F.timestamp_millis((F.col("sec") * 1000).cast("long"))).drop("sec")
    x.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    for name, out in (("rms", rms_windows(stream)), ("spikes", spike_sessions(stream, 50))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("rms").where("suppressed").count() == 4 and spark.table("rms").count() == 10
    assert sorted(r["n"] for r in spark.table("spikes").collect()) == [1, 2]
