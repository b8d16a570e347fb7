"""Signal views on the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .electrodes import SYSTEM_1010

SR = 128.0
EPOCH_LEN = 128


def numbered(e: DataFrame, by: list[str], name: str) -> DataFrame:
    """e with the place (from 1) of each row in its group by (ts, event_id): places within the hour, plus the rows of earlier hours."""
    e = e.withColumn("_hour", F.coalesce(F.date_trunc("hour", "ts").cast("timestamp"), F.timestamp_seconds(F.lit(0))))
    upto = Window.partitionBy(*by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = e.groupBy(*by, "_hour").count().withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(*by, "_hour").orderBy("ts", "event_id"))
    return e.withColumn("_place", place).join(before, [*by, "_hour"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_hour", "_place", "_before")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel for each event type; those with fewer events are 0 after their last one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    r = numbered(e, ["event_type"], "s").select(F.col("event_type").alias("label"), "s", F.col("value").alias("v"))
    sizes = e.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("label", "n", F.max("n").over(Window.partitionBy()).alias("longest"), F.row_number().over(Window.orderBy("label")).cast("int").alias("ch"))
    rest = sizes.where("n < longest").select("label", F.explode(F.sequence(F.col("n") + 1, F.col("longest"))).alias("s"), F.lit(0.0).alias("v"))
    out = r.unionByName(rest).join(F.broadcast(sizes.select("label", "ch")), "label")
    return out.select(F.lit("r1").alias("recording_id"), F.lit(None).cast("int").alias("epoch"), "s", "ch", "label", "v")


def epoched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal in blocks of 128 samples; condition by parity of the block."""
    x = signal(spark, sf_dir).withColumn("epoch", (F.floor((F.col("s") - 1) / EPOCH_LEN) + 1).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy("ch", "epoch"))
    x = x.withColumn("n", n).where(F.col("n") == EPOCH_LEN).withColumn("s", (F.col("s") - 1) % EPOCH_LEN + 1).drop("n")
    return x.withColumn("condition", F.when(F.col("epoch") % 2 == 1, "target").otherwise("standard"))


def topographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-channel samples, labelled with 10-10 sites in their order."""
    labels = F.array(*[F.lit(x) for x in list(SYSTEM_1010)[:64]])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return e.select(
        F.lit("r1").alias("recording_id"), F.lit(None).cast("int").alias("epoch"), (F.col("vec_id") + 1).alias("s"),
        (F.col("i") + 1).cast("int").alias("ch"), F.element_at(labels, F.col("i") + 1).alias("label"), F.col("x").cast("double").alias("v"),
        F.col("label").alias("class"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage for each event in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id")
    names = {"click": "W", "error": "N1", "purchase": "N2", "signup": "N3", "view": "REM"}
    stage = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")]
    e = numbered(e.withColumn("stage", stage), [], "epoch")
    return e.select(F.lit("r1").alias("recording_id"), F.col("epoch").cast("int").alias("epoch"), "stage")


SIGNAL_SQL = """
er AS (SELECT event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s, value AS v FROM events),
en AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) AS ch FROM er GROUP BY label),
sig AS (SELECT CAST(ch AS INTEGER) AS ch, er.label, er.s, er.v FROM er JOIN en USING (label)
        UNION ALL SELECT CAST(ch AS INTEGER), label, unnest(range(n + 1, (SELECT max(n) + 1 FROM en))), CAST(0 AS DOUBLE) FROM en)
"""
EPOCHED_SQL = SIGNAL_SQL + f""",
ep0 AS (SELECT ch, label, (s - 1) // {EPOCH_LEN} + 1 AS epoch, (s - 1) % {EPOCH_LEN} + 1 AS s, v, count(*) OVER (PARTITION BY ch, (s - 1) // {EPOCH_LEN}) AS n FROM sig),
ep AS (SELECT ch, label, CAST(epoch AS INTEGER) AS epoch, s, v, CASE WHEN epoch % 2 = 1 THEN 'target' ELSE 'standard' END AS condition FROM ep0 WHERE n = {EPOCH_LEN})
"""
POSITIONS_SQL = "pos AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {x:.3f}::DOUBLE, {y:.3f}::DOUBLE, {z:.3f}::DOUBLE)" for i, (k, (x, y, z)) in enumerate(list(SYSTEM_1010.items())[:64], 1)) + ") t(ch, label, x, y, z))"
TOPO_SQL = POSITIONS_SQL + """,
topo0 AS (SELECT vec_id + 1 AS s, label AS class, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS ch FROM embeddings),
topo AS (SELECT s, class, CAST(topo0.ch AS INTEGER) AS ch, pos.label, CAST(v AS DOUBLE) AS v FROM topo0 JOIN pos ON pos.ch = topo0.ch)
"""
STAGES_SQL = """
st AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS epoch,
       CASE event_type WHEN 'click' THEN 'W' WHEN 'error' THEN 'N1' WHEN 'purchase' THEN 'N2' WHEN 'signup' THEN 'N3' WHEN 'view' THEN 'REM' END AS stage FROM events)
"""
