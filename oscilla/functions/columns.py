"""Column helpers and constants shared by the operators."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
EPOCH = ["recording_id", "epoch"]
TRACE = ["recording_id", "epoch", "ch", "label"]
SAMPLES = "recording_id string, epoch int, s long, ch int, label string, v double"


def ms_to_sample(ms: float, sr: float, epoch_start: float = 0.0) -> int:
    """1-based sample of a latency."""
    return max(1, math.floor((ms - epoch_start) / 1000 * sr) + 1)


def ms_window(window: tuple[float, float], sr: float, epoch_start: float = 0.0) -> tuple[int, int]:
    a, b = (ms_to_sample(w, sr, epoch_start) for w in window)
    if a > b:
        raise ValueError("window lies outside the epoch")
    return a, b


def first_max(v: str | Column, s: str = "s") -> Column:
    """s of the first row with the largest v."""
    v = F.col(v) if isinstance(v, str) else v
    return F.max_by(F.col(s), F.struct(v.alias("v"), (-F.col(s)).alias("i")))


def only(samples: DataFrame, channels: list[str] | None) -> DataFrame:
    return samples if channels is None else samples.where(F.col("label").isin(channels))


BLOCK = 1 << 16  # samples of a trace whose windows one task holds


def block_of(s: str | Column, size: int | None = None) -> Column:
    return F.floor(((F.col(s) if isinstance(s, str) else s) - 1) / (size or BLOCK))


def halo(samples: DataFrame, by: list[str], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int | None = None) -> DataFrame:
    """samples with window columns that reach `before` and `after` samples on a regular grid; each block of a trace carries its neighbours' edges."""
    spread = F.sequence(F.greatest(block_of(F.col("s") - after, size), F.lit(0)), block_of(F.col("s") + before, size))
    dealt = samples.withColumn("_block", F.explode(spread))
    made = dealt.withColumns(columns(Window.partitionBy(*by, "_block").orderBy("s")))
    return made.where(F.col("_block") == block_of("s", size)).drop("_block")


def neighbours(rows: DataFrame, by: list[str], cells: list[str], order: str = "s", size: int | None = None) -> DataFrame:
    """rows with structs `prev` and `next` of the rows before and after in `by`, null at the ends.

    Windows hold a block of a group; the first and last rows of blocks meet in one small table.
    """
    x = rows.withColumn("_block", block_of(order, size)).repartition(*by, "_block")
    cell = F.struct(order, *cells)
    inner, outer = Window.partitionBy(*by, "_block").orderBy(order), Window.partitionBy(*by).orderBy("_block")
    edges = x.groupBy(*by, "_block").agg(F.min_by(cell, order).alias("_first"), F.max_by(cell, order).alias("_last"))
    edges = edges.select(*by, "_block", F.lag("_last").over(outer).alias("_before"), F.lead("_first").over(outer).alias("_after"))
    y = x.withColumns({"prev": F.lag(cell).over(inner), "next": F.lead(cell).over(inner)}).join(edges, [*by, "_block"])
    return y.withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")}).drop("_block", "_before", "_after")


def merge_runs(spans: DataFrame, by: list[str], merged: dict[str, Column], gap: int = 1, size: int | None = None) -> DataFrame:
    """(by…, value, start, stop, <merged>…): spans (by…, value, start, stop, …) joined where the next starts at most `gap` after the last stop and has its value.

    `merged` are aggregates that may be applied again to their own results. Blocks of a group
    are joined first; of these only the first and last of each block can go on, and they meet in
    one small table.
    """

    def joined(x: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start")
        change = ~F.col("value").eqNullSafe(F.lag("value").over(w)) | (F.col("start") - F.lag("stop").over(w) > gap)
        x = x.withColumn("_run", F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(w))
        return x.groupBy(*keys, "_run").agg(F.first("value").alias("value"), F.min("start").alias("_start"), F.max("stop").alias("stop"), *(c.alias(k) for k, c in merged.items())).withColumnRenamed("_start", "start")

    names = [*by, "value", "start", "stop", *merged]
    x = joined(spans.withColumn("_block", block_of("start", size)), [*by, "_block"])
    x = x.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(*by, "_block"))))
    border = joined(x.where("_edge").drop("_run"), by)
    return x.where("NOT _edge").select(*names).unionByName(border.select(*names))


def runs(rows: DataFrame, by: list[str], on: Column, merged: dict[str, Column] | None = None, size: int | None = None) -> DataFrame:
    """Runs of consecutive s with one value of `on`: (by…, value, start, stop, <merged>…)."""
    return merge_runs(rows.withColumns({"value": on, "start": F.col("s"), "stop": F.col("s")}), by, merged or {}, 1, size)


def length_of(samples: DataFrame, epochs: bool | None = None) -> int:
    """Samples of a trace; all traces of an operation are equally long. `epochs` tells whether samples must (not) be cut into epochs."""
    found = samples.agg(F.max("s").alias("n"), F.count("epoch").alias("cut"), F.count(F.lit(1)).alias("rows")).first()
    if epochs and found["cut"] < found["rows"]:
        raise ValueError("a continuous recording has no epochs")
    if epochs is False and found["cut"]:
        raise ValueError("a continuous recording is needed, not epochs")
    return int(found["n"] or 0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the folder of spark.checkpoint.dir, so that plans of many rounds stay short and lost executors lose nothing.

    Where the session names no folder, one of the driver is used if it is the only machine; else it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()
