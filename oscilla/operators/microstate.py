"""Microstates: maps from topographies at peaks of global field power, back-fitting and run statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import block_of, checkpointed, neighbours, runs
from .agglomeration import TASK_ROWS, merge, unit
from .ica import collect_sums, covariance, frames

BY = ["recording_id"]
ROUNDS = 100
HEAD = 1024  # peaks from the start, held by the driver for the signs
TASK_PEAKS = 512  # least peaks of a task, on average


def field_power(samples: DataFrame) -> DataFrame:
    """(recording_id, s, gfp): population standard deviation over channels."""
    return samples.groupBy(*BY, "s").agg(F.stddev_pop("v").alias("gfp"))


def peaks(gfp: DataFrame, min_gfp: float = 1) -> DataFrame:
    """Local maxima above the min_gfp-th percentile."""
    limit = gfp.groupBy(*BY).agg(F.percentile("gfp", F.lit(min_gfp / 100)).alias("limit"))
    g = neighbours(gfp, BY, ["gfp"]).join(F.broadcast(limit), BY)
    return g.where((F.col("gfp") > F.col("prev.gfp")) & (F.col("gfp") >= F.col("next.gfp")) & (F.col("gfp") > F.col("limit"))).select(*BY, "s", "gfp")


def _firsts(peaks: DataFrame, maps: np.ndarray) -> dict[int, np.ndarray]:
    """By state: the topography of its first peak. Tasks hand on one row for each state."""
    width = maps.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            x = unit(b.column(2).flatten().to_numpy().reshape(-1, width))
            own = np.abs(x @ maps.T).argmax(axis=1)
            for j in np.unique(own).tolist():
                i = min(np.flatnonzero(own == j).tolist(), key=keys.__getitem__)
                if j not in best or keys[i] < best[j][0]:
                    best[j] = (keys[i], x[i])
        yield pa.RecordBatch.from_pylist([{"state": j, "recording_id": key[0], "s": key[1], "x": v.tolist()} for j, (key, v) in best.items()], FIRSTS)

    parts = peaks.mapInArrow(run, "state int, recording_id string, s long, x array<double>")
    return {r["state"]: np.array(r["x"]) for r in parts.groupBy("state").agg(F.min_by("x", F.struct("recording_id", "s")).alias("x")).collect()}


def _aligned(maps: np.ndarray, old: np.ndarray | None, first: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Of a batch of peaks: sums by state with the signs of first, then peaks by state, then how many changed their state from old."""
    k, width = maps.shape

    def fn(x: np.ndarray) -> np.ndarray:
        x = unit(x)
        own = np.abs(x @ maps.T).argmax(axis=1)
        moved = len(x) if old is None else np.count_nonzero(np.abs(x @ old.T).argmax(axis=1) != own)
        x = x * np.where((x * first[own]).sum(axis=1) < 0, -1, 1)[:, None]
        mine = own == np.arange(k)[:, None]
        return np.concatenate([(mine.astype(float) @ x).ravel(), mine.sum(axis=1), [moved]])

    return fn


FIRSTS = pa.schema([("state", pa.int32()), ("recording_id", pa.string()), ("s", pa.int64()), ("x", pa.list_(pa.float64()))])


def at_places(peaks: DataFrame, places: list[int]) -> DataFrame:
    """(recording_id, s, place): the peaks at the given places (from 0) in order of recording and s; place counts the list."""
    x = peaks.select(*BY, "s", block_of("s").alias("_block"))
    sizes = x.groupBy(*BY, "_block").count()
    upto = Window.orderBy(*BY, "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    wanted = F.broadcast(peaks.sparkSession.createDataFrame(list(zip(places, range(len(places)))), "_at long, place int"))
    held = wanted.join(sizes, F.expr("_at >= _before AND _at < _before + count")).select(*BY, "_block", "place", (F.col("_at") - F.col("_before")).alias("_at"))
    inside = F.row_number().over(Window.partitionBy(*BY, "_block").orderBy("s")) - 1
    return x.withColumn("_row", inside).join(F.broadcast(held), [*BY, "_block"]).where("_row = _at").select(*BY, "s", "place")


def kmeans_maps(peaks: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """Maps of all peaks (recording_id, s, x): signs follow the first peak of a state; starts are k peaks drawn by place.

    A round is one pass over the peaks. The first peak of a state nearly always is one of the
    first HEAD; for a state that has none there, a pass looks for it.
    """
    n = peaks.count()
    drawn = np.random.default_rng(seed).choice(n, k, replace=False).tolist()
    keys = at_places(peaks, [*drawn, *range(min(HEAD, n))])
    held = unit(np.array([r["x"] for r in peaks.join(F.broadcast(keys), [*BY, "s"]).orderBy("place").collect()]))
    maps, head, old = held[:k], held[k:], None
    for _ in range(ROUNDS):
        own = np.abs(head @ maps.T).argmax(axis=1)
        found = {j: head[(own == j).argmax()] for j in np.unique(own).tolist()}
        if len(found) < k and n > len(head):
            found = _firsts(peaks, maps) | found
        first = np.array([found.get(j, maps[j]) for j in range(k)])
        got = collect_sums(peaks, _aligned(maps, old, first), maps.size + k + 1)
        if not got[-1]:
            break
        sums, sizes = got[: maps.size].reshape(maps.shape), got[maps.size : -1]
        old, maps = maps, np.where(sizes[:, None] > 0, unit(sums), maps)
    return maps


def distinct(peaks: DataFrame, k: int, tasks: int) -> DataFrame:
    """(id, size, x): topographies of peaks (recording_id, s, x) in unit length, equal ones together, numbered in order of recording and s.

    Equal topographies, whatever their sign, are as alike as can be, so agglomeration merges them
    first. If fewer than k differ, as many copies as it leaves unmerged stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = len(b.column(2)[0]) if b.num_rows else 1
            x = unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            sign = np.where(x[np.arange(len(x)), (x != 0).argmax(axis=1)] < 0, -1.0, 1.0)
            s = b.column(1).to_numpy()
            single = ~(np.abs((x**2).sum(axis=1) - 1) < 1e-6)  # without a direction, so like no other
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array((x * sign[:, None]).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sign), x, pa.array(np.where(single, s, -1))], ["recording_id", "s", "sign", "x", "apart"])

    spans = peaks.groupBy(*BY).agg(F.min("s").alias("_low"), (F.max("s") - F.min("s") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*BY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each recording
    marked = peaks.mapInArrow(run, "recording_id string, s long, sign double, x array<double>, apart long")
    marked = marked.join(spans.select(*BY, (before - F.col("_low")).alias("_add")), BY).withColumn("id", F.col("s") + F.col("_add"))
    marked = marked.select("id", "sign", "x", F.when(F.col("apart") < 0, -1).otherwise(F.col("id")).alias("apart"))
    alike = marked.groupBy("x", "apart").agg(F.min(F.struct("id", "sign")).alias("first"), F.count(F.lit(1)).cast("double").alias("size"))
    clusters = checkpointed(alike.select("first.id", "size", F.transform("x", lambda v: v * F.col("first.sign") * F.col("size")).alias("x")).repartition(tasks))
    lacking = k - clusters.count()
    if lacking > 0:
        copies = marked.join(alike.select("x", "apart", F.col("first.id").alias("_head")), ["x", "apart"]).where("id <> _head")
        copies = copies.orderBy(F.desc("_head"), F.desc("id")).limit(lacking)
        clusters = checkpointed(clusters.unionByName(copies.select("id", F.lit(1.0).alias("size"), F.transform("x", lambda v: v * F.col("sign")).alias("x"))))
    return clusters


def microstates(samples: DataFrame, n_states: int = 4, method: str = "kmeans", min_gfp: float = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(maps: state, ch, w; labels: recording_id, s, label, gfp)."""
    gfp = field_power(samples)
    top = peaks(gfp, min_gfp)
    n = top.count()
    if n < n_states:
        top, n = gfp.orderBy(F.desc("gfp"), "s").limit(10 * n_states), 10 * n_states
    if method == "pca":
        cov, chans = covariance(samples.join(top.select(*BY, "s"), [*BY, "s"]))
        values, vectors = np.linalg.eigh(cov)
        maps = vectors[:, np.argsort(-values)[:n_states]].T
    elif method in ("kmeans", "aahc"):
        rows = samples.join(top.select(*BY, "s"), [*BY, "s"]).groupBy(*BY, "s").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("x"))
        rows = checkpointed(rows.coalesce(n // TASK_PEAKS + 1))
        chans = [e["ch"] for e in rows.first()["x"]]
        every = rows.select(*BY, "s", F.transform("x", lambda e: e["v"]).alias("x"))
        if method == "kmeans":
            maps = kmeans_maps(every, n_states, seed)
        else:
            maps = merge(distinct(every, n_states, n // TASK_ROWS + 1), n_states)
    else:
        raise ValueError(f"unknown method {method!r}")
    table = samples.sparkSession.createDataFrame([(j + 1, int(c), float(maps[j, i])) for j in range(len(maps)) for i, c in enumerate(chans)], "state int, ch int, w double")
    return table, backfit(samples, table).join(gfp, [*BY, "s"])


def backfit(samples: DataFrame, maps: DataFrame) -> DataFrame:
    """(recording_id, s, label): the map of largest absolute cosine, the first of ties; state 1 at zero power.

    One product of a batch of instants with the maps, which are channels by states numbers.
    """
    rows = maps.select("state", "ch", "w").collect()
    states, chans = sorted({r["state"] for r in rows}), sorted({r["ch"] for r in rows})
    w = np.zeros((len(states), len(chans)))
    for r in rows:
        w[states.index(r["state"]), chans.index(r["ch"])] = r["w"]
    w = w / np.maximum(np.sqrt((w**2).sum(axis=1, keepdims=True)), 1e-10)
    label = np.array(states, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False)
            if len(x) != len(chans) * b.num_rows:
                raise ValueError("an instant lacks channels that the maps have")
            best = label[np.abs(x.reshape(-1, len(chans)) @ w.T).argmax(axis=1)] if b.num_rows else label[:0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best)], ["recording_id", "s", "label"])

    at = frames(samples.where(F.col("ch").isin([int(c) for c in chans])).withColumn("epoch", F.lit(None).cast("int"))).select(*BY, "s", "x")
    return at.mapInArrow(run, "recording_id string, s long, label int")


def state_statistics(labels: DataFrame, sr: float) -> DataFrame:
    """(recording_id, state, duration_ms, occurrence_per_sec, coverage_pct) of (recording_id, s, label)."""
    found = runs(labels, BY, F.col("label")).withColumn("n", F.col("stop") - F.col("start") + 1)
    per = found.groupBy(*BY, F.col("value").alias("state")).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"))
    total = per.groupBy(*BY).agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total), BY).select(*BY, "state", (F.col("mean") / sr * 1000).alias("duration_ms"), (F.col("runs") / (F.col("total") / sr)).alias("occurrence_per_sec"), (F.col("n") * 100.0 / F.col("total")).alias("coverage_pct"))


def state_transitions(labels: DataFrame) -> DataFrame:
    """(recording_id, from_state, to_state, p): changes of state, as shares of the changes out of a state.

    Changes within blocks, and from the last row of a block to the first of the next.
    """
    x = labels.select(*BY, "s", "label", block_of("s").alias("_block")).repartition(*BY, "_block")
    inner, outer = Window.partitionBy(*BY, "_block").orderBy("s"), Window.partitionBy(*BY).orderBy("_block")
    within = x.select(*BY, F.col("label").alias("from_state"), F.lead("label").over(inner).alias("to_state"))
    edges = x.groupBy(*BY, "_block").agg(F.min_by("label", "s").alias("first"), F.max_by("label", "s").alias("last"))
    between = edges.select(*BY, F.col("last").alias("from_state"), F.lead("first").over(outer).alias("to_state"))
    t = within.unionByName(between).where("from_state <> to_state").groupBy(*BY, "from_state", "to_state").count()
    return t.select(*BY, "from_state", "to_state", (F.col("count") / F.sum("count").over(Window.partitionBy(*BY, "from_state"))).alias("p"))


def state_letters(labels: DataFrame) -> DataFrame:
    return labels.select(*BY, "s", F.char(F.col("label") + 64).alias("state"))
