"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Documents' words are summed into cells of source, language and topic. Raking scales
the cells until their marginals meet the targets; cell weights (target share over
actual share) then give sampling probabilities, calibrated so that the expected words
are the budget, and a document is drawn by a hash of its id. Every source, language and
topic that stands in the data has its own marginal. Up to SMALL cells are raked in the
driver, more by joins and aggregates; both do the same steps. Topics are clusters of
hashed word frequencies over all documents.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

TOPICS = 8
TEMPER = 0.7  # targets where none are given: shares raised to this power
BUDGET = 0.7  # share of all words that the sample holds in expectation
SMALL = 100_000  # cells that are raked in the driver, and broadcast to the documents
SALT = 32  # parts of a cell's documents where cells are joined by shuffle
ROUNDS, TOLERANCE = 200, 1e-9
HASH = 1_000_000_007
BATCH_ROWS = "spark.sql.inMemoryColumnarStorage.batchSize"
BATCH = 64  # vectors of a cached batch: a task's reader keeps up to 100 batches, and each may have 4 MB
AXES = {"source": "_s", "lang": "_l", "topic": "_t"}
CELLS = "_s string, _l string, _t int, mix_weight double, mix_probability double, mix_gap double"


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tol: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Shares of the cells whose marginals along each axis meet the targets, and the gap left.

    axes hold each cell's index per dimension; targets sum to 1 each. Cells without
    tokens stay empty, so targets they would need cannot be met; the gap says so.
    """
    share = tokens / tokens.sum()
    gap = np.inf
    for _ in range(rounds):
        for at, want in zip(axes, targets):
            have = np.bincount(at, weights=share, minlength=len(want))
            share = share * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[at]
        gap = max(float(np.abs(np.bincount(at, weights=share, minlength=len(w)) - w).max()) for at, w in zip(axes, targets))
        if gap < tol:
            break
    return share, gap


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight) with c such that the expected tokens are the budget's share of all."""
    want = min(budget, 1.0) * tokens.sum()
    low, high = 0.0, 1.0 / max(weight[weight > 0].min(), 1e-12)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * weight) * tokens).sum() < want else (low, mid)
    return np.minimum(1, high * weight)


def vectors(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("_mix_words", F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"))
    docs = HashingTF(inputCol="_mix_words", outputCol="_mix_tf", numFeatures=256).transform(docs)
    return Normalizer(inputCol="_mix_tf", outputCol="_mix_vector").transform(docs)


def fit_topics(rows: DataFrame) -> KMeansModel | None:
    """Clusters of the vectors of all documents with text; None if fewer than TOPICS of them differ."""
    texts = rows.where("mix_words > 0").select("_mix_vector")
    if texts.select(F.xxhash64(vector_to_array("_mix_vector"))).distinct().limit(TOPICS).count() < TOPICS:
        return None
    conf = texts.sparkSession.conf
    old = conf.get(BATCH_ROWS, None)
    conf.set(BATCH_ROWS, str(BATCH))
    texts = texts.persist(StorageLevel.DISK_ONLY)  # else the fit holds them in executors' memory
    try:
        return KMeans(k=TOPICS, seed=7, maxIter=8, featuresCol="_mix_vector", predictionCol="mix_topic").fit(texts)
    finally:
        texts.unpersist()
        conf.unset(BATCH_ROWS) if old is None else conf.set(BATCH_ROWS, old)


def describe(docs: DataFrame) -> DataFrame:
    """docs with mix_words (words of the text) and their vectors."""
    words = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.size("_mix_words")).otherwise(0)
    return vectors(docs).withColumn("mix_words", words.cast("long")).drop("_mix_words", "_mix_tf")


def with_topics(rows: DataFrame) -> DataFrame:
    model = fit_topics(rows)
    out = model.transform(rows) if model else rows.withColumn("mix_topic", F.lit(0))
    return out.drop("_mix_vector")


def place(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("(none)"))


def target_rows(spark: SparkSession, axis: str, given: dict) -> DataFrame:
    total = float(sum(given.values()))
    kind = "int" if axis == "_t" else "string"
    return spark.createDataFrame([(k, v / total) for k, v in given.items()], f"{axis} {kind}, want double")


def wanted(cells: DataFrame, targets: dict[str, dict] | None) -> dict[str, DataFrame]:
    """By axis: (value, want), shares that sum to 1, of every value in the data."""
    out = {}
    for name, axis in AXES.items():
        sums = cells.groupBy(axis).agg(F.sum("w").alias("w"))
        if given := (targets or {}).get(name):
            share = target_rows(cells.sparkSession, axis, given)
            if absent := [r[0] for r in share.where("want > 0").join(sums, axis, "left_anti").limit(5).collect()]:
                raise ValueError(f"no document has the {name} of these targets: {absent}")
            out[axis] = sums.join(share, axis, "left").select(axis, F.coalesce("want", F.lit(0.0)).alias("want"))
        else:
            power = F.pow(F.col("w").cast("double"), F.lit(TEMPER))
            norm = sums.agg(F.sum(power).alias("norm")).first()["norm"] or 1.0
            out[axis] = sums.select(axis, (power / norm).alias("want"))
    return out


def rake_small(cells: DataFrame, want: dict[str, DataFrame], budget: float) -> DataFrame:
    found = cells.orderBy(*AXES.values()).collect()
    tokens = np.array([float(r["w"]) for r in found])
    axes, targets = [], []
    for axis in AXES.values():
        share = {r[0]: r["want"] for r in want[axis].collect()}
        names = {v: i for i, v in enumerate(sorted(share))}
        axes.append(np.array([names[r[axis]] for r in found]))
        targets.append(np.array([share[v] for v in names]))
    share, gap = rake(tokens, axes, targets)
    actual = tokens / tokens.sum()
    weight = np.divide(share, actual, out=np.zeros_like(share), where=actual > 0)
    chance = calibrate(tokens, weight, budget)
    rows = [(r["_s"], r["_l"], r["_t"], float(w), float(p), gap) for r, w, p in zip(found, weight, chance)]
    return cells.sparkSession.createDataFrame(rows, CELLS)


def rake_large(cells: DataFrame, want: dict[str, DataFrame], budget: float, total: float) -> DataFrame:
    """The steps of rake() and calibrate() with cells as rows; only sums reach the driver."""
    want = {axis: materialize(x, "want") for axis, x in want.items()}
    state = cells.withColumn("share", F.col("w") / total)
    gap, held = None, []
    for _ in range(ROUNDS):
        for axis, x in want.items():
            have = state.groupBy(axis).agg(F.sum("share").alias("have"))
            factor = have.join(x, axis).select(axis, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("f"))
            state = state.join(factor, axis).withColumn("share", F.col("share") * F.col("f")).drop("f")
        last, state = held, materialize(state, "raked")
        held = [state]
        discard(*last)
        gaps = [state.groupBy(a).agg(F.sum("share").alias("have")).join(x, a).agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] for a, x in want.items()]
        gap = max(gaps)
        if gap < TOLERANCE:
            break
    state = state.withColumn("mix_weight", F.when(F.col("w") > 0, F.col("share") * total / F.col("w")).otherwise(0.0))
    least = state.where("mix_weight > 0").agg(F.min("mix_weight")).first()[0]
    low, high, need = 0.0, 1.0 / max(least, 1e-12), min(budget, 1.0) * total
    for _ in range(12):
        marks = [low + (high - low) * i / 32 for i in range(1, 32)]
        sums = state.agg(*[F.sum(F.least(F.lit(1.0), F.col("mix_weight") * m) * F.col("w")) for m in marks]).first()
        low, high = max([low, *(m for m, x in zip(marks, sums) if x < need)]), min([high, *(m for m, x in zip(marks, sums) if x >= need)])
    return state.select("_s", "_l", "_t", "mix_weight", F.least(F.lit(1.0), F.col("mix_weight") * high).alias("mix_probability"), F.lit(gap).alias("mix_gap"))


def fit_mix(rows: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> tuple[DataFrame, bool]:
    """(CELLS, whether they are small) of described documents; targets: dimension -> value -> share (default: tempered shares)."""
    keys = [place("source").alias("_s"), place("lang").alias("_l"), F.col("mix_topic").alias("_t")]
    cells = materialize(rows.groupBy(*keys).agg(F.sum("mix_words").alias("w")), "cells")
    n, total = cells.agg(F.count(F.lit(1)), F.sum("w")).first()
    if not total:
        return cells.select("_s", "_l", "_t", *[F.lit(x).alias(c) for c, x in (("mix_weight", 1.0), ("mix_probability", 1.0), ("mix_gap", 0.0))]), n <= SMALL
    want = wanted(cells, targets)
    return (rake_small(cells, want, budget), True) if n <= SMALL else (rake_large(cells, want, budget, float(total)), False)


def sampled(rows: DataFrame, fitted: tuple[DataFrame, bool], seed: int = 11) -> DataFrame:
    cells, small = fitted
    out = rows.withColumns({"_s": place("source"), "_l": place("lang"), "_t": F.col("mix_topic")})
    keys = list(AXES.values())
    if small:
        out = out.join(F.broadcast(cells), keys)
    else:  # a cell may hold a third of all documents
        cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "mix_words"), F.lit(SALT)).cast("int"))
        out = out.join(cells, [*keys, "_salt"]).drop("_salt")
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HASH)) + 0.5) / float(HASH)
    return out.drop(*keys).where(drawn < F.col("mix_probability"))


def mix_documents(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of docs with mix_topic, mix_words, mix_weight, mix_probability and mix_gap.

    Columns of those names, and those that start with _mix, are replaced; others stay.
    Weighting a kept row by mix_weight / mix_probability gives target shares in
    expectation, even where a probability is capped at 1; mix_gap is the largest distance
    of a marginal from its target, which is not near 0 if the cells cannot meet them.
    A target of a value that no document has is an error; a value that given targets
    leave out has target 0. Null sources and languages form the value "(none)"; empty and
    null texts count no words and take their cell's probability (cells without any words
    are dropped with weight 0, or kept if no document has words); a text of any length
    counts all its words; rows of one doc_id in one cell are drawn together; an empty
    table gives no rows.
    """
    docs = docs.drop("mix_topic", "mix_words", "mix_weight", "mix_probability", "mix_gap", "_mix_words", "_mix_tf", "_mix_vector", *AXES.values(), "_salt")
    rows = with_topics(materialize(describe(docs), "described"))
    return sampled(rows, fit_mix(rows, targets, budget))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = with_topics(materialize(describe(docs.select("doc_id", "source", "lang", "text")).drop("text"), "described"))
    return sampled(rows, fit_mix(rows))
