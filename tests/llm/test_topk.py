import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import topk


def brute(rows, k, every, kind=np.float32):
    """Every row is a query and a candidate of its own, also where ids repeat."""
    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(64 * Fraction(float(kind(x)))) for x in v]))
    out = []
    for at, (i, q) in enumerate(usable):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for to, (j, v) in enumerate(usable) if to != at and len(v) == len(q))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,queries", [(8192, 2048), (60, 7)])
def test_matches_brute_force(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(240)]
    rows += [(300 + i, [0.5] * 6) for i in range(90)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (520, [float("inf")] * 6), (540, []), (None, [1.0] * 6), (560, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "shard": F.lit(1)})
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=20).collect())
    assert got == brute(rows, 5, 20)
    assert sorted(tuple(r) for r in topk.top_k(df.union(df), k=5, every=20).collect()) == brute(rows * 2, 5, 20)


def test_components_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 2.0 ** rng.integers(0, 22, 4)).tolist()) for i in range(1, 80)]
    # single large components whose products still fit a long, or cancel exactly
    rows += [(100, [0.0, 0.0, 2.0**55, 0.0]), (101, [2.0**-6, 2.0**50, 2.0**55 + 8, 0.0]), (102, [1.0, 0.0, 0.0, -3.0]), (120, [0.0, 0.0, 2.0**-6, 0.0])]
    rows += [(200, [2.0**600, 2.0**600, 0.0, 2.0**-6]), (201, [2.0**500, -(2.0**500), 0.0, 2.0**-6])]
    fits = [(i, v) for i, v in rows if i < 100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part, every in ((fits, 40), (rows, 120)):
        part_df = df.where(df.vec_id.isin([i for i, _ in part]))
        assert sorted(tuple(r) for r in topk.top_k(part_df, k=6, every=every).collect()) == brute(part, 6, every, np.float64)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, k=6, every=200).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame([(0, [2.0**40]), (1, [-(2.0**40)])], "vec_id long, embedding array<double>")).collect()


def test_shards_out_of_reach_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 10
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.2).tolist()) for i in range(4000)]
    df, seen = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    old = topk.routed
    monkeypatch.setattr(topk, "routed", lambda *a: seen.append(old(*a)) or seen[-1])
    monkeypatch.setattr(topk, "discard", lambda df: None)
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=20).collect())
    assert got == brute(rows, 5, 20, np.float64)
    visits, shards = sum(r.count() for r in seen), 80
    assert visits < 0.3 * 200 * shards


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 8192)]
    assert topk.top_k(df.limit(0)).count() == 0
