import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import mixing


def test_rake_and_calibrate():
    tokens = np.array([70.0, 5, 10, 5, 6, 4])
    axes = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    targets = [np.array([0.4, 0.3, 0.3]), np.array([0.6, 0.4])]
    share, gap = mixing.rake(tokens, axes, targets)
    assert gap < 1e-8
    for at, want in zip(axes, targets):
        assert np.allclose(np.bincount(at, weights=share), want)
    odds = share * 100 / tokens  # interactions are left as they were
    assert np.isclose(odds[0] * odds[3], odds[1] * odds[2])
    p = mixing.calibrate(tokens, share / (tokens / 100), 0.5)
    assert p.max() <= 1 and np.isclose((p * tokens).sum(), 50)


def test_unmeetable_target_says_so():
    _, gap = mixing.rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.9, 0.1]), np.array([0.1, 0.9])])
    assert gap > 0.1


def test_sample(spark):
    rows = [(i, f"alpha{i % 7} beta gamma{i % 5} delta " * (1 + i % 5), "big" if i % 4 else "small", "en" if i % 3 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("mix_weight", F.lit("clash"))
    targets = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mix_documents(docs, targets, budget=0.4)
    assert set(docs.columns) < set(out.columns)
    got = out.toPandas()
    words = sum(len(t.split()) for _, t, *_ in rows)
    assert abs(got.mix_words.sum() / words - 0.4) < 0.04
    w = got.mix_words * got.mix_weight / got.mix_probability
    assert abs(w[got.source == "small"].sum() / w.sum() - 0.5) < 0.05 and abs(w[got.lang == "de"].sum() / w.sum() - 0.5) < 0.05
    again = mixing.mix_documents(docs, targets, budget=0.4)
    assert sorted(r[0] for r in again.select("doc_id").collect()) == sorted(got.doc_id)


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, extra int"
    rows = [(1, None, None, None, 1), (1, "", "a", None, 1), (None, "x y", "a", "en", 2), (2, "z " * 40000, None, "de", 3)] * 2
    assert mixing.mix_documents(spark.createDataFrame(rows, schema), budget=1.0).count() >= 4
    assert mixing.mix_documents(spark.createDataFrame(rows[:1], schema)).count() == 1
    assert mixing.mix_documents(spark.createDataFrame([], schema)).count() == 0


def direct(rows, targets, rounds=300):
    """Raking document by document: weights whose word sums meet the targets."""
    words = np.array([len(t.split()) for _, t, *_ in rows], dtype=float)
    weight = np.ones(len(rows))
    for _ in range(rounds):
        for at, want in targets:
            values = np.array([r[at] for r in rows])
            for v, share in want.items():
                weight[values == v] *= share * words.sum() / (weight * words)[values == v].sum()
    return weight


def many_sources():
    rng = np.random.default_rng(1)
    return [(i, "w " * int(rng.integers(1, 40)), f"s{min(int(rng.pareto(0.7) * 3), 99)}", f"l{int(rng.integers(20))}") for i in range(6000)]


@pytest.mark.parametrize("small", [10**6, 0])
def test_every_source_and_language_meets_its_target(spark, monkeypatch, small):
    """Over 64 sources and 16 languages, against raking of the documents themselves; in the driver and by joins."""
    monkeypatch.setattr(mixing, "SMALL", small)
    rows = many_sources()
    sources, langs = sorted({r[2] for r in rows}), sorted({r[3] for r in rows})
    assert len(sources) > 64 and len(langs) > 16
    targets = {"source": {v: 1.0 + i % 3 for i, v in enumerate(sources)}, "lang": {v: 1.0 for v in langs}}
    share = {k: {v: x / sum(t.values()) for v, x in t.items()} for k, t in targets.items()}
    want = direct(rows, [(2, share["source"]), (3, share["lang"])])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix_documents(docs, targets, budget=0.5).toPandas()
    assert got.mix_gap.max() < 1e-5
    assert np.allclose(got.mix_weight, want[got.doc_id], rtol=1e-3)
    words = np.array([len(t.split()) for _, t, *_ in rows], dtype=float)
    scale = got.mix_probability / np.minimum(1, got.mix_weight * (got.mix_probability / got.mix_weight).max())
    assert np.allclose(scale, 1)
    c = (got.mix_probability / got.mix_weight).max()
    assert np.isclose((np.minimum(1, c * want) * words).sum(), 0.5 * words.sum(), rtol=1e-3)


def test_absent_targets_are_errors_and_gaps_are_told(spark):
    rows = [(1, "a b", "x", "en"), (2, "c d", "y", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="zz"):
        mixing.mix_documents(docs, {"source": {"x": 0.5, "zz": 0.5}})
    torn = {"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": {0: 1.0}}
    out = mixing.fit_mix(docs.withColumns({"mix_topic": F.lit(0), "mix_words": F.lit(2)}), torn)[0]
    assert out.first()["mix_gap"] > 0.1


def test_cached_vectors_come_in_small_batches(spark, monkeypatch):
    """A task's reader keeps up to 100 cached batches, so batches of the default size fill an executor."""
    seen, old = [], spark.conf.get(mixing.BATCH_ROWS)

    class Fit(mixing.KMeans):
        def fit(self, texts):
            seen.append(int(spark.conf.get(mixing.BATCH_ROWS)))
            return super().fit(texts)

    monkeypatch.setattr(mixing, "KMeans", Fit)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('a', id % 40, ' b', id % 7) AS text")
    assert mixing.fit_topics(mixing.describe(docs)) is not None
    assert seen == [mixing.BATCH] and spark.conf.get(mixing.BATCH_ROWS) == old
