import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from oscilla.llm import toxicity as tox


def rows(n=160, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("ab cd efg hij klmno pqr stu vwx yz".split()) + "".join(rng.choices("aeioulmnst", k=rng.randint(0, 4))) for _ in range(60)]
        y = int(i % 3 == 0)
        if y:
            for _ in range(3):
                words[rng.randrange(60)] = "nastyx" + rng.choice(["ing", "ed", "er", "ful"])
        out.append((" ".join(words), y, 1.0))
    return out


def test_chain_matches_enumeration():
    rng = np.random.default_rng(0)
    e, m, first = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2))), 0.7
    n, starts = np.array([6, 3]), np.array([3, 0])
    *_, p = tox.chain(e, starts, n, m, first)
    for s, k in zip(starts, n):
        total, ones = 0.0, np.zeros(k)
        for ys in itertools.product((0, 1), repeat=int(k)):
            w = (first if ys[0] else 1.0) * np.prod([e[s + i] for i in range(k) if ys[i]])
            w *= np.prod([m[a, b] for a, b in zip(ys, ys[1:])])
            total += w
            ones += w * np.array(ys)
        assert np.allclose(p[s : s + k], ones / total)


def test_learns_unseen_endings_and_spans(spark):
    model = tox.fit(rows())
    texts = [(1, "ab cd nastyxly efg Nastyxest"), (2, "ab cd efg hij"), (3, None), (4, ""), (5, "12 ? _"), (6, "ab " * 30000)]
    texts += [(2, "ab cd efg hij"), (None, "klmno")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1)})
    got = tox.score_documents(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts) and by[1]["predicted"] == 1 and by[1]["spans"] == "6:14,19:28"
    assert all(by[i]["predicted"] == 0 and by[i]["spans"] == "" for i in (2, 3, 4, 5, 6, None))
    assert by[None]["held_out"] and tox.score_documents(docs.limit(0), model).count() == 0


def test_batching_does_not_matter():
    scorer, texts = tox.Scorer(tox.fit(rows())), [t for t, _, _ in rows(20, 9)] + [None, "x"]
    assert np.allclose(scorer.score(texts)[0], [scorer.score([t])[0][0] for t in texts])


def test_degenerate_training():
    for given, high in (([], False), ([("a b", 0, 1.0)], False), ([("a b", 1, 1.0)], True), ([(None, 0, 1.0), ("", 1, 1.0)], None)):
        score = tox.Scorer(tox.fit(given)).score(["a b", None])[0]
        assert high is None or ((score > 0.5) == high).all()


def test_held_out_recall(spark):
    d = "/root/testdata/sf0.01"
    got = tox.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.predicted == got.toxic).mean() > 0.93 and (held.predicted == held.toxic).mean() > 0.88
