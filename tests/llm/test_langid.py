import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import langid

DATA = "/root/testdata/sf0.01"


def model():
    return langid.learn([("the cat and the dog that was here", "en"), ("der hund und die katze ist nicht da", "de")] * 5)


def test_mixture_and_edges(spark):
    rows = [(1, "the dog and the cat"), (2, "Der Hund, und die Katze!"), (3, None), (4, "12 34 _ !"), (5, "")]
    rows += [(6, "the dog and the cat was here " * 9 + "der hund und die katze ist nicht da " * 9), (1, "the dog and the cat"), (None, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("zz"), "score": F.lit("s")})
    got = {r["doc_id"]: r for r in langid.identify(docs, model()).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert sorted(got[6]["languages"]) == ["de", "en"] and abs(sum(got[6]["shares"]) - 1) < 1e-6
    assert got[None]["held_out"] and 0 <= got[None]["score"] <= 1
    assert langid.identify(docs, model()).count() == len(rows)
    assert langid.identify(docs.limit(0), model()).count() == 0


def test_nothing_learned():
    assert langid.infer(["hello", None], *langid.learn([])) == [("und", 0.0, [], [])] * 2


def test_batching_does_not_matter():
    texts = ["the cat", "und die katze der", "x", "the dog und der hund was here"]
    alone = [langid.infer([t], *model())[0] for t in texts]
    together = langid.infer(texts, *model())
    for a, b in zip(alone, together):
        assert a[0] == b[0] and a[2] == b[2] and np.allclose(a[3], b[3])


def test_held_out_accuracy(spark):
    got = langid.op10_langid(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize("text", ["\u00bd", "\u00b2", "\u2460", "\u2167", "\u3007 12", "\u0664", "-- \u00be!"])
def test_numerals_are_no_letters(text):
    assert not any(c.isalpha() for c in text)
    assert langid.infer([text, "the cat"], *model())[0] == ("und", 0.0, [], [])


def test_ties_go_to_the_first_language():
    same = langid.learn([("one two three", "b"), ("one two three", "a")])
    assert [r[0] for r in langid.infer(["one two", "three zzz"], *same)] == ["a", "a"]


def plain_em(words):
    """Proportions and log-likelihood of one document, a word at a time, in Python."""
    k = len(words[0])
    share = [1 / k] * k
    for _ in range(langid.STEPS):
        new = [0.0] * k
        for w in words:
            top = max(w)
            r = [s * math.exp(x - top) for s, x in zip(share, w)]
            for i in range(k):
                new[i] += r[i] / sum(r) / len(words)
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < langid.TOLERANCE:
            break
    return share, sum(math.log(sum(s * math.exp(x) for s, x in zip(share, w))) for w in words)


def test_mixtures_match_plain_em():
    rng = np.random.default_rng(6)
    sizes = [1, 5, 40, 3, 17]
    p = rng.normal(size=(sum(sizes), 4)) * 2 - 10
    starts = np.cumsum(sizes) - sizes
    share, like = langid.mixtures(p, starts)
    for i, (a, n) in enumerate(zip(starts, sizes)):
        want, total = plain_em(p[a : a + n].tolist())
        assert np.allclose(share[i], want, atol=1e-9) and abs(like[i] - total) < 1e-6


def test_sets_of_four_languages_and_slices(monkeypatch):
    words = {"a": "aba bab abba", "b": "cdc dcd cddc", "c": "efe fef effe", "d": "ghg hgh ghhg"}
    m = langid.learn([(t, k) for k, t in words.items()])
    text = " ".join(t + " " + t for t in list(words.values()) * 5)
    lang, score, langs, shares = langid.infer([text], *m)[0]
    assert sorted(langs) == list("abcd") and np.allclose(shares, 0.25, atol=0.02)
    whole = langid.infer([text, "aba " * 50], *m)
    monkeypatch.setattr(langid, "SLICE", 7)
    for x, y in zip(langid.infer([text, "aba " * 50], *m), whole):
        assert x[2] == y[2] and np.allclose(x[3], y[3])


def test_very_long_texts_by_their_different_words(monkeypatch):
    m = langid.learn([("aba bab abba", "a"), ("cdc dcd cddc", "b"), ("efe fef effe", "c")])
    texts = ["aba bab cdc " * 60, "efe " * 40 + "x" * 90, "aba", None, "bab dcd efe abba " * 50]
    want = langid.infer(texts, *m)
    monkeypatch.setattr(langid, "NUMBERS", 40)
    for x, y in zip(langid.infer(texts, *m), want):
        assert x[0] == y[0] and x[2] == y[2] and np.allclose(x[3], y[3], atol=1e-5) and abs(x[1] - y[1]) < 1e-5


def test_memory_of_many_languages():
    """A hundred languages and a text of 250 kB: less than 200 MB beside the model."""
    rng = np.random.default_rng(8)
    langs = [f"l{i:03}" for i in range(100)]
    table = np.log(rng.dirichlet(np.ones(100), langid.BUCKETS)).astype(np.float32)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(50_000))
    table[langid.trigrams(langid.words_of(text).encode())[0], 7] += 5
    tracemalloc.start()
    try:
        assert [r[0] for r in langid.infer([text, text[:2000]], langs, table)] == ["l007"] * 2
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, languages=5)


def test_counts_in_tasks_equal_counts_at_once(spark):
    rows = [(i, ("the cat \u00bd and dog %d" % i) if i % 2 else "der hund", "en" if i % 2 else "de") for i in range(60)] + [(99, None, "fr"), (98, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    kept = [r for r in docs.where(~langid.held_out()).collect() if r["lang"] and r["text"]]
    want = langid.learn([(r["text"], r["lang"]) for r in kept])
    got = langid.train(docs)
    assert got[0] == want[0] and np.array_equal(got[1], want[1])
