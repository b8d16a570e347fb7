import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from oscilla.llm import decontam


def brute(text, items):
    words, out = decontam.words_of(text), []
    for item_id, t in items:
        item = decontam.words_of(t)
        if not item:
            continue
        k, n = min(5, len(item)), len(item)
        own = Counter(tuple(item[i : i + k]) for i in range(n - k + 1))
        likes = []
        for s in range(len(words) - n + 1):
            w = Counter(tuple(words[s + i : s + i + k]) for i in range(n - k + 1))
            low = (own & w).total()
            likes.append((low / (own | w).total(), -s))
        if likes and max(likes)[0] >= 0.8:
            out.append((item_id, max(likes)[0], -max(likes)[1]))
    return sorted(out)


def setting():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))) for i in range(25)]
    items += [(100, "tiny unique item"), (101, ""), (102, None), (103, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 2:
            passage = items[i % 25][1].split()
            for _ in range(i % 4):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    docs += [(90, "A Tiny, UNIQUE item!"), (91, None), (92, ""), (93, "w1 " * 50), (None, items[3][1]), (1, docs[1][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = setting()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "start": F.lit(1)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r[0]), r[1], round(r[2], 9), r[4]) for r in decontam.contaminated(d, b).collect()]
    want = [(str(i), item, round(like, 9), s) for i, t in docs for item, like, s in brute(t, items)]
    assert sorted(got) == sorted(want) and len(want) > 5
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(i) for i, t in docs if not brute(t, items))


def test_empty(spark):
    docs, items = setting()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_blocks_and_slices(spark, monkeypatch):
    docs, items = setting()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontam.contaminated(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 10)
    assert sorted(map(str, decontam.contaminated(d, b).collect())) == want
    monkeypatch.setattr(decontam, "SLICE", 16)
    m, long = decontam.Matcher(items), " ".join(t for _, t in docs if t)
    assert sorted({i for i, *_ in m.find(long)}) == [i for i, *_ in brute(long, items)]


def test_two_word_cycles():
    """Nine shingles of two kinds: a shift by one word turns every bit in which the two differ."""
    rng = random.Random(5)
    for _ in range(60):
        a, b = rng.sample([f"v{i}" for i in range(1000)], 2)
        item = " ".join(([a, b] * 7)[:13])
        shifted = " ".join(([b, a] * 7)[:13])
        assert [h[:2] for h in decontam.Matcher([(1, item)]).find(shifted)] == [(1, 0.8)]


def test_no_loss_on_repetitive_short_and_edited_items():
    rng = random.Random(11)
    for vocab, rounds in ((2, 60), (4, 60), (12, 40), (200, 40)):
        for _ in range(rounds):
            words = [f"w{i}" for i in range(vocab)]
            items = []
            for i in range(6):
                base = [rng.choice(words) for _ in range(rng.randint(1, 9))]
                items.append((i, " ".join((base * 30)[: rng.randint(1, 70)] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 70))])))
            text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
            for _, t in items:
                part = t.split()
                for _ in range(rng.randint(0, 1 + len(part) // 25)):
                    at = rng.randrange(len(part) + 1)
                    part[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
                text += part
            got = [(i, round(like, 9), s) for i, like, _, s in decontam.Matcher(items).find(" ".join(text))]
            assert got == [(i, round(like, 9), s) for i, like, s in brute_whole(" ".join(text), items)]


def test_the_index_selects():
    rng = np.random.default_rng(2)
    for n in (9, 20, 46, 200):
        items = [rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2000)]
        index = decontam.MultiIndex(items)
        other = decontam.packed(np.concatenate([decontam.Majorities(rng.integers(0, 2**63, n, dtype=np.uint64), index.blocks).of(np.array([0]), n)[0] for _ in range(50)]) > 0)
        returned = {(w, i) for w, i, _ in zip(*map(np.ndarray.tolist, index.entered(other)))}
        assert len(returned) < 0.1 * 50 * len(items)
        # windows that differ from an item in as many shingles as 0.8 allows
        for i in range(50):
            swap = int(decontam.SLACK * n / 2 + 1e-9)
            near = items[i].copy()
            near[rng.choice(n, swap, replace=False)] = rng.integers(0, 2**63, swap, dtype=np.uint64)
            fp = decontam.packed(decontam.Majorities(near, index.blocks).of(np.array([0]), n)[0] > 0)
            assert [0, i] in index.lookup(fp).tolist()


def brute_whole(text, items):
    """brute(), and texts shorter than an item as one window."""
    words, out = decontam.words_of(text), brute(text, items)
    for item_id, t in items:
        item = decontam.words_of(t)
        k = min(5, len(item))
        if k <= len(words) < len(item):
            own, w = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (item, words))
            if (like := (own & w).total() / (own | w).total()) >= 0.8:
                out.append((item_id, like, 0))
    return sorted(out)


def test_documents_shorter_than_the_item(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice([f"w{j}" for j in range(300)]) for _ in range(10 + 2 * i))) for i in range(40)] + [(90, "a b c"), (91, "x " * 30)]
    docs = []
    for i, t in items:
        words = t.split()
        for cut in (1, 2, 4, 9):
            docs += [(i, " ".join(words[cut:])), (i, " ".join(words[:-cut]))]
        docs.append((i, " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])))
    fifty = [f"u{j}" for j in range(50)]
    items, docs = [*items, (99, " ".join(fifty))], [*docs, (99, " ".join(fifty[:-1])), (98, " ".join(fifty[1:]))]
    want = sorted((i, item, round(like, 9), s) for i, t in docs for item, like, s in brute_whole(t, items))
    assert (99, 99, round(45 / 46, 9), 0) in want and not brute(docs[-1][1], items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r[0], r[1], round(r[2], 9), r[4]) for r in decontam.contaminated(d, b).collect()) == want
    kept = sorted(map(tuple, decontam.decontaminate(d, b).collect()))
    assert kept == sorted(x for x in docs if not brute_whole(x[1], items))
    # the end of a long text is no whole text
    monkeypatch.setattr(decontam, "SLICE", 8)
    m, long = decontam.Matcher([(99, " ".join(fifty))]), " ".join(["z"] * 100 + fifty[:-1])
    assert [h[3] for h in m.find(long)] == [99]
