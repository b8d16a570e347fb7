import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import suffix


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: suffix.LAST if d is None else d
    least = {}
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(key(d), least.get(w, key(d)))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        keep = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def documents():
    rng = random.Random(4)
    words = ["ab", "cde", "the", "of", "ünd", "x", "longer", "wörds"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passages = [prose(30) for _ in range(4)]
    rows = []
    for i in range(60):
        t = prose(rng.randint(0, 60))
        for _ in range(i % 3):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            t += " " + p[a : a + rng.randint(40, 160)] + " " + prose(3)
        rows.append((rng.randint(0, 10**6) if i % 5 else i, t))
    rows += [rows[3], (999_999_999, rows[3][1]), (rows[4][0], rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (None, None), (70, ""), (71, "short")]
    rows += [(80, "a" * 300), (81, "a" * 49), (82, "a" * 50 + "b"), (83, "ab" * 100), (84, "b" + "ab" * 60), (85, "q" + rows[7][1] + "é"), (86, "\0" * 120), (87, "\0" * 60 + "x")]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 5000)
    docs = spark.createDataFrame(documents(), "doc_id long, text string").withColumns({"key": F.lit("x"), "h": F.lit(1), "n_bytes": F.lit(1)})
    got = sorted((str(r[0]), *r[1:]) for r in suffix.remove_repeats(docs).collect())
    assert got == brute(documents())


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("spill", [False, True])
def test_suffix_order(tmp_path, monkeypatch, spill):
    if spill:
        monkeypatch.setattr(suffix, "QUEUE_BYTES", 64)
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, top = int(rng.integers(1, 120)), int(rng.integers(1, 5))
        text = np.concatenate([rng.integers(1, top + 1, n), [0]]).astype(np.int16)
        order, shared = suffix.suffix_order(text, str(tmp_path))
        assert sorted(order) == list(range(n + 1))
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert [text[i : i + 50].tolist() for i in order] == [text[i : i + 50].tolist() for i in want], trial
        for i, (a, b) in enumerate(zip(order[1:], order[:-1]), 1):
            k = 0
            while k < 50 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert shared[i] == k, trial


def test_runs_in_slices(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(400)) + b"z" * 200
    whole = suffix.runs(text)
    assert whole[2].sum() == len(text) - 49 and whole[2].max() <= suffix.WINDOW
    monkeypatch.setattr(suffix, "SLICE", 64)
    h, s, c = suffix.runs(text)
    by_window = lambda h, c: np.repeat(h, c).tolist()
    assert by_window(h, c) == by_window(whole[0], whole[2])


def test_contested_misses_nothing():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(50, 400))) for _ in range(60)]
    texts += [t[: rng.randint(20, 200)] + texts[i - 1][30:140] + t[-40:] for i, t in enumerate(texts)] + [b"ab" * 90, b"a" * 120 + texts[0]]
    rows = sorted({(int(np.int64(np.uint64(h))) if h < 2**63 else int(h) - 2**64, t[s : s + c + 49]) for t in texts for h, s, c in zip(*(x.tolist() for x in suffix.runs(t)))})
    h, segs = np.array([r[0] for r in rows]), [r[1] for r in rows]
    held = {}
    for i, s in enumerate(segs):
        for j in range(len(s) - 49):
            held.setdefault((h[i], s[j : j + 50]), set()).add(i)
    want = {i for found in held.values() if len(found) > 1 for i in found}
    keep = set(np.flatnonzero(suffix.contested(h, segs)).tolist())
    assert want and want <= keep and len(keep) < len(segs)
