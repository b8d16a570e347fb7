import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oscilla.llm import simhash
from oscilla.llm.common import components

SCHEMA = "doc_id long, text string, fp string, root long"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    rows = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted((str(d), f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp))


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for base in range(4):
        text = [rng.choice(words) for _ in range(120)]
        for copy in range(25):
            t = list(text)
            for _ in range(copy % 4):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "ä Ä b"), (206, "x " * 70000)]
    return rows + rows[:3] + [(None, rows[0][1]), (None, "alone text here now")]


def test_matches_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1)})
    got = sorted((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("kept,cell", [(5, 2000), (7, 2000), (3, 8), (25, 1)])
def test_every_grid_gives_the_same(spark, monkeypatch, kept, cell):
    """Cells of more groups, and cells that are cut by finer grids."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(kept)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(40) for _ in range(40)}
    rows = sorted(fps)
    root = {x: x for x in rows}
    for a in rows:
        for b in rows:
            if a < b and (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame([(simhash._signed(x),) for x in rows], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.near_links(df, 3, kept).select(F.col("node").alias("fp"), "root").collect()}
    groups = lambda of: sorted(sorted(v) for v in of.values() if len(v) > 1)
    mine, want = {}, {}
    for x in rows:
        f = simhash._signed(x)
        mine.setdefault(got.get(f, f), []).append(x)
        want.setdefault(root[x], []).append(x)
    assert groups(mine) == groups(want)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "fp", "root"]


def test_links_keep_every_pair(spark):
    """Clusters of random fingerprints that chains of 1 to 3 bits connect."""
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(30):
        x = int(rng.integers(0, 2**63)) * 2
        for _ in range(20):
            fps.append(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    root = {r[0]: r[1] for r in simhash.near_links(df).collect()}
    values = sorted({simhash._signed(f) for f in fps})
    comp = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and comp[a] != comp[b]:
                x, y = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: y if c == x else c for k, c in comp.items()}
    assert {v: root.get(v, v) for v in values} == comp


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = components(df).collect()
    assert sorted(r[0] for r in got) == list(range(1, 300)) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("text", ["A b C", "ünï cödé wörds ÄÖ", "a", "a\x0bb\x1cc d\x85e"])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == brute_fp(text)
