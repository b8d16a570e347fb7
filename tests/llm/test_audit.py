import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oscilla.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    return [len(text), len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)]


def measured(texts, scanner=None):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    counts = (scanner or audit.Scanner()).counts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return [list(map(int, row)) for row in zip(*counts)]


TEXTS = st.text(alphabet=st.sampled_from("aAbB #$\t\n\x0b\x1c\x85é漢😀 "), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_counts(texts):
    assert measured(texts) == list(map(plain, texts))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_shared_hashes_are_told_apart(texts):
    class Weak(audit.Scanner):
        def words(self, data, offsets):
            starts, ends, hashes = super().words(data, offsets)
            return starts, ends, hashes % np.uint64(3)

    assert measured(texts, Weak()) == list(map(plain, texts))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_long_text_in_slices(text, size):
    audit.SLICE, old = size, audit.SLICE
    try:
        assert measured([text * 3]) == [plain(text * 3)]
    finally:
        audit.SLICE = old


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    firsts = {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    docs = []
    for d, t, s in rows:
        n, words, distinct, capitals, symbols = plain(t or "")
        fails = {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * capitals > 5 * n, "D": symbols > 0, "E": d is not None and d > firsts[t or ""]}
        docs.append((s or "", d, {f for f, hit in fails.items() if hit}))
    out, shapley = [], Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, _, _ in docs}:
            left, gone = [x for x in docs if x[0] == part], []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[2]]
                late = sum(f in x[2] for x in gone)
                left = [x for x in left if f not in x[2]]
                shapley[part, f] += len(hit)
                alone = sum(x[0] == part and x[2] == {f} for x in docs)
                out.append([part, "".join(order), step, len(left), len(hit), late, alone, sum(x[1] in good for x in hit), sum(x[1] in toxic for x in hit), f])
                gone += hit
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"word{i} the of" for i in range(30))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "a"), (1, LONG, "a"), (3, None, "a"), (4, "", None), (5, "", "b"), (None, LONG, "a"), (None, None, None),
    (6, "SHOUT " * 60, "a"), (7, "# list", "a"), (8, "word " * 400_000, "c"), (9, LONG + " 100 %", "c"), (10, LONG + " 100 %", ""), (11, LONG + "X", "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (4, 1, None), (7, 1, 0), (8, None, 1), (9, 1, 1), (10, 1, 1), (99, 1, 1), (None, 1, 1)]


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("n", F.lit(7)).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    got = sorted(map(tuple, audit.audit(docs, labels).select(*COLUMNS).collect()))
    assert got == brute(ROWS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {r[7] for r in map(tuple, audit.audit(docs, labels.limit(0)).select(*COLUMNS).collect())} == {0}


def test_fewer_filters(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = audit.audit(docs, labels, {"S": "n_words < 3", "R": "repeat"}).where("part = 'b'").collect()
    assert {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {
        ("SR", 1, 1, 1, 0, 1), ("SR", 2, 0, 1, 1, 3), ("RS", 1, 0, 2, 0, 3), ("RS", 2, 0, 0, 1, 1)
    }


def same(got, want):
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(want.select(*COLUMNS).fetchall())


def test_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    same(audit.op12_audit(spark, "/root/testdata/sf0.001"), db.sql(audit.ORACLE))


def test_sql_edges(spark, tmp_path):
    docs = pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*ROWS)))))
    labels = pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*LABELS)))))
    db = duckdb.connect()
    for name, table in (("documents", docs), ("labels", labels)):
        pq.write_table(table, tmp_path / f"{name}.parquet")
        db.register(name, table)
    same(audit.op12_audit(spark, str(tmp_path)), db.sql(audit.ORACLE))
