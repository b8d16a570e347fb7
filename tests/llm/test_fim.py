import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oscilla.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm_below else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def scanned(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return fim.Scan(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets), offsets


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("<PSM>ab é漢😀\n"), max_size=20), max_size=6), st.integers(1, 9))
def test_automaton(texts, block):
    fim.BLOCK, old = block, fim.BLOCK
    try:
        scan, offsets = scanned(texts)
        units = [UNIT.findall(t) for t in texts]
        assert scan.totals(scan.units).tolist() == list(map(len, units))
        assert scan.totals(scan.chars).tolist() == list(map(len, texts))
        assert (scan.totals(scan.marks) > 0).tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
        for i, us in enumerate(units):
            for k in range(len(us) + 1):
                before = "".join(us[:k])
                assert scan.locate(i, k) == (offsets[i] + len(before.encode()), len(before))
    finally:
        fim.BLOCK = old


ROWS = [
    (1, "Hello, world"), (1, "Hello, world"), (2, None), (3, ""), (None, "no id é"), (4, "has <P> inside"), (5, "<S"), (6, "a<M>"),
    (7, "<P" * 40), (8, "漢字 and 😀 " * 30), (9, "word " * 90_000), (10, "\n\t\x00 x"), *[(i, f"text {i} of <b>some</b> words, é") for i in range(20, 80)],
]


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("output", F.lit("clash")).repartition(3)
    made = fim.fill_in_middle(docs)
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=str) == sorted([(d, *brute(d, t)) for d, t in ROWS], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(d, t or "") for d, t in ROWS], key=str)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_shares(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [tuple(r) for r in fim.fill_in_middle(docs, plain_from=100, spm_below=100).collect()]
    assert sorted(got, key=str) == sorted([(d, *brute(d, t, 100, 100)) for d, t in ROWS], key=str)


def same(got, want):
    key = lambda rows: sorted([tuple(None if x != x else x for x in r) for r in rows], key=str)
    assert key(map(tuple, got.collect())) == key(want.select(*got.columns).fetchall())


def test_sql(spark):
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    same(fim.op11_fim(spark, "/root/testdata/sf0.001"), db.sql(fim.ORACLE))


def test_sql_edges(spark, tmp_path):
    table = pa.table({"doc_id": [d for d, _ in ROWS], "text": [t for _, t in ROWS]})
    pq.write_table(table, tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.register("documents", table)
    same(fim.op11_fim(spark, str(tmp_path)), db.sql(fim.ORACLE))
