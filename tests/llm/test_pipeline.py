import corpus_pipeline
from oscilla.llm import decontam, pii, simhash, toxicity
from oscilla.llm.common import read_table

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = read_table(spark, DATA, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "mixing":
            assert docs.columns == columns
        out[name] = (before.toPandas(), docs.toPandas())
    before, after = out["toxicity"]
    labels = read_table(spark, DATA, "labels").toPandas().set_index("doc_id").toxic
    gone = set(before.doc_id) - set(after.doc_id)
    assert gone and labels.reindex(list(gone)).dropna().mean() > 0.9
    before, after = out["simhash_dedup"]
    prints = {d: simhash.text_fingerprint(t) for d, t in zip(before.doc_id, before.text)}
    kept = set(after.doc_id)
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert all(any(near(d, k) for k in prints if k < d) for d in set(prints) - kept)
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    before, after = out["decontamination"]
    matcher = next(decontam.matchers(read_table(spark, DATA, "benchmark")))
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if not matcher.find(t)}
    before, after = out["pii"]
    assert set(before.doc_id) == set(after.doc_id) and not any(pii.base_spans(t) for t in after.text)
    assert (after.n_chars == after.text.map(len)).all()
    before, after = out["mixing"]
    assert 0 < len(after) < len(before)


def test_messy_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, y int, weight array<int>"
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 5, "x", 1, 1, [1]), (1, words, "en", "a", 5, "x", 1, 1, [1]), (2, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, "", 0, 0, [])]
    rows += [(None, words + " more", None, "b", 1, None, None, None, None), (4, words, "en", "b", 5, "x", 1, 1, [1]), (5, "z " * 100_000, "en", "a", 1, "x", 1, 1, [1]), (6, "call +1 (988) 555-2485 now", "en", "a", 1, "x", 1, 1, [1])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == schema_names(schema), name
        kept = docs.collect()
        assert any(r["doc_id"] == 5 for r in kept) and any(r["doc_id"] is None for r in kept), name
    assert not any(r["doc_id"] == 4 for r in kept) and [r["text"] for r in kept if r["doc_id"] == 6] == ["call [PHONE] now"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(kept)


def schema_names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def test_empty(spark):
    docs = read_table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
    assert isinstance(toxicity.fit([]), toxicity.Model)
