import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oscilla.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
COUNTER = tokens.Counter(PATH)


def brute(text):
    return len(PLAIN.encode(text or "", add_special_tokens=False).ids)


TEXTS = ["", " ", "  a", "a  b", "a\n b", "a \n b", "it's  \t x", "<|endoftext|> x<|endoftext|>", " <|endoftext|>", "a\x1c b", "\x85 b ", "　 x", "ä ö  ​ ü", "1 2  3 !!  ?", "don 't 'll x"]


def test_edges():
    assert COUNTER.counts(TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x1c\x85　ab'1!<|>é"), max_size=40))
def test_pieces_add_up(text):
    assert COUNTER.counts([text]) == [brute(text)]


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH", 50)
    text = "some words  and\n spaces 12 " * 40 + "x" * 300
    assert list(map(str, tokens.slices(text, 50))) and "".join(tokens.slices(text, 50)) == text
    assert COUNTER.counts([text, "a b", text]) == [brute(text), 2, brute(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x1c　ab'1!<|>é"), max_size=60), st.integers(1, 9))
def test_slices_add_up(text, size):
    parts = list(tokens.slices(text, size))
    assert "".join(parts) == text and sum(map(brute, parts)) == brute(text)


def test_unbreakable_text_of_several_batches(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH", 64)
    monkeypatch.setattr(tokens, "MEMO_BYTES", 200)
    text = "ab" * 400 + "\n\n" + "ä" * 300 + "12" * 200 + " " * 90 + "x"
    counter = tokens.Counter(PATH)
    assert counter.counts([text, "a " + text, text]) == [brute(text), brute("a " + text), brute(text)]
    assert all(len(p) <= tokens.LONG for p in counter.memo)
    assert max(len(p.encode()) for p in tokens.slices(text, 64)) < 1100  # the runs of letters and digits


def test_query(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "word " * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = [tuple(r) for r in tokens.count_tokens(docs, PATH).collect()]
    want = [(d, len((t or "").encode()), brute(t), brute(t) > 512) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0
