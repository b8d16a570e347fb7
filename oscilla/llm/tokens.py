"""Token counts by batch encoding in Arrow functions (operator 4).

Only lengths leave the Python workers. Texts are cut before each space that a
non-space follows: the byte-level pre-tokenizer starts a token there whatever
stands before, so the pieces' counts add up to the text's. Pieces repeat, so each
batch (filled up to a number of bytes, not rows) encodes only pieces it has not
met; the memo is emptied when it reaches its bound in pieces or bytes, and long pieces
do not enter it. A text longer than a batch is walked in slices that end at a safe
boundary: such a cut, or before other white space, or where letters meet digits.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read_table

BATCH = 4 << 20
MEMO, MEMO_BYTES = 1 << 20, 64 << 20
LONG = 256  # characters of a piece that is not remembered
CUT = re.compile(r" (?=\S)")
SAFE = re.compile(r" (?=\S)|(?<=[!-~])(?=[\t\n\r ])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def utf8(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def slices(text: str, size: int = BATCH) -> Iterator[str]:
    """Parts of about `size` bytes, cut at safe boundaries; a run without any (of letters, say) is one part."""
    at, step = 0, max(1, size // 4)  # a character has four bytes at most
    while at < len(text):
        end = at + step
        while end < len(text) and utf8(text[at:end]) < size:
            end += step
        m = SAFE.search(text, end) if end < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


class Counter:
    """Counts tokens of texts, remembering pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}
        self.held = 0

    def flush(self, parts: list[tuple[int, list[str], bool]], totals: list[int]) -> None:
        """Add to totals[row] for each (row, pieces after cuts, whether the first stands at a cut too)."""
        if len(self.memo) > MEMO or self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        known = self.memo
        new = list({p for _, ps, _ in parts for p in ps}.difference(known))
        found = dict(zip(new, map(len, self.tokenizer.encode_batch_fast([" " + p for p in new], add_special_tokens=False))))
        long = {p: n for p, n in found.items() if len(p) > LONG}
        for p, n in found.items():
            if len(p) <= LONG:
                known[p] = n
                self.held += sys.getsizeof(p)
        count = lambda p: known[p] if len(p) <= LONG else long[p]
        first = [(row, ps[0]) for row, ps, cut in parts if not cut]
        heads = self.tokenizer.encode_batch_fast([p for _, p in first], add_special_tokens=False)
        for (row, p), e in zip(first, heads):
            totals[row] += len(e) - count(p)
        for row, ps, _ in parts:
            totals[row] += sum(map(known.__getitem__, ps)) if not long else sum(map(count, ps))

    def counts(self, texts: list[str]) -> list[int]:
        totals, parts, size = [0] * len(texts), [], 0
        for row, text in enumerate(texts):
            if not text:
                continue
            for part in slices(text) if len(text) > BATCH // 4 else (text,):
                cut = part.startswith(" ")
                parts.append((row, CUT.split(part[1:] if cut else part), cut))
                size += utf8(part)
                if size >= BATCH:
                    self.flush(parts, totals)
                    parts, size = [], 0
        self.flush(parts, totals)
        return totals


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `path` is a byte-level BPE file of the tokenizers library; counts are those of the
    whole text, without added special tokens. A null text counts as empty (0, 0, false);
    very long texts are counted whole, in slices; null doc_ids and repeated rows stay, one
    for one; further columns, whatever their names, are ignored; an empty table gives no
    rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in bounded(it, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counter.counts(texts)
            sizes = list(map(utf8, texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
