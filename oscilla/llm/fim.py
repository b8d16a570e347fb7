"""Fill-in-the-middle by a table-driven byte automaton (operator 11).

One automaton reads UTF-8 bytes: it tells continuation bytes, starts of units (a run of
ASCII letters, or one other code point) and complete sentinels apart. Its state depends on
the last three bytes only, so a table over byte classes, looked up three times, gives all
states of a block of bytes at once. The first pass adds up the transitions that open a unit,
by block; the second looks for a cut in the one block that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 1 << 16  # bytes whose transitions are counted together
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

# classes of bytes
OTHER, LETTER, MARK, OPEN, CLOSE, LEAD, CONT, RESET = range(8)
# states: after another code point, in letters, at "<", at "<" and a mark, at a whole sentinel, inside a code point
START, WORD, BRACKET, MARKED, SENTINEL, INSIDE = range(6)


def byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, dtype=np.uint8)
    classes[ord("A") : ord("Z") + 1] = classes[ord("a") : ord("z") + 1] = LETTER
    classes[[ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)]] = MARK
    classes[ord("<")], classes[ord(">")] = OPEN, CLOSE
    classes[0x80:0xC0], classes[0xC0:] = CONT, LEAD
    return classes


def transitions() -> np.ndarray:
    """Next state by state and class."""
    table = np.zeros((6, 8), dtype=np.uint8)
    table[:, [OTHER, CLOSE, LEAD, RESET]] = START
    table[:, LETTER] = table[:, MARK] = WORD
    table[BRACKET, MARK], table[MARKED, CLOSE] = MARKED, SENTINEL
    table[:, OPEN], table[:, CONT] = BRACKET, INSIDE
    return table


CLASSES, TABLE = byte_classes(), transitions()
IN_WORD = np.isin(np.arange(6), (WORD, MARKED))


class Scan:
    """States after each byte of texts that lie one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        starts = offsets[:-1][np.diff(offsets) > 0]
        grid = np.arange(0, len(data), BLOCK, dtype=np.int64)
        self.edges = np.union1d(grid, starts)  # a block never crosses texts
        self.stops = np.append(self.edges[1:], len(data))
        self.resets = starts
        n = len(self.edges)
        self.units, self.chars, self.marks = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        # many short blocks are read together
        run = np.flatnonzero(np.diff(self.edges // BLOCK, prepend=-1))
        for low, high in zip(run, np.append(run[1:], n)):
            a, b = int(self.edges[low]), int(self.stops[high - 1])
            opens, heads, marks = self.flags(a, b)
            at = self.edges[low:high] - a
            self.units[low:high] = np.add.reduceat(opens, at, dtype=np.int64)
            self.chars[low:high] = np.add.reduceat(heads, at, dtype=np.int64)
            self.marks[low:high] = np.logical_or.reduceat(marks, at)
        self.first = np.searchsorted(self.edges, offsets)  # a text's first block

    def flags(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For bytes a to b: does a unit open, does a code point start, does a sentinel end."""
        back = min(a, 3)
        classes = CLASSES[self.data[a - back : b]]
        padded = np.concatenate([np.full(3, RESET, np.uint8), classes])
        low, high = np.searchsorted(self.resets, [a - back, b])
        at = self.resets[low:high] - (a - back) + 3
        states = np.zeros(len(padded), dtype=np.uint8)
        for k in (2, 1, 0):  # from the third last byte to the last
            shifted = np.full(len(padded), RESET, np.uint8)
            shifted[k:] = padded[: len(padded) - k]
            for j in range(k):  # bytes before the text's first
                inside = at[at + j < len(padded)]
                shifted[inside + j] = RESET
            states = TABLE[states, shifted]
        before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
        before[at] = START
        heads = padded != CONT
        opens = heads & ~(IN_WORD[states] & IN_WORD[before])
        cut = 3 + back
        return opens[cut:], heads[cut:], states[cut:] == SENTINEL

    def totals(self, per_block: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(per_block, dtype=np.int64)])
        return upto[self.first[1:]] - upto[self.first[:-1]]

    def locate(self, row: int, units: int) -> tuple[int, int]:
        """Byte position in data, and code points of the text before it, where `units` units of a text end."""
        low, high = self.first[row], self.first[row + 1]
        if low == high:
            return int(self.offsets[row]), 0
        upto = np.cumsum(self.units[low:high])
        block = int(np.searchsorted(upto, units, side="right"))
        chars = int(self.chars[low : low + block].sum())
        if block == high - low:
            return int(self.offsets[row + 1]), chars
        a = int(self.edges[low + block])
        opens, heads, _ = self.flags(a, int(self.stops[low + block]))
        at = int(np.flatnonzero(opens)[units - (int(upto[block - 1]) if block else 0)])
        return a + at, chars + int(heads[:at].sum())


def draws(seed: str, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hash of `seed:doc_id`; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output (the text to learn from).

    Cuts and form follow from `seed` and doc_id alone. A text stays plain if it is empty, holds
    a sentinel, or draws `plain_from` or more of 100; of the others, those drawing less than
    `spm_below` put the suffix first. A null text counts as empty, a null doc_id draws as an empty
    id; repeated rows stay, one for one; equal texts of different ids are cut independently; a very
    long text is cut whole, its bytes read in blocks; further columns, whatever their names, are
    ignored; an empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(it, 1):
            ids, column = b.column(0).to_pylist(), b.column(1).fill_null("")
            if not isinstance(column, pa.LargeStringArray):
                column = column.cast(pa.large_string())
            _, bounds, raw = column.buffers()
            offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            view = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else memoryview(b"")
            offsets = offsets - offsets[0]
            scan = Scan(np.frombuffer(view, dtype=np.uint8), offsets)
            counts, marked = scan.totals(scan.units), scan.totals(scan.marks) > 0
            forms, prefixes, middles, outputs = [], [], [], []
            for i, doc_id in enumerate(ids):
                n, (h1, h2, h3, h4) = int(counts[i]), draws(seed, doc_id)
                low, high = int(offsets[i]), int(offsets[i + 1])
                if n == 0 or marked[i] or h3 % 100 >= plain_from:
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(bytes(view[low:high]))
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                (p, before), (m, upto) = scan.locate(i, first), scan.locate(i, last)
                prefix, middle, suffix = view[low:p], view[p:m], view[m:high]
                spm = h4 % 100 < spm_below
                parts = (SUFFIX, suffix, PREFIX, prefix) if spm else (PREFIX, prefix, SUFFIX, suffix)
                forms.append("spm" if spm else "psm")
                prefixes.append(before)
                middles.append(upto - before)
                outputs.append(b"".join(x.encode() if isinstance(x, str) else x for x in (*parts, MIDDLE, middle)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of: sentinels have no borders, so the first of each kind is the one put in."""
    n = F.length(F.lit(PREFIX))

    def between(first: str, second: str) -> Column:
        low = F.instr(output, first) + n
        return F.substring(output, low, F.instr(output, second) - low)

    middle = F.substring(output, F.instr(output, MIDDLE) + n, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
cuts AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
