"""How document filters interact, in every order (operator 12).

One scan of the Arrow buffer of the texts measures what the filters ask for: bytes are looked
up in a table of classes, prefix sums of the classes give the counts of each text, and prefix
sums of a polynomial over the bytes give a hash of each word. Distinct words are runs of the
sorted hashes of a text; neighbours of a run are compared byte by byte, and a text in which two
words share a hash is counted again from its words. A filter's failure is a bit of a mask; all
the rest is arithmetic on counts of masks, so nothing grows with the number of orders but the
result. Repeats of a text are those with another doc_id than the group's smallest: a minimum
by hash, joined back by hash and id, so that large groups of copies are no large keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, read_table

FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_symbols > 0",
    "E": "repeat",
}
SLICE = 1 << 20  # bytes of text scanned at a time
SPACE, CAPITAL, SYMBOL, HEAD = 1, 2, 4, 8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
SCHEMA = "doc_id long, part string, n_chars long, n_words long, n_distinct long, n_capitals long, n_symbols long, digest binary"


def byte_classes() -> np.ndarray:
    classes = np.zeros(256, dtype=np.uint8)
    classes[[0x20, *range(0x09, 0x0E)]] |= SPACE
    classes[ord("A") : ord("Z") + 1] |= CAPITAL
    classes[[ord(c) for c in "#$%&*|"]] |= SYMBOL
    classes[:0x80] |= HEAD
    classes[0xC0:] |= HEAD
    return classes


CLASSES = byte_classes()


def prefix_sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


class Scanner:
    """Word hashes and counts of texts that lie one after another; keeps its tables of powers."""

    def __init__(self) -> None:
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word."""
        self.grow(len(data) + 1)
        space = (CLASSES[data] & SPACE) > 0
        open_ = ~space
        open_[1:] &= space[:-1]
        close = ~space
        close[:-1] &= space[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text ends its last word
        open_[inner] = ~space[inner]
        close[inner - 1] = ~space[inner - 1]
        starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        return starts, ends, (sums[ends] - sums[starts]) * self.inverses[starts]

    @staticmethod
    def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of distinct words in each of n rows, and places of one word for each."""
        order = np.lexsort((hashes, rows))
        again = np.zeros(len(order), bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        counts = np.bincount(rows[order[~again]], minlength=n)
        second, first = order[np.flatnonzero(again)], order[np.flatnonzero(again) - 1]
        bad = set(rows[second[ends[second] - starts[second] != ends[first] - starts[first]]].tolist())
        same = ends[second] - starts[second] == ends[first] - starts[first]
        first, second = first[same], second[same]
        sizes = ends[first] - starts[first]
        begin = np.cumsum(sizes) - sizes
        steps = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(begin, sizes)
        differ = data[np.repeat(starts[first], sizes) + steps] != data[np.repeat(starts[second], sizes) + steps]
        if differ.any():
            bad |= set(np.repeat(rows[first], sizes)[differ].tolist())
        keep = order[~again]
        for row in bad:  # two words with one hash: count the words themselves
            seen = {data[starts[i] : ends[i]].tobytes(): i for i in np.flatnonzero(rows == row)}
            counts[row] = len(seen)
            keep = np.concatenate([keep[rows[keep] != row], np.fromiter(seen.values(), np.int64)])
        return counts, keep

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text: characters, words, distinct words, capitals, symbols."""
        n = len(offsets) - 1
        if n == 1 and len(data) > 2 * SLICE:
            return self.long(data)
        classes = CLASSES[data]
        flags = {k: prefix_sums((classes & k) > 0) for k in (HEAD, CAPITAL, SYMBOL)}
        chars, capitals, symbols = (np.diff(flags[k][offsets]) for k in (HEAD, CAPITAL, SYMBOL))
        starts, ends, hashes = self.words(data, offsets)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        return [chars, np.bincount(rows, minlength=n), self.distinct(data, starts, ends, hashes, rows, n)[0], capitals, symbols]

    def long(self, data: np.ndarray) -> list[np.ndarray]:
        """One very long text: slices that end at white space, then the distinct words of all slices."""
        totals, found, low = np.zeros(4, np.int64), [], 0
        while low < len(data):
            high = min(low + SLICE, len(data))
            while high < len(data) and not CLASSES[data[high - 1]] & SPACE:  # to the end of a word
                ahead = np.flatnonzero(CLASSES[data[high : high + SLICE]] & SPACE)
                high = high + int(ahead[0]) + 1 if len(ahead) else min(high + SLICE, len(data))
            part = data[low:high]
            classes = CLASSES[part]
            starts, ends, hashes = self.words(part, np.array([0, len(part)]))
            totals += [((classes & HEAD) > 0).sum(), len(starts), ((classes & CAPITAL) > 0).sum(), ((classes & SYMBOL) > 0).sum()]
            _, keep = self.distinct(part, starts, ends, hashes, np.zeros(len(starts), np.int64), 1)
            found.append((starts[keep] + low, ends[keep] + low, hashes[keep]))
            low = high
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found))
        counts, _ = self.distinct(data, starts, ends, hashes, np.zeros(len(starts), np.int64), 1)
        return [totals[:1], totals[1:2], counts, totals[2:3], totals[3:]]


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part (the source; null counts as empty), the counts, and the text's digest.

    A null text counts as empty; very long texts are measured whole; repeated rows stay.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in bounded(it, 2, SLICE):
            column = b.column(2).fill_null("")
            if not isinstance(column, pa.LargeStringArray):
                column = column.cast(pa.large_string())
            _, bounds, raw = column.buffers()
            offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            view = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else memoryview(b"")
            offsets = offsets - offsets[0]
            counts = scanner.counts(np.frombuffer(view, dtype=np.uint8), offsets)
            digests = [hashlib.sha256(view[low:high]).digest() for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.binary())],
                ["doc_id", "part", "n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols", "digest"],
            )

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), part, F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many documents of a part fail exactly the filters of the mask.

    A repeat is a document whose text some smaller doc_id has too; a null doc_id is neither
    smaller nor greater than another, and has no label. Of several labels of one doc_id each
    counts once if any row has it.
    """
    measured = materialize(measure(docs), "measured")
    firsts = measured.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    )
    failed = [F.when(F.expr(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters.values())]
    counted = (
        measured.join(firsts, ["digest", "doc_id"], "left")
        .join(marks, "doc_id", "left")
        .withColumn("repeat", F.col("doc_id").isNotNull() & F.col("first").isNull())
        .groupBy("part", sum(failed[1:], failed[0]).alias("mask"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    found = materialize(counted, "masks")
    discard(measured)
    return found


def outcomes(spark: SparkSession, names: str) -> DataFrame:
    """What each order and step does to a mask: a table whose size depends on the number of filters alone."""
    rows = []
    orders = list(permutations(names))
    for order in orders:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            for mask in range(1 << len(names)):
                fails, earlier = bool(mask & bit), bool(mask & before)
                share = len(orders) // mask.bit_count() if fails else 0  # orders in which it is the first to fail
                rows.append((mask, "".join(order), step, *map(int, (not fails and not earlier, fails and not earlier, fails and earlier, mask == bit, share))))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays long, goes long, late long, alone long, share long")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` names SQL conditions of failure over the columns of `measure` and `repeat`; their
    number's factorial is the number of orders. Counts are over all documents of a part, zeros
    included; shapley is what the step's filter removes, added up over all orders. Null, empty
    and very long texts, null ids and labels are treated as in `measure` and `masks`; further
    columns, whatever their names, are ignored; an empty table has no parts and gives no rows.
    """
    names = "".join(filters)
    cells = masks(docs, labels, filters)
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    return (
        cells.join(F.broadcast(outcomes(docs.sparkSession, names)), "mask")
        .groupBy("part", "filter_order", "step")
        .agg(
            total("n * stays", "kept"), total("n * goes", "removed"), total("n * late", "redundant"), total("n * alone", "unique_fails"),
            total("good * goes", "good_lost"), total("toxic * goes", "toxic_lost"), total("n * share", "shapley"),
        )
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
counted AS (
  SELECT doc_id, part, t.text, first, regexp_extract_all(t.text, '[^\t\n\v\f\r ]+') AS words
  FROM texts t JOIN firsts f ON t.text = f.text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT c.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN c.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM counted c LEFT JOIN marks m ON c.doc_id = m.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
states AS (
  SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS hit,
    regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone
  FROM cells, steps),
sums AS (
  SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM states GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM sums
"""
