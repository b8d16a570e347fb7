"""Benchmark decontamination by SimHash windows (operator 9).

A document holds an item if some window of as many words as the item has a weighted
five-word-shingle similarity (sum of smaller over sum of larger multiplicities) of
0.8 or more with it; a document with fewer words than the item is one window as a whole.
Such a window shares a shingle with the item, so only windows over shared shingles are
fingerprinted.

A fingerprint is a row of 64-bit SimHash blocks; a shingle counts in the block its hash
names, and a block holds CLASS shingles of the item on average. A window of similarity
0.8 differs from an item of n shingles in at most SLACK * n of them, so in some block
that the item fills it differs in at most SLACK times the item's shingles there, and
there no bit can flip whose majority is larger than that. An item's radius in a block is
thus the number of its open bits, and no pair within it is lost: the index holds an item
in each block under all values of the sixteen bits with the fewest open ones, the other
settled bits are compared next, and the exact similarity decides. Benchmark items are
the stated query set: they are taken in blocks of bounded rows and bytes, and documents
never shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read_table

WIDTH = 5
SIMILARITY = 0.8
SLACK = 2 * (1 - SIMILARITY) / (1 + SIMILARITY)  # shingles that differ, of an item's, at that similarity
CLASS = 6  # an item's shingles in a block of the fingerprint, on average
PART = 16  # bits of a block that the index enters
BLOCK, BLOCK_BYTES = 20_000, 4 << 20  # items, and their text, of a block of the benchmark: its matcher has some ten times the bytes
SLICE = 1 << 18  # words of a document handled at once
WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, similarity double, hamming int, start_word long"
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    rows = zip(*(data[i:] for i in range(k)))
    return np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows], dtype=np.uint64)


class Majorities:
    """Ones less zeros of each bit over any run of shingles, for each block of the fingerprint."""

    def __init__(self, hashes: np.ndarray, blocks: int):
        own = ((hashes * WEIGHTS[0]) >> np.uint64(40)) % np.uint64(blocks)
        order = np.argsort(own, kind="stable")
        signs = np.unpackbits(hashes[order].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        self.sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signs, axis=0)])
        self.base = np.searchsorted(own[order], np.arange(blocks, dtype=np.uint64))
        self.places = np.split(order, self.base[1:])

    def of(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(majority of each window, block and bit; shingles of each window and block) of n shingles from each start on."""
        ends = [(np.searchsorted(p, starts) + b, np.searchsorted(p, starts + n) + b) for p, b in zip(self.places, self.base)]
        low, high = (np.stack(x, axis=1) for x in zip(*ends))
        return self.sums[high] - self.sums[low], high - low


def packed(bits: np.ndarray) -> np.ndarray:
    """uint64 of each 64 booleans along the last axis, first bit on top."""
    return np.packbits(bits, axis=-1).view(">u8")[..., 0].astype(np.uint64)


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values in order, how often each occurs)."""
    return np.unique(hashes, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low) if low else 0.0


class MultiIndex:
    """Items of one size by the blocks of their fingerprints, entered under all values of their open bits."""

    def __init__(self, items: list[np.ndarray]):
        self.blocks = max(1, round(len(items[0]) / CLASS))
        parts = [Majorities(h, self.blocks).of(np.array([0]), len(h)) for h in items]
        most, size = np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts])
        slack = np.floor(SLACK * size + 1e-9).astype(np.int64)[..., None]
        open_ = np.where(most > 0, slack >= most, slack > -most)
        self.prints, self.settled = packed(most > 0), packed(~open_)
        free = open_.reshape(*size.shape, 64 // PART, PART)
        best = free.sum(axis=-1).argmin(axis=-1)
        codes, owners = [], []
        for i, b in zip(*np.nonzero(size)):  # a block without shingles of the item says nothing
            part = int(best[i, b])
            mask = np.uint64(((1 << PART) - 1) << (64 - PART * (part + 1)))
            values = np.array([int((self.prints[i, b] & self.settled[i, b] & mask) >> np.uint64(64 - PART * (part + 1)))])
            for bit in np.flatnonzero(free[i, b, part]):
                values = np.concatenate([values, values | (1 << (PART - 1 - int(bit)))])
            codes.append(self.code(b, part, values))
            owners.append(np.full(len(values), i))
        codes, owners = np.concatenate(codes), np.concatenate(owners)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owners = codes[order], owners[order]

    @staticmethod
    def code(block: np.ndarray | int, part: np.ndarray | int, value: np.ndarray) -> np.ndarray:
        return (np.int64(block) * (64 // PART) + part) * (1 << PART) + value

    def entered(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, block) under which the index returns an item for a window's fingerprint."""
        part = np.arange(64 // PART)
        value = (prints[..., None] >> (64 - PART * (part + 1)).astype(np.uint64)) & np.uint64((1 << PART) - 1)
        code = self.code(np.arange(self.blocks)[:, None], part, value.astype(np.int64)).reshape(len(prints), -1)
        low, high = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, side="right")
        w, c = np.nonzero(high > low)
        n = (high - low)[w, c]
        at = np.repeat(low[w, c] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(w, n), self.owners[at], np.repeat(c // len(part), n)

    def lookup(self, prints: np.ndarray) -> np.ndarray:
        """Rows (window, item) whose fingerprints agree in the settled bits of a block."""
        w, i, b = self.entered(prints)
        same = ((prints[w, b] ^ self.prints[i, b]) & self.settled[i, b]) == 0
        return np.unique(np.stack([w[same], i[same]], axis=1), axis=0)


class Matcher:
    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        codes: dict[int, list[np.ndarray]] = defaultdict(list)
        sizes: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(WIDTH, len(words))
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.uint64)
            own = np.unique(self.codes(ids, np.arange(len(words) - k + 1), k))
            codes[k].append(own)
            sizes[k].append(np.full(len(own), len(words), dtype=np.int32))
            by_size[k, len(words)].append((item_id, shingle_hashes(words, k)))
        # by width: the codes in order, and the sizes of the items that hold each
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in codes:
            pairs = np.unique(np.rec.fromarrays([np.concatenate(codes[k]), np.concatenate(sizes[k])], names="code,size"))
            own, first = np.unique(pairs["code"], return_index=True)
            self.known[k] = (own, np.append(first, len(pairs)), np.ascontiguousarray(pairs["size"]))
        self.groups = {}
        for (k, n), group in by_size.items():
            self.groups[k, n] = (MultiIndex([h for _, h in group]), [(i, multiset(h)) for i, h in group])
        self.longest = max((n for _, n in self.groups), default=0)

    @staticmethod
    def codes(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        code = np.zeros(len(at), dtype=np.uint64)
        for i in range(k):
            code = (code ^ (ids[at + i] * WEIGHTS[i])) * WEIGHTS[0] + np.uint64(i)
        return code

    def part(self, words: list[str], whole_text: bool) -> Iterator[tuple[int, float, int, int]]:
        """(item_id, similarity, hamming, start) of windows that hold an item; a whole text is a window for longer items too."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        for k, (known, first, sizes) in self.known.items():
            if len(words) < k:
                continue
            whole = np.ones(len(words) - k + 1, dtype=bool)
            for i in range(k):
                whole &= ids[i : len(words) - k + 1 + i] > 0
            at = np.flatnonzero(whole)
            code = self.codes(ids, at, k)
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[place] == code
            at, place = at[hit], place[hit]
            count = first[place + 1] - first[place]
            owned = sizes[np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            at = np.repeat(at, count)
            by_length = {int(n): at[owned == n] for n in np.unique(owned)}
            for n, anchors in by_length.items():
                if len(words) < n:
                    if whole_text and (len(words) - k + 1) / (n - k + 1) >= SIMILARITY:
                        yield from self.windows(words, k, n, np.array([0]))
                    continue
                starts = np.unique(np.clip(anchors[:, None] - np.arange(n - k + 1), 0, len(words) - n))
                yield from self.windows(words, k, n, starts)

    def windows(self, words: list[str], k: int, n: int, starts: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        index, group = self.groups[k, n]
        n = min(n, len(words))
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            low, size = int(run[0]), n - k + 1
            hashes = shingle_hashes(words[low : int(run[-1]) + n], k)
            prints = packed(Majorities(hashes, index.blocks).of(run - low, size)[0] > 0)
            # windows of the same shingles in another order are compared once
            total = np.concatenate([[np.uint64(0)], np.cumsum((hashes ^ (hashes >> np.uint64(31))) * WEIGHTS[1], dtype=np.uint64)])
            same = total[run - low + size] - total[run - low]
            seen: dict[tuple[int, int], float] = {}
            for w, i in index.lookup(prints).tolist():
                key = (int(same[w]), i)
                if key not in seen:
                    seen[key] = similarity(multiset(hashes[run[w] - low : run[w] - low + size]), group[i][1])
                    if seen[key] >= SIMILARITY:
                        yield group[i][0], seen[key], int(np.bitwise_count(prints[w] ^ index.prints[i]).sum()), int(run[w])

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """The best window (most similar, then first) of each item the text holds."""
        words = words_of(text)
        best: dict[int, tuple[int, float, int, int]] = {}
        step = max(SLICE, 2 * self.longest)
        for at in range(0, max(1, len(words)), step):
            for item, like, far, s in self.part(words[at : at + step + self.longest], len(words) <= step):
                new = (item, like, far, at + s)
                if item not in best or (-new[1], new[3]) < (-best[item][1], best[item][3]):
                    best[item] = new
        return sorted(best.values())


def matchers(benchmark: DataFrame) -> Iterator[Matcher]:
    """One matcher for each block of the benchmark; a block holds about BLOCK items and BLOCK_BYTES of text at most."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_BYTES)) if n else 0
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield Matcher([tuple(r) for r in block.distinct().collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, hamming, start_word): each item a document holds.

    One row per document row and item, for its best window; clean documents give none.
    A document with fewer words than the item is compared as a whole (start_word 0).
    Words are runs of letters, digits and underscores in lower case. Items with fewer
    than five words match as their whole sequence; items without words, null items and
    null ids match nothing; null and empty texts hold nothing; different items of one id give
    one row, for the best window of any of them; repeated rows repeat; further columns, whatever their names, are
    ignored. Very long texts are read in slices that overlap by the longest item. Of
    windows equally similar to an item the first is taken. hamming counts the bits that
    differ over all blocks of the two fingerprints.
    """
    found = None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for matcher in matchers(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in bounded(it, 1):
                hits = [(d, *h) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in shared.value.find(t)]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[i] for h in hits], t) for i, t in enumerate(types)], ["doc_id", "item_id", "similarity", "hamming", "start_word"]
                )

        part = rows.mapInArrow(run, SCHEMA)
        found = part if found is None else found.union(part)
    return rows.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns kept; edge cases as in contaminated()."""
    for matcher in matchers(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in bounded(it, "text"):
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not shared.value.find(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
