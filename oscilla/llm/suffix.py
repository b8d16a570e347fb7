"""Removal of repeated 50-byte strings by induced suffix sorting (operator 3).

A 50-byte string always holds the same minimiser (the k-byte string of least hash in
it) at the same place, so equal strings meet under their minimiser wherever they
stand. Only minimisers that two different texts share are followed up: the run of
50-byte windows around such a minimiser is a segment of at most 2 * 50 - k bytes.
Equal segments are merged before they are dealt to shards by minimiser, so a passage
repeated without end is one row. A shard's suffixes are sorted by induction: types
and LMS suffixes, LMS order by their first 50 values, then the two inducing
sweeps through priority queues that carry suffix tuples and their common prefixes,
on the task's own disk beyond QUEUE_BYTES. Segments that agree with no other on the bytes beside the minimiser
that any shared 50-byte string would hold need no sorting. Neighbours whose carried prefix reaches 50 bytes form a class; its
smallest doc_id decides which windows each segment, and so each document, loses.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

LENGTH = 50
K = 20
WINDOW = LENGTH - K + 1  # k-byte strings in a 50-byte string
EDGE = 15  # half of the bytes beside the minimiser in a 50-byte string
SHARD_BYTES = 1 << 20  # segment bytes of a shard, on average
QUEUE_BYTES = 256 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id: larger than any
SLICE = 1 << 20


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros beyond the end) as one number."""
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data), 8), (1, 1))
    return np.ascontiguousarray(words).view("<u8").ravel()


def gram_hashes(w: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on; w: words_at() of at least K bytes."""
    m = len(w) - K + 1
    h = (w[:m] ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32)) ^ w[8 : 8 + m]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29)) ^ w[K - 8 : K - 8 + m]) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def minimisers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each maximal run of 50-byte windows with one minimiser.

    The leftmost of equal least hashes is taken. data: uint8, at least LENGTH long.
    """
    least, width = gram_hashes(words_at(data)), 1
    while width < WINDOW:  # doubling: minimum of `width` hashes from each place
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    run = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    counts = np.diff(np.append(run, len(least)))
    return least[run], run, counts


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """minimisers() of a text of any length, in slices; windows of a run stay together within WINDOW."""
    n = len(text) - LENGTH + 1
    if n < 1:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    data = np.frombuffer(text, dtype=np.uint8)
    parts = []
    for at in range(0, n, SLICE):
        h, s, c = minimisers(data[at : min(len(data), at + SLICE + LENGTH - 1)])
        parts.append((h, s + at, c))
    h, s, c = (np.concatenate(x) for x in zip(*parts))
    # a run of one value over more than WINDOW windows (a periodic text) is cut
    if len(c) and c.max() > WINDOW:
        reps = -(-c // WINDOW)
        off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        h, s, c = np.repeat(h, reps), np.repeat(s, reps) + off * WINDOW, np.minimum(WINDOW, np.repeat(c, reps) - off * WINDOW)
    return h, s, c


class Queues:
    """A priority queue of suffix tuples (place, common prefix with the tuple before it) by leading value.

    Tuples of one value leave in the order in which they came; what is held beyond
    QUEUE_BYTES lies on the task's disk.
    """

    def __init__(self, folder: str):
        self.parts: dict[int, list] = {}
        self.held, self.file = 0, tempfile.TemporaryFile(dir=folder)

    def push(self, c: int, x: np.ndarray, lcp: np.ndarray) -> None:
        both = np.empty((2, len(x)), dtype=np.int64)
        both[0], both[1] = x, lcp
        if self.held + both.nbytes > QUEUE_BYTES:
            at = self.file.seek(0, 2)
            self.file.write(both.tobytes())
            self.parts.setdefault(c, []).append((at, len(x)))
        else:
            self.held += both.nbytes
            self.parts.setdefault(c, []).append(both)

    def take(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of c in parts of about SLICE, those that are pushed meanwhile too."""
        while parts := self.parts.pop(c, None):
            held, size = [], 0
            for i, p in enumerate(parts):
                if isinstance(p, tuple):
                    self.file.seek(p[0])
                    p = np.frombuffer(self.file.read(16 * p[1]), dtype=np.int64).reshape(2, -1)
                else:
                    self.held -= p.nbytes
                held.append(p)
                size += p.shape[1]
                if size >= SLICE:
                    break
            if parts[i + 1 :]:
                self.parts[c] = parts[i + 1 :]
            both = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
            yield both[0], both[1]


def kept_array(n: int, dtype: type, folder: str) -> np.ndarray:
    """Zeros: in memory, or in a file of the task's own disk if longer than QUEUE_BYTES."""
    if n * np.dtype(dtype).itemsize <= QUEUE_BYTES:
        return np.zeros(n, dtype=dtype)
    with tempfile.NamedTemporaryFile(dir=folder) as f:
        return np.memmap(f, dtype=dtype, mode="w+", shape=(n,))


class Minima:
    """Least value of any range of x, by doubling."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            y, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(y[:-step], y[step:]))
        self.bits = np.zeros(len(x) + 1, dtype=np.int64)
        for k in range(1, len(self.levels)):
            self.bits[1 << k :] = k

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of x[low:high], where that is not empty."""
        k = self.bits[high - low]
        out = np.empty(len(low), dtype=np.int64)
        for level in np.unique(k).tolist():
            at, y = k == level, self.levels[level]
            out[at] = np.minimum(y[low[at]], y[high[at] - (1 << level)])
        return out


class Inducer:
    """Pushes the predecessors of suffixes that pass in order, with the common prefixes that follow from theirs."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, want_s: bool, out: Queues):
        self.text, self.s_type, self.want_s, self.out = text, s_type, want_s, out
        self.since: dict[int, int] = {}  # least common prefix since the last push of each value

    def feed(self, x: np.ndarray, lcp: np.ndarray) -> None:
        """x: suffixes in order; lcp: with the suffix before, which for the first is the last one fed."""
        for at in range(0, len(x), SLICE):
            self.part(x[at : at + SLICE], lcp[at : at + SLICE])

    def part(self, x: np.ndarray, lcp: np.ndarray) -> None:
        least = int(lcp.min()) if len(lcp) else LENGTH
        pred = np.where(x > 0, x - 1, 0)
        use = np.flatnonzero((x > 0) & (self.s_type[pred] == self.want_s))
        pushed: dict[int, int] = {}
        if len(use):
            chars = self.text[pred[use]]
            order = np.argsort(chars, kind="stable")
            at, chars = use[order], chars[order]
            new = np.concatenate([[True], chars[1:] != chars[:-1]])
            table = Minima(lcp)
            value = table.of(np.where(new, 0, np.concatenate([[0], at[:-1] + 1])), at + 1)
            firsts = np.flatnonzero(new)
            for f, c in zip(firsts.tolist(), chars[firsts].tolist()):
                value[f] = min(value[f], self.since[c]) if c in self.since else -1
            value = np.minimum(value + 1, LENGTH)  # the first of a value follows no other: 0
            ends = np.append(firsts[1:], len(at))
            for f, e, c in zip(firsts.tolist(), ends.tolist(), chars[firsts].tolist()):
                self.out.push(c, pred[at[f:e]], value[f:e])
                rest = lcp[at[e - 1] + 1 :]
                pushed[c] = int(rest.min()) if len(rest) else LENGTH
        for c in self.since:
            if self.since[c] > least:
                self.since[c] = least
        self.since.update(pushed)


def induce(text: np.ndarray, s_type: np.ndarray, run: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before) from those of the LMS suffixes.

    L-type suffixes follow from the left, then S-type ones from the right. run: how often
    the value at each place repeats from there on; where L-type and S-type suffixes of one
    value meet, the shorter of their runs is what they share.
    """
    n, ls, ends = len(text), Queues(folder), Queues(folder)
    first = text[lms]
    cuts = np.flatnonzero(np.diff(first)) + 1 if len(lms) else np.zeros(0, dtype=int)
    for part, lcp in zip(np.split(lms, cuts), np.split(lms_lcp, cuts)):
        if len(part):
            ends.push(int(text[part[0]]), part, np.concatenate([[0], lcp[1:]]))
    values = np.unique(text).tolist()
    done, left = Queues(folder), Inducer(text, s_type, False, ls)
    for c in values:
        last = -1
        for x, lcp in ls.take(c):
            left.feed(x, lcp)
            done.push(c, x, lcp)
            last = int(x[-1])
        for i, (x, lcp) in enumerate(ends.take(c)):
            if i == 0 and last >= 0:
                lcp = lcp.copy()
                lcp[0] = min(int(run[last]), int(run[x[0]]), LENGTH)
            left.feed(x, lcp)
    order, shared = kept_array(n, np.int64, folder), kept_array(n, np.int16, folder)
    ss = Queues(folder)
    right = Inducer(text, s_type, True, ss)
    top = n

    def place(x: np.ndarray, lcp: np.ndarray) -> None:
        """Suffixes from the right; lcp: with the one to the right of each."""
        nonlocal top
        right.feed(x, lcp)
        order[top - len(x) : top] = x[::-1]
        if top < n:
            shared[top] = lcp[0]
        shared[top - len(x) + 1 : top] = lcp[1:][::-1]
        top -= len(x)

    for c in reversed(values):
        last = -1
        for x, lcp in ss.take(c):
            place(x, lcp)
            last = int(x[-1])
        parts = list(done.take(c)) if c in done.parts else []
        if parts:
            x, lcp = (np.concatenate(z) for z in zip(*parts))
            to_right = np.concatenate([[min(int(run[last]), int(run[x[-1]]), LENGTH) if last >= 0 else 0], lcp[:0:-1]])
            place(x[::-1], to_right)
    place(np.array([n - 1]), np.array([0]))  # nothing follows the last value, so nothing induces it
    return order, shared


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Values that text[a:] and text[b:] share at their start, up to limit each; compared side by side."""
    out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    room = np.minimum(limit, len(text) - np.maximum(a, b))
    while len(live):
        live = live[out[live] < room[live]]
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
    return out


def suffix_order(text: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes by their first LENGTH values at least, how many of those each shares with the one before); text ends with its only least value."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ahead = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]  # the last place of each place's run
    s_type = np.zeros(n, dtype=bool)
    s_type[:-1] = text[:-1] < text[np.minimum(ahead[:-1] + 1, n - 1)]
    s_type[n - 1] = True
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms):
        lms = lms[lms_order(text, lms)]
    lcp = np.concatenate([[0], common(text, lms[1:], lms[:-1], np.full(max(0, len(lms) - 1), LENGTH))]).astype(np.int64)[: len(lms)]
    return induce(text, s_type, ahead - np.arange(n) + 1, lms, lcp, folder)


def lms_order(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of LMS suffixes by their first LENGTH values, read as big-endian strings."""
    wide = np.concatenate([text, np.zeros(LENGTH, dtype=text.dtype)]).astype(">u2")
    rows = np.lib.stride_tricks.as_strided(wide, (len(text), LENGTH), (2, 2))[lms]
    return np.argsort(np.ascontiguousarray(rows).view(f"S{2 * LENGTH}").ravel(), kind="stable")


def contested(h: np.ndarray, segs: list[bytes]) -> np.ndarray:
    """Whether each segment may share a 50-byte window with another of its minimiser; never misses one.

    Such a window holds EDGE bytes or more before the minimiser, or as many after it, so
    both segments agree there. Where a minimiser stands more than once in a segment, all
    of its segments count.
    """
    sizes = np.array([len(s) for s in segs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(segs) + b"\0", dtype=np.uint8)
    w = words_at(raw)
    own = np.repeat(np.arange(len(segs)), sizes + 1)
    at = np.flatnonzero(gram_hashes(w) == h.view(np.uint64)[own[: len(raw) - K + 1]])
    at = at[at + K <= (starts + sizes)[own[at]]]
    times = np.bincount(own[at], minlength=len(segs))
    odd = np.isin(h, h[times != 1])
    keep = odd & (pd.Series(h).duplicated(keep=False).to_numpy())
    at = at[~odd[own[at]]]
    for inside, first in ((at - starts[own[at]] >= EDGE, at - EDGE), (at + K + EDGE <= (starts + sizes)[own[at]], at + K)):
        who, x = own[at[inside]], first[inside]
        near = (w[x] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[x + EDGE - 8] * np.uint64(0xC2B2AE3D27D4EB4F))
        key = (near ^ (near >> np.uint64(32))) * np.uint64(0x165667B19E3779F9) ^ h[who].view(np.uint64)
        keep[who[pd.Series(key).duplicated(keep=False).to_numpy()]] = True
    return keep


def least_owners(segs: list[bytes], least: np.ndarray, folder: str) -> list[np.ndarray]:
    """For each segment, the smallest owner of each of its 50-byte windows among all segments."""
    sizes = np.array([len(s) for s in segs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = kept_array(int((sizes + 1).sum()) + 1, np.int16, folder)
    text[:-1] = np.frombuffer(b"\0".join(segs) + b"\0", dtype=np.uint8)
    text[:-1] += 2
    text[starts + sizes] = 1  # separators; the end is less than all
    order, shared = suffix_order(text, folder)
    seg = np.repeat(np.arange(len(segs), dtype=np.int32), sizes + 1)
    room = np.append(np.repeat(starts + sizes, sizes + 1) - np.arange(len(text) - 1), 0)
    # suffixes that share LENGTH values are one class; a class whose values reach a separator is no window
    whole = room[order] >= LENGTH
    new = shared < LENGTH
    new[1:] |= whole[1:] != whole[:-1]
    order, new = order[whole], new[whole]
    owner = np.full(len(text), LAST)
    if len(order):
        new[0] = True
        first = np.flatnonzero(new)
        best = np.minimum.reduceat(least[seg[order]], first)
        owner[order] = np.repeat(best, np.diff(np.append(first, len(order))))
    return [owner[a : a + k - LENGTH + 1] for a, k in zip(starts, sizes)]


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def occurrences(docs: DataFrame, distinct: bool) -> DataFrame:
    """Minimiser runs: (h, content) once a document if distinct, else (h, key, content, s, c)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            size = 0
            for key, content, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, s, c = runs(_utf8(text))
                if distinct:
                    h = np.unique(h)
                for col, x in zip(cols, (h.view(np.int64), np.full(len(h), key), np.full(len(h), content), s, c)):
                    col.append(x)
                size += len(h)
                if size > 200_000:
                    yield from flush(cols)
                    cols, size = [[] for _ in range(5)], 0
            if size:
                yield from flush(cols)

    def flush(cols: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, use = (["h", "content"], (0, 2)) if distinct else (["h", "key", "content", "s", "c"], (0, 1, 2, 3, 4))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[i]).astype(np.int64)) for i in use], names)

    return docs.mapInArrow(run, "h long, content long" if distinct else "h long, key long, content long, s long, c long")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key")
    return docs.select(key, F.xxhash64(text).alias("content"), text.alias("text"))


def same_text() -> list[Column]:
    """What equal texts agree in: 128 further bits and the length, besides the 64 bits of content."""
    return [F.unhex(F.md5("text")).alias("sum"), F.octet_length("text").alias("size")]


def repeats(docs: DataFrame) -> DataFrame:
    """(key, content, s, bits): bit i says that the window at s + i also starts in a smaller document."""
    rows = keyed(docs)
    shared = occurrences(rows, True).groupBy("h").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    shared = materialize(shared.where("a <> b").select("h"), "shared")
    hits = materialize(occurrences(rows, False).join(shared, "h"), "hits", compression="zstd")
    wanted = materialize(hits.groupBy("key", "content").agg(F.collect_list(F.struct("h", "s", "c")).alias("at")), "wanted", compression="zstd")
    discard(shared)
    discard(hits)
    # one of several rows with one id and text is enough
    segs = rows.join(wanted, ["key", "content"]).select("key", "content", "text", F.explode("at").alias("x"))
    blob = F.encode("text", "UTF-8")
    segs = segs.select("key", "content", F.col("x.h").alias("h"), F.col("x.s").alias("s"), F.substring(blob, (F.col("x.s") + 1).cast("int"), (F.col("x.c") + (LENGTH - 1)).cast("int")).alias("seg"))
    segs = materialize(segs, "segments", compression="zstd")
    discard(wanted)
    owned = segs.groupBy("h", "seg").agg(F.min("key").alias("least"), (F.max("key") > F.min("key")).alias("many"))
    owned = materialize(owned, "owned", compression="zstd")
    total = owned.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    shards = max(1, round(total / SHARD_BYTES))

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        """Segments that lose bytes somewhere; mins is null where the segment's own least document owns all windows."""
        segs, least, many = group.seg.tolist(), group.least.to_numpy(), group.many.to_numpy()
        mins: list[np.ndarray | None] = [None] * len(segs)
        if len(at := np.flatnonzero(contested(group.h.to_numpy(), segs))):
            with tempfile.TemporaryDirectory() as folder:
                for i, found in zip(at, least_owners([segs[i] for i in at], least[at], folder)):
                    if found.min() < least[i]:
                        mins[i] = found
        some = many | np.array([m is not None for m in mins], dtype=bool)
        out = group.loc[some, ["h", "seg", "least"]]
        return out.assign(mins=[m for m, use in zip(mins, some) if use])

    dealt = owned.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    sorted_ = dealt.groupBy("shard").applyInPandas(sort, "h long, seg binary, least long, mins array<long>")
    sorted_ = materialize(sorted_, "sorted", compression="zstd")
    discard(owned)
    pair = segs.join(sorted_, ["h", "seg"]).where((F.col("least") < F.col("key")) | F.col("mins").isNotNull())
    each = F.expr("aggregate(transform(mins, (x, i) -> if(x < key, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    every = F.expr(f"shiftleft(1L, octet_length(seg) - {LENGTH - 1}) - 1L")  # a segment has at most WINDOW windows
    return pair.select("key", "content", "s", F.coalesce(each, every).alias("bits")).where("bits <> 0")


def kept(text: str | None, s: np.ndarray, bits: np.ndarray, copy: bool) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 of a text; windows s + i with bit i set repeat; a copy loses all."""
    data = _utf8(text)
    n = len(data)
    if copy and n >= LENGTH:
        return n, n, 1, hashlib.sha256(b"").hexdigest()
    if copy or not len(s):
        return n, 0, 0, hashlib.sha256(data).hexdigest()
    row, i = np.nonzero(bits[:, None] >> np.arange(WINDOW) & 1)
    first = np.zeros(n + 1, dtype=np.int32)
    first[s[row] + i] = 1  # each window stands in one run
    first[LENGTH:] -= first[:-LENGTH].copy()
    gone = np.cumsum(first[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return n, int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller
    doc_id. Texts shorter than 50 bytes, null and empty ones lose nothing; rows of one
    doc_id do not count against each other; null doc_ids rank after all others and not
    against each other; texts of any length are read whole, in slices; further columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    rows = keyed(docs)
    marked, same = rows.select("key", "content", *same_text()), ["content", "sum", "size"]
    firsts = marked.groupBy(*same).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, "first")
    firsts = materialize(firsts, "firsts")
    lists = repeats(docs).groupBy("key", "content").agg(F.collect_list(F.struct("s", "bits")).alias("at"))
    lists = materialize(lists, "lists")
    copies = marked.join(firsts, same).where(F.col("first") < F.col("key")).select("key", "content").distinct()
    marks = materialize(copies.withColumn("copy", F.lit(True)).join(lists, ["key", "content"], "full"), "marks")
    # of a copy nothing but the fact is needed
    marks = marks.select("key", "content", F.coalesce("copy", F.lit(False)).alias("copy"), F.when(F.col("copy").isNull(), F.col("at")).alias("at"))
    full = rows.join(marks, ["key", "content"], "left").select("key", "text", "copy", "at")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, texts, copy = (b.column(i).to_pylist() for i in range(3))
            at = b.column(3)
            flat = at.flatten()
            s, bits = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "bits"))
            ends = np.cumsum(pc.list_value_length(at).fill_null(0).to_numpy(zero_copy_only=False))
            begins = np.concatenate([[0], ends[:-1]])
            found = [kept(t, s[x:y], bits[x:y], bool(c)) for t, c, x, y in zip(texts, copy, begins, ends)]
            cols = [[None if k == LAST else k for k in keys], *([f[i] for f in found] for i in range(4))]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return full.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
