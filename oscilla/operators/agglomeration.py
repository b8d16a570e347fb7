"""Agglomeration of unit vectors without sign: the two most alike clusters merge until k are left.

Likeness is the absolute cosine of two clusters' centres; of equal pairs the one with the first
member, then the one with the first partner, merges first. Clusters stay rows (id, size, x): id is
the place of the first member, x the sum of the members, with signs of their merges. A phase takes
the most alike pairs of all clusters (products of blocks with blocks, in tasks), and the driver
follows the merges among them. Clusters made on the way are compared with all rows, in tasks too,
unless a bound shows that none of them can be among the next merges; then the phase is followed
anew with what was found, until nothing is left to compare. So each phase ends in the very merges
of the plain iteration, and the driver holds the pairs of one phase and the clusters in them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import checkpointed

FINAL = 8192  # clusters that the driver merges by itself
PAIRS = 16384  # pairs of a phase, at most
FOUND = 8 * PAIRS  # rows of one comparison that the driver takes, at most; more raise the floor of the phase
BLOCK = 16384  # clusters of a block, at most
LEAST_BLOCKS = 6
PROBES = 1024  # clusters whose neighbours tell the floor of a phase
TASK_ROWS = 2048
DEPTH = 3  # generations of uncompared clusters that are compared together
CELLS = 1 << 22  # numbers of one product


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=-1, keepdims=True)), 1e-10)


def merge_all(sums: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Centres of k clusters, by the plain iteration in memory; each cluster keeps its best later partner."""
    n = len(sums)
    sums, sizes, centres = sums.copy(), sizes.copy(), unit(sums / sizes[:, None])
    alive = np.ones(n, dtype=bool)
    best, mate = np.full(n, -1.0), np.zeros(n, dtype=np.int64)

    def seek(i: int) -> None:
        row = np.abs(centres[i + 1 :] @ centres[i])
        row[~alive[i + 1 :]] = -1
        at = int(row.argmax()) if len(row) else 0
        best[i], mate[i] = (row[at], i + 1 + at) if len(row) else (-1, 0)

    for i in range(n):
        seek(i)
    for _ in range(n - k):
        i = int(best.argmax())
        j = int(mate[i])
        sums[i] += sums[j] * (-1 if centres[i] @ centres[j] < 0 else 1)
        sizes[i] += sizes[j]
        alive[j], best[j] = False, -1
        centres[i] = unit(sums[i] / sizes[i])
        lost = np.flatnonzero(alive & ((mate == i) | (mate == j)) & (best >= 0))
        now = np.abs(centres[:i] @ centres[i])
        better = np.flatnonzero(alive[:i] & ((now > best[:i]) | ((now == best[:i]) & (i < mate[:i]))))
        best[better], mate[better] = now[better], i
        for r in {i, *lost.tolist()}:
            seek(r)
    return centres[alive]


def _matrix(t: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    column = t[name].combine_chunks() if isinstance(t, pa.Table) else t[name]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centres(t: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    return unit(_matrix(t, "x", width) / t["size"].to_numpy()[:, None])


class _First:
    """The first `most` of pairs (sim, lo, hi, …) by falling sim, then lo, then hi."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.held = most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > 2 * self.most:
            self.parts = [self.columns()]
            self.held = len(self.parts[0][0])

    def columns(self) -> tuple[np.ndarray, ...]:
        got = tuple(np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((got[2], got[1], -got[0]))[: self.most]
        return tuple(c[order] for c in got)


def _first_rows(pairs: DataFrame, most: int) -> dict[str, np.ndarray]:
    got = pairs.orderBy(F.desc("sim"), "lo", "hi").limit(most).toArrow()
    return {c: got[c].to_numpy() for c in got.column_names}


def alike(clusters: DataFrame, n: int, width: int, floor: float, most: int) -> DataFrame:
    """(sim, lo, hi): pairs of at least the floor; of each two blocks the first `most`."""
    blocks = max(-(-n // BLOCK), LEAST_BLOCKS)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = clusters.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    dealt = dealt.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "size", "x")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        a, b = (v.as_py() for v in key)
        block, ids, x = t["own"].to_numpy(), t["id"].to_numpy(), _centres(t, width)
        left, right = block == a, block == b
        first = _First(most)
        first.add(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        lid, rid, lx, rx = ids[left], ids[right], x[left], np.ascontiguousarray(x[right].T)
        step = max(1, CELLS // max(1, len(rid)))
        for i in range(0, len(lid), step):
            p = lx[i : i + step] @ rx
            np.abs(p, out=p)
            r, c = np.divmod(np.flatnonzero(p.ravel() >= floor), max(1, len(rid)))
            if a == b:
                once = lid[i + r] < rid[c]
                r, c = r[once], c[once]
            first.add(p[r, c], np.minimum(lid[i + r], rid[c]), np.maximum(lid[i + r], rid[c]))
        return pa.table(dict(zip(("sim", "lo", "hi"), first.columns())))

    groups = blocks * (blocks + 1) // 2
    return dealt.repartition(groups, "a", "b").groupBy("a", "b").applyInArrow(run, "sim double, lo long, hi long")


def mates(clusters: DataFrame, width: int, made: np.ndarray, firsts: np.ndarray, floor: float, most: int) -> DataFrame:
    """(sim, lo, hi, made, id): rows at least as like a made cluster as the floor; of each task the first `most`.

    `made` are centres of a phase's clusters, `firsts` the places of their first members.
    """
    across = np.ascontiguousarray(made.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First(most)
        first.add(np.empty(0), *(np.empty(0, np.int64) for _ in range(4)))
        step = max(1, CELLS // len(firsts))
        for b in batches:
            ids, x = b["id"].to_numpy(), _centres(b, width)
            for i in range(0, len(ids), step):
                p = x[i : i + step] @ across
                np.abs(p, out=p)
                r, c = np.divmod(np.flatnonzero(p.ravel() >= floor), len(firsts))
                at = ids[i + r]
                first.add(p[r, c], np.minimum(at, firsts[c]), np.maximum(at, firsts[c]), c, at)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in first.columns()], ["sim", "lo", "hi", "made", "id"])

    return clusters.mapInArrow(run, "sim double, lo long, hi long, made long, id long")


def _floor(clusters: DataFrame, n: int, width: int, wanted: int) -> float:
    """A likeness that about as many pairs as wanted reach, judged by the neighbours of some clusters."""
    probes = clusters.orderBy(F.xxhash64("id")).limit(PROBES).toArrow()
    ids, across = probes["id"].to_numpy(), np.ascontiguousarray(_centres(probes, width).T)
    most = max(1, 2 * wanted * len(ids) // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.empty(0)
        step = max(1, CELLS // len(ids))
        for b in batches:
            own, x = b["id"].to_numpy(), _centres(b, width)
            for i in range(0, len(own), step):
                p = np.abs(x[i : i + step] @ across)
                p[own[i : i + step, None] == ids] = -1
                top = np.concatenate([top, p[p >= (top[0] if len(top) == most else 0)]])
                top = np.sort(top)[-most:]
        yield pa.RecordBatch.from_arrays([pa.array(top)], ["sim"])

    got = clusters.mapInArrow(run, "sim double").orderBy(F.desc("sim")).limit(most).toArrow()["sim"].to_numpy()
    if not len(got):
        raise ValueError("topographies hold numbers that cannot be compared")
    return float(got[-1])


class Phase:
    """The merges down to a floor, as far as the known pairs decide them.

    Nodes are rows and clusters made of them; kin are the rows known to be alike to a node. Of a
    row or a compared node all rows from the floor up are kin. A node made of p and q is no more
    like any other row than its parents' bounds allow, weighed by the lengths of their sums.
    """

    def __init__(self, width: int, floor: float) -> None:
        self.floor: tuple = (-floor, np.inf, np.inf)
        self.sums, self.centres = np.empty((1024, width)), np.empty((1024, width))
        self.first: list[int] = []
        self.size: list[float] = []
        self.length: list[float] = []
        self.parents: list[tuple[int, int] | None] = []
        self.kin: list[np.ndarray] = []
        self.queue: list[list[tuple]] = []
        self.version: list[int] = []
        self.basis: list[tuple | None] = []
        self.compared: list[bool] = []
        self.row: dict[int, int] = {}
        self.memo: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.beside = np.empty((1024, width))  # centres of the made nodes
        self.others: dict[int, list[tuple]] = {}  # pairs of a made node with nodes made before
        self.later: dict[int, list[tuple]] = {}  # and with nodes made after it
        self.start: list[tuple] = []

    def _add(self, first: int, size: float, total: np.ndarray, parents: tuple[int, int] | None) -> int:
        m = len(self.first)
        if m == len(self.sums):
            self.sums, self.centres = (np.concatenate([a, np.empty_like(a)]) for a in (self.sums, self.centres))
        self.sums[m], self.centres[m] = total, unit(total / size)
        self.first.append(first)
        self.size.append(size)
        self.length.append(float(np.sqrt(total @ total)))
        self.parents.append(parents)
        self.kin.append(np.empty(0, np.int64))
        self.queue.append([])
        self.version.append(0)
        self.basis.append(None)
        self.compared.append(parents is None)
        return m

    def hold(self, rows: pa.Table, width: int) -> None:
        for i, size, total in zip(rows["id"].to_pylist(), rows["size"].to_pylist(), _matrix(rows, "x", width)):
            self.row[i] = self._add(i, size, total, None)

    def begin(self, sim: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        kin: dict[int, list[int]] = {}
        for s, i, j in zip(sim.tolist(), lo.tolist(), hi.tolist()):
            p, q = self.row[i], self.row[j]
            self.start.append((-s, i, j, p, q, -1))
            kin.setdefault(p, []).append(q)
            kin.setdefault(q, []).append(p)
        for p, found in kin.items():
            self.kin[p] = np.array(found)

    def _pair(self, sim: float, m: int, o: int) -> tuple:
        i, j = self.first[m], self.first[o]
        return (-sim, i, j, o) if i < j else (-sim, j, i, o)

    def _node(self, p: int, q: int, inside: np.ndarray, key: int) -> int:
        m = self.memo.get((p, q))
        if m is None:
            sign = -1 if self.centres[p] @ self.centres[q] < 0 else 1
            m = self._add(self.first[p], self.size[p] + self.size[q], self.sums[p] + self.sums[q] * sign, (p, q))
            self.memo[p, q] = m
            n = len(self.made)
            sims = np.abs(self.beside[:n] @ self.centres[m])
            near = np.flatnonzero((sims >= -self.floor[0]) & (inside != key))
            self.others[m] = []
            for at, s in zip(near.tolist(), sims[near].tolist()):
                v = self.made[at]
                e = self._pair(s, m, v)
                self.others[m].append(e)
                self.later.setdefault(v, []).append((*e[:3], m))
            if n == len(self.beside):
                self.beside = np.concatenate([self.beside, np.empty_like(self.beside)])
            self.beside[n] = self.centres[m]
            self.made.append(m)
        basis = None if self.compared[m] else (self.version[p], self.version[q])
        if basis != self.basis[m]:
            self.basis[m] = basis
            self._list(m, np.union1d(self.kin[p], self.kin[q]))
        return m

    def _list(self, m: int, rows: np.ndarray) -> None:
        sims = np.abs(self.centres[rows] @ self.centres[m])
        near = sims >= -self.floor[0]
        self.kin[m] = rows[near]
        self.version[m] += 1
        self.queue[m] = sorted([self._pair(s, m, o) for o, s in zip(rows[near].tolist(), sims[near].tolist())] + self.others[m])

    def compare(self, m: int, ids: list[int]) -> None:
        self.compared[m], self.basis[m] = True, None
        self._list(m, np.array([self.row[i] for i in ids], dtype=np.int64))

    def follow(self, room: int) -> tuple[list[int], set[int], list[int]]:
        """(made nodes in order, merged nodes, nodes to be compared first); final if the last are none."""
        heap = list(self.start)
        heapq.heapify(heap)
        merged: set[int] = set()
        trace: list[int] = []
        present: set[int] = set()
        bound: dict[int, float] = {}
        weak: list[tuple[float, int]] = []
        asked: dict[int, int] = {}
        place: dict[int, int] = {}
        inside = np.array([self.first[m] for m in self.made], dtype=np.int64)  # the cluster now holding a made node's first member
        inside = np.concatenate([inside, np.empty(room + 1, np.int64)])
        known = len(self.made)

        def ask(m: int) -> None:
            asked[m] = 1 + max(asked.get(p, 0) for p in self.parents[m])

        def push(m: int) -> None:
            queue, at = self.queue[m], place[m]
            while at < len(queue) and (queue[at][3] in merged or (self.parents[queue[at][3]] and queue[at][3] not in present)):
                at += 1
            if at < len(queue):
                e = queue[at]
                heapq.heappush(heap, (*e[:3], m, e[3], m))
            place[m] = at + 1

        while heap and len(trace) < room:
            e = heap[0]
            s, _, _, p, q, owner = e
            if p in merged or q in merged:
                heapq.heappop(heap)
                if owner >= 0 and owner not in merged:
                    push(owner)
                continue
            if trace and e[:3] > self.floor:
                break
            while weak and (weak[0][1] in merged or weak[0][0] <= s * (1 - 1e-9)):
                _, m = heapq.heappop(weak)
                if m not in merged:
                    ask(m)
            heapq.heappop(heap)
            if self.first[p] > self.first[q]:
                p, q = q, p
            merged.update((p, q))
            keys = [-v - 1 if self.parents[v] else self.first[v] for v in (p, q)]
            m = self.memo.get((p, q), len(self.first))
            now = inside[:known]
            now[(now == keys[0]) | (now == keys[1])] = -m - 1
            m = self._node(p, q, now, -m - 1)
            if len(self.made) > known:
                inside[known], known = -m - 1, known + 1
            trace.append(m)
            present.add(m)
            place[m] = 0
            push(m)
            for e in self.later.get(m, ()):
                if e[3] in present and e[3] not in merged:
                    heapq.heappush(heap, (*e[:3], m, e[3], -1))
            least = -self.floor[0]
            bound[m] = least
            if not self.compared[m]:
                bound[m] = sum(self.length[v] * bound.get(v, least) for v in (p, q)) / max(self.length[m], 1e-300)
                heapq.heappush(weak, (-bound[m], m))
        if len(trace) < room:
            for _, m in weak:
                if m not in merged:
                    ask(m)
        return trace, merged, [m for m, depth in asked.items() if depth <= DEPTH]


def _phase(clusters: DataFrame, n: int, width: int, room: int) -> tuple[list[int], list[tuple[int, float, np.ndarray]], int]:
    """(ids of merged rows, rows made of them, merges)."""
    spark = clusters.sparkSession

    def fetch(ids: np.ndarray) -> pa.Table:
        return clusters.join(F.broadcast(spark.createDataFrame(pa.table({"id": ids}))), "id").select("id", "size", "x").toArrow()

    wanted = min(PAIRS, max(1, n // 4))
    floor = _floor(clusters, n, width, wanted)
    phase = Phase(width, floor)
    got = _first_rows(alike(clusters, n, width, floor, 2 * wanted), 2 * wanted)
    if not len(got["sim"]):
        raise ValueError("topographies hold numbers that cannot be compared")
    if len(got["sim"]) == 2 * wanted:
        phase.floor = (-got["sim"][-1], got["lo"][-1], got["hi"][-1])
    phase.hold(fetch(np.union1d(got["lo"], got["hi"])), width)
    phase.begin(got["sim"], got["lo"], got["hi"])
    while True:
        trace, merged, asked = phase.follow(min(room, PAIRS))
        if not asked:
            break
        firsts = np.array([phase.first[m] for m in asked])
        got = _first_rows(mates(clusters, width, phase.centres[asked], firsts, -phase.floor[0], FOUND), FOUND)
        if len(got["sim"]) == FOUND:
            phase.floor = min(phase.floor, (-got["sim"][-1], got["lo"][-1], got["hi"][-1]))
        new = np.array([i for i in np.unique(got["id"]).tolist() if i not in phase.row], dtype=np.int64)
        if len(new):
            phase.hold(fetch(new), width)
        order = np.argsort(got["made"], kind="stable")
        ids, ends = got["id"][order], np.searchsorted(got["made"][order], np.arange(len(asked) + 1))
        for j, m in enumerate(asked):
            phase.compare(m, ids[ends[j] : ends[j + 1]].tolist())
    made = [(phase.first[m], phase.size[m], phase.sums[m]) for m in trace if m not in merged]
    return [phase.first[m] for m in merged if phase.parents[m] is None], made, len(trace)


def merge(clusters: DataFrame, k: int) -> np.ndarray:
    """Centres of k clusters, in the order of their first members, from checkpointed clusters (id, size, x)."""
    head, n = clusters.first(), clusters.count()
    width = len(head["x"])
    spark = clusters.sparkSession
    while n > max(FINAL, k):
        merged, made, merges = _phase(clusters, n, width, n - k)
        n -= merges
        x = pa.array([total.tolist() for _, _, total in made], pa.list_(pa.float64()))
        new = spark.createDataFrame(pa.table({"id": pa.array([m[0] for m in made], pa.int64()), "size": pa.array([m[1] for m in made], pa.float64()), "x": x}))
        gone = spark.createDataFrame(pa.table({"id": pa.array(merged, pa.int64())}))
        clusters = checkpointed(clusters.join(F.broadcast(gone), "id", "left_anti").select("id", "size", "x").unionByName(new).repartition(n // TASK_ROWS + 1))
    rest = clusters.orderBy("id").toArrow()
    return merge_all(_matrix(rest, "x", width), rest["size"].to_numpy(), k)
