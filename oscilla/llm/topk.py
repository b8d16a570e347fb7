"""Exact top-k inner-product search by ball-tree branch and bound (operator 5).

A coarse tree, fitted on a bounded sample, sends each vector to a cell; cells that hold
more than SHARD rows are cut by a hash. Each such shard builds one ball tree, which is
kept as a row. A node at centre c with radius r bounds a query's score by q.c + |q| r;
the queries of a block go down a tree together, nodes in order of that bound, and each
leaves out the nodes whose bound is below its current k-th score. Queries first search
one shard of the cell whose centre they agree with most; the k-th score found there is
shared: only shards whose own bound reaches it are visited at all. Queries are the
stated set (ids divisible by `every`) and meet a shard in blocks of bounded size; per
query and shard at most k rows come back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read_table

SHARD = 8192  # candidates a shard holds on average
CELLS = 4096  # leaves of the coarse tree at most: what is broadcast
SAMPLE_BYTES = 16 << 20  # of vectors that the coarse tree is fitted on
QUERIES = 2048  # queries a block holds on average
LEAF = 128
LONG = 1 << 63
OUT = "qkey long, query_id long, vec_id long, score long"
ROUTES = "qkey long, query_id long, x array<double>, floor double, cell int, sub int, block int"


def usable(vectors: DataFrame) -> DataFrame:
    """(key, vec_id, x array<double>, n): one row per row whose id is there and whose components are finite numbers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(x) > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.when(x.isNotNull(), fine).otherwise(False))
    return rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "x", F.size("x").alias("n"))


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(64 x) as doubles, which is exact where it is finite."""
    with np.errstate(over="ignore"):
        return np.floor(x * 64.0)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(64 x) as Python integers of any size."""
    return np.array([[int(e) * 64 if np.isinf(e * 64.0) else int(np.floor(e * 64.0)) for e in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def spread(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances from a centre; those too large for doubles are infinite."""
    far = np.sqrt(((v - centre) ** 2).sum(axis=1))
    return np.where(np.isnan(far), np.inf, far)


def halves(v: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction of most spread, place of each row along it)."""
    far = v[spread(v, centre).argmax()]
    line = far - v[spread(v, far).argmax()]
    return line, np.nan_to_num(v @ line)


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bound of each query's score in each ball, with room for rounding; infinite where doubles overflow."""
    with np.errstate(all="ignore"):
        norm, size = np.sqrt((q**2).sum(axis=1))[:, None], np.sqrt((centres**2).sum(axis=1))[None]
        dots = q @ centres.T
        out = dots + norm * radii[None] + 1e-9 * (np.abs(dots) + norm * (radii[None] + size)) + 1e-6
    return np.where(np.isnan(out), np.inf, out)


class Cells:
    """Coarse tree over a sample: sends vectors to at most `count` cells."""

    def __init__(self, x: np.ndarray, count: int):
        self.lines: list[tuple[np.ndarray, float, int, int] | None] = []
        self.cells: dict[int, int] = {}
        centres = []
        v = quantised(x)
        todo = [(v, count, -1, 0)]
        with np.errstate(all="ignore"):
            while todo:
                own, n, up, side = todo.pop()
                at = len(self.lines)
                if up >= 0:
                    line, cut, a, b = self.lines[up]
                    self.lines[up] = (line, cut, at, b) if side == 0 else (line, cut, a, at)
                self.lines.append(None)
                centre = own.mean(axis=0) if len(own) else np.zeros(v.shape[1])
                if n > 1 and len(own) > 1 and spread(own, centre).max() > 0:
                    line, place = halves(own, centre)
                    cut = float(np.median(place))
                    right = place >= cut
                    if right.any() and not right.all():
                        self.lines[at] = (line, cut, -1, -1)
                        todo += [(own[~right], n // 2, at, 0), (own[right], n - n // 2, at, 1)]
                        continue
                self.cells[at] = len(centres)
                centres.append(centre)
        self.centres = np.array(centres)

    def route(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), dtype=np.int32)
        todo = [(0, np.arange(len(v)))]
        with np.errstate(all="ignore"):
            while todo:
                at, rows = todo.pop()
                if not len(rows):
                    continue
                if self.lines[at] is None:
                    out[rows] = self.cells[at]
                    continue
                line, cut, a, b = self.lines[at]
                right = np.nan_to_num(v[rows] @ line) >= cut
                todo += [(a, rows[~right]), (b, rows[right])]
        return out


class BallTree:
    """Nodes over runs of the rows (key, vec_id, x), which are ordered by leaf; split at the median of the direction of most spread."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray):
        v = quantised(x)
        order, self.runs, self.kids, centres, radii = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        with np.errstate(all="ignore"):
            while todo:
                low, high, up, side = todo.pop()
                at, rows = len(self.runs), order[low:high]
                if up >= 0:
                    a, b = self.kids[up]
                    self.kids[up] = (at, b) if side == 0 else (a, at)
                centre = v[rows].mean(axis=0)
                radius = spread(v[rows], centre).max()
                self.runs.append((low, high))
                self.kids.append(None)
                centres.append(centre)
                radii.append(radius)
                if high - low > LEAF and radius > 0:
                    half = np.argsort(halves(v[rows], centre)[1], kind="stable")
                    order[low:high] = rows[half]
                    mid = (low + high) // 2
                    todo += [(low, mid, at, 0), (mid, high, at, 1)]
                    self.kids[at] = (-1, -1)
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.keys, self.ids, self.x = keys[order], ids[order], x[order]

    def scores(self, q: np.ndarray, low: int, high: int) -> np.ndarray:
        """Exact inner products (query, row) of a run: int64, or Python integers where those might not hold them."""
        x = self.x[low:high]
        a, b = quantised(q), quantised(x)
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * q.shape[1]
        if most < 2.0**53:
            return (a @ b.T).astype(np.int64)  # exact in doubles
        if most < 2.0**62:
            return a.astype(np.int64) @ b.astype(np.int64).T
        return integers(q) @ integers(x).T

    def search(self, keys: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of each query's k best, ties to the smaller id, never its own row.

        q holds the queries' components, floor a score that k rows elsewhere reach. The
        queries go down the tree together; a node is entered for those whose bound still
        reaches their k-th score.
        """
        bound = bounds(quantised(q), self.centres, self.radii)
        best = np.tile(floor[:, None], (1, k))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [0]
        while stack:
            at = stack.pop()
            live = np.flatnonzero(bound[:, at] >= best[:, 0])
            if not len(live):
                continue
            if self.kids[at]:
                stack += sorted(self.kids[at], key=lambda c: float(np.clip(bound[live, c], -1e300, 1e300).mean()))  # the larger bound is taken first
                continue
            low, high = self.runs[at]
            s = self.scores(q[live], low, high)
            # rounding keeps order, so no row is lost by comparing doubles
            near = np.clip(s, -(10**300), 10**300).astype(np.float64) if s.dtype == object else s.astype(np.float64)
            use = (near >= best[live, :1]) & (self.keys[low:high][None] != keys[live][:, None])
            i, j = np.nonzero(use)
            if len(i):
                found.append((live[i], self.ids[low + j], s[i, j]))
                hit = np.unique(i)
                own = np.where(use[hit], near[hit], -np.inf)
                best[live[hit]] = np.sort(np.partition(np.concatenate([best[live[hit]], own], axis=1), -k, axis=1)[:, -k:], axis=1)
        if not found:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        i, v, s = (np.concatenate(x) for x in zip(*found))
        if s.dtype == object:
            order = np.array(sorted(range(len(i)), key=lambda r: (i[r], -s[r], v[r])), dtype=np.int64)
        else:
            keep = s >= best[i, 0]
            i, v, s = i[keep], v[keep], s[keep]
            order = np.lexsort((v, -s, i))
        i, v, s = i[order], v[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], v[keep], s[keep]


def longs(score: np.ndarray) -> pa.Array:
    """Scores as longs. One above all longs is an error, since it is among the best; one below them is null."""
    if score.dtype != object:
        return pa.array(score)
    if any(x >= LONG for x in score.tolist()):
        raise OverflowError("a score does not fit a long")
    return pa.array([int(x) if x >= -LONG else None for x in score.tolist()], pa.int64())


def build(rows: DataFrame) -> DataFrame:
    """(cell, sub, tree): the ball tree of each shard (key, vec_id, x, n, cell, sub)."""

    def run(t: pa.Table) -> pa.Table:
        tree = BallTree(t["key"].to_numpy(), t["vec_id"].to_numpy(), matrix(t["x"], t["n"][0].as_py()))
        return pa.table({"cell": t["cell"][:1], "sub": t["sub"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return rows.select("key", "vec_id", "x", "n", "cell", "sub").groupBy("cell", "sub").applyInArrow(run, "cell int, sub int, tree binary")


def visit(routes: DataFrame, trees: DataFrame, k: int, n: int) -> DataFrame:
    """Best k rows of each query in each shard that it is routed to."""
    wanted = routes.select("cell", "sub", F.col("block").alias("tb")).distinct()
    held = trees.join(wanted, ["cell", "sub"]).select(F.col("cell").alias("tc"), F.col("sub").alias("ts"), "tb", "tree")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("qkey", "query_id", "vec_id", "score")})
        tree = pickle.loads(right["tree"][0].as_py())
        keys, ids = left["qkey"].to_numpy(), left["query_id"].to_numpy()
        i, v, s = tree.search(keys, matrix(left["x"], n), k, left["floor"].to_numpy())
        return pa.table({"qkey": keys[i], "query_id": ids[i], "vec_id": v, "score": longs(s)})

    return routes.groupBy("cell", "sub", "block").cogroup(held.groupBy("tc", "ts", "tb")).applyInArrow(run, OUT)


def routed(queries: DataFrame, cells: Cells, subs: np.ndarray, radii: np.ndarray, n: int, blocks: int, first: bool) -> DataFrame:
    """ROUTES of queries (key, vec_id, x, floor): to one shard of the best cell if first, else to all others whose bound reaches the floor."""
    shared = queries.sparkSession.sparkContext.broadcast((cells, subs, radii))  # at most CELLS centres

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, subs, radii = shared.value
        for b in it:
            for part in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
                q, floor = quantised(matrix(part.column(2), n)), part.column(3).to_numpy()
                with np.errstate(all="ignore"):
                    home = np.nan_to_num(np.where(subs > 0, q @ cells.centres.T, -np.inf), nan=0.0).argmax(axis=1)
                if first:
                    i, cell, sub = np.arange(len(q)), home, np.zeros(len(q), dtype=np.int64)
                else:
                    i, c = np.nonzero((bounds(q, cells.centres, radii) >= floor[:, None]) & (subs > 0))
                    m = subs[c]
                    sub = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    i, cell = np.repeat(i, m), np.repeat(c, m)
                    other = (cell != home[i]) | (sub > 0)
                    i, cell, sub = i[other], cell[other], sub[other]
                take = part.take(pa.array(i))
                block = (take.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
                cols = [take.column(c) for c in range(4)] + [pa.array(np.asarray(x).astype(np.int32)) for x in (cell, sub, block)]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in ROUTES.split(", ")])

    return queries.select(F.col("key").alias("qkey"), F.col("vec_id").alias("query_id"), "x", "floor").mapInArrow(run, ROUTES)


def search(rows: DataFrame, n: int, total: int, k: int, every: int) -> DataFrame:
    """OUT of the queries among rows (key, vec_id, x, n) of n components."""
    bound = max(2, SAMPLE_BYTES // (8 * n))
    drawn = F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.where(drawn < min(1.0, bound / total)).select("key", "x").limit(2 * bound).toArrow().sort_by("key")
    cells = Cells(matrix(sample["x"], n), max(1, min(CELLS, round(total / SHARD))))
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = quantised(matrix(b.column(2), n))
            cell = shared.value.route(v)
            with np.errstate(all="ignore"):
                far = spread(v, shared.value.centres[cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], ["key", "vec_id", "x", "n", "cell", "far"])

    dealt = materialize(rows.mapInArrow(assign, "key long, vec_id long, x array<double>, n int, cell int, far double"), "dealt")
    subs, radii = np.zeros(len(cells.centres), dtype=np.int64), np.zeros(len(cells.centres))
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("far")).collect():  # at most CELLS rows
        subs[r["cell"]], radii[r["cell"]] = -(-r["c"] // (2 * SHARD)), r["far"]
    cut = F.broadcast(rows.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(subs)], "cell int, subs int"))
    shards = dealt.join(cut, "cell").withColumn("sub", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int"))
    trees = materialize(build(shards), "trees", compression="none")
    queries = dealt.where(F.col("vec_id") % every == 0).select("key", "vec_id", "x")
    blocks = max(1, round(total / every / QUERIES))
    start = queries.withColumn("floor", F.lit(float("-inf")))
    homes = materialize(routed(start, cells, subs, radii, n, blocks, True), "homes")
    near = materialize(visit(homes, trees, k, n), "near")
    kth = near.groupBy("qkey").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"), F.count("score").alias("known")).where(F.col("known") == k)
    kth = kth.select(F.col("qkey").alias("key"), F.col("s").cast("double").alias("floor"))
    rest = queries.join(kth, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    routes = materialize(routed(rest, cells, subs, radii, n, blocks, False), "routes")
    found = materialize(near.union(visit(routes, trees, k, n)), "found")
    for done in (dealt, trees, homes, near, routes):
        discard(done)
    return found


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    Components are floor(64 x). Queries are rows with an id divisible by `every`;
    candidates are all rows of the query's length but the query's own, so that repeated
    rows are candidates (of each other too) and queries as often as they stand. Ties go
    to the smaller id. Null ids and vectors that are null, empty or hold null or
    non-finite components take no part; components of any size do, scored exactly, and a
    result beyond a long is an error. Further columns, whatever their names, are ignored;
    an empty table gives no rows.
    """
    rows = materialize(usable(vectors), "usable")
    found = None
    for r in rows.groupBy("n").count().orderBy("n").collect():  # the lengths of vectors
        part = search(rows.where(F.col("n") == r["n"]), r["n"], r["count"], k, every)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("qkey").orderBy(F.desc_nulls_last("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score does not fit a long")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH q AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
