"""SimHash near-duplicates by segment-popcount embedding (operator 2).

A 64-bit fingerprint is embedded as 32 counts of set bits, one per 2-bit segment,
packed in one long. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so pairs within the radius lie within it in
the grid too. The 32 coordinates are dealt into radius + k groups: a distance of
`radius` at most leaves k groups untouched, so a range-join on the cells of every
choice of k groups loses no pair. Candidates are filtered by Manhattan distance,
then by the exact Hamming distance.

Large groups of near copies emit no all-pairs: every cell first links its members
to two pivots (its smallest and largest fingerprint), components are contracted,
and only members of cells that still hold several components are joined. Cells with
more than CELL such members go to a finer grid instead, which keeps more groups and
so loses no pair either.

Everything after the fingerprints runs on JVM columns. Exact copies are one row
from the start (distinct fingerprints).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, materialize, read_table

LOW = 0x5555555555555555
SEGMENTS = 32
CELL = 2000  # members of a cell that are joined with each other at most, while a finer grid is left
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of word shingles; no words (or null) give zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):  # a very long text is hashed in chunks
        part = words[at : at + CHUNK + width - 1]
        rows = zip(*(part[i:] for i in range(width))) if len(words) >= width else [part]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(x), seed) for x in rows], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fp = [_signed(text_fingerprint(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the signed form of the 64-bit fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_batches, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Set bits of each 2-bit segment, packed into 2-bit fields."""
    low = F.lit(LOW)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed embeddings whose fields hold 0, 1 or 2."""
    low = F.lit(LOW)
    x = a.bitwiseXOR(b)
    odd = x.bitwiseAND(low)
    two = F.shiftrightunsigned(x, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + F.bit_count(two) * 2


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks(radius: int, kept: int) -> list[int]:
    """Fields of every choice of `kept` of `radius + kept` groups of segments."""
    groups = [0] * (radius + kept)
    for field in range(SEGMENTS):
        groups[field % len(groups)] |= 3 << (2 * field)
    return [_signed(sum(c)) for c in combinations(groups, kept)]


def kept_groups(n: int) -> int:
    """Groups that a cell keeps: more for larger inputs, so cells stay small. Exact for all."""
    return 3 if n < 20_000_000 else 5 if n < 1_000_000_000 else 7


def links(fps: DataFrame, radius: int, kept: int) -> DataFrame:
    """Edges (a, b) that connect all fps within the radius; fps are distinct."""
    kept = min(kept, SEGMENTS - radius)
    e = embed(F.col("fp"))
    cells = F.posexplode(F.array(*[F.lit(m) for m in masks(radius, kept)])).alias("m", "mask")
    members = fps.select("fp", cells).select("fp", "m", e.bitwiseAND(F.col("mask")).alias("k"))
    pivots = materialize(
        members.groupBy("m", "k")
        .agg(F.min("fp").alias("p"), F.max("fp").alias("q"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "pivots",
    )
    full = materialize(members.join(pivots, ["m", "k"]), "members")
    discard(pivots)

    def close(a: str, b: str) -> Column:
        x, y = F.col(a), F.col(b)
        return (x != y) & (manhattan(embed(x), embed(y)) <= radius) & (hamming(x, y) <= radius)

    star = full.where(close("fp", "p")).select(F.col("fp").alias("a"), F.col("p").alias("b"))
    star = star.union(full.where(close("fp", "q")).select(F.col("fp").alias("a"), F.col("q").alias("b")))
    first = components(star)
    rest = full.where("n > 2").select("m", "k", "fp")
    rest = rest.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = materialize(rest, "rest")
    discard(full)
    mixed = rest.groupBy("m", "k").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n"))
    mixed = materialize(mixed.where("r < s").select("m", "k", "n"), "mixed")
    open_ = materialize(rest.join(mixed, ["m", "k"]), "open")
    discard(rest, mixed)
    finer = kept + radius < SEGMENTS
    cool = open_.where(F.col("n") <= CELL) if finer else open_
    x = cool.select("m", "k", F.col("fp").alias("f"), F.col("root").alias("a"))
    y = cool.select("m", "k", F.col("fp").alias("g"), F.col("root").alias("b"))
    late = x.join(y, ["m", "k"]).where(F.col("a") < F.col("b")).where(close("f", "g")).select("a", "b")
    late = materialize(late.distinct(), "late")
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late)
    if finer:
        hot = materialize(open_.where(F.col("n") > CELL).select("fp").distinct(), "hot")
        if not hot.isEmpty():
            edges = edges.union(links(hot, radius, kept + 4))
        discard(hot)
    discard(open_)
    return edges


def near_links(fps: DataFrame, radius: int = 3, kept: int | None = None) -> DataFrame:
    """(fp, root) of all fps that are not the smallest of their component; kept: groups that a cell keeps."""
    fps = materialize(fps.select("fp").distinct(), "fps")
    edges = links(fps, radius, kept or kept_groups(fps.count()))
    out = components(edges)
    discard(fps, edges)
    return out


def near_duplicates(docs: DataFrame, radius: int = 3, kept: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `radius` differing bits
    reach, whatever number of groups the grid's cells keep. Null and wordless texts have
    fingerprint zero and link like any other; texts of any length are read whole, in
    chunks; equal fingerprints are one component; repeated rows stay as rows; a null
    doc_id is never a component's smallest unless it is alone (then null); other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    marks = materialize(fingerprints(docs), "fingerprints")
    groups = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = near_links(groups, radius, kept).withColumnRenamed("node", "fp")
    rooted = materialize(
        groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = materialize(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    discard(groups, roots, rooted, ids)
    return marks.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component.

    Repeated rows of one doc_id are all kept or all dropped; rows with null doc_id stay. Null
    and empty texts have the fingerprint of no words and are near each other; texts of any
    length count whole; of equal texts the smallest doc_id stays; all columns stay as they
    are, whatever their names; an empty table gives no rows.
    """
    near = near_duplicates(docs.select("doc_id", "text"), radius)
    losers = materialize(near.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct(), "losers")
    discard(near)
    return docs.join(losers, "doc_id", "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
