"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where the session names none, a local one is made if the driver is the only machine
    (master local…); on a cluster it is an error, since executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path, old = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    # shuffle files of a finished step go at once instead of when the driver collects garbage
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def bounded(batches: Iterator[pa.RecordBatch], column: int | str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose text column has about `size` bytes; a longer text is a slice of its own."""
    for b in batches:
        i = b.schema.get_field_index(column) if isinstance(column, str) else column
        upto = np.cumsum(pc.binary_length(b.column(i)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.flatnonzero(np.diff(upto // size)) + 1 if len(upto) else np.zeros(0, dtype=int)
        edges = [0, *cut.tolist(), b.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low < high:
                yield b.slice(low, high - low)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(True))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b) of longs.

    Returns (node, root) for every node that has an edge and is not its own root;
    root is the smallest node of the component. Each round hooks every node to its
    smallest smaller neighbour, shortens the trees by pointer jumping, and contracts
    the edges to roots, so rounds fall with the logarithm of the longest path. All
    steps are joins and partial aggregates; only counts reach the driver.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    found = None
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            jumped = materialize(
                hooks.join(above, "up", "left").select(
                    "hi", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")
                ),
                "jumps",
            )
            moved = not jumped.where("moved").isEmpty()
            discard(hooks)
            hooks = jumped.select("hi", "up")
            if not moved:
                break
        top_hi = hooks.select("hi", F.col("up").alias("h"))
        top_lo = hooks.select(F.col("hi").alias("lo"), F.col("up").alias("l"))
        joined = (
            edges.join(top_hi, "hi", "left")
            .join(top_lo, "lo", "left")
            .select(F.coalesce("h", "hi").alias("x"), F.coalesce("l", "lo").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
            .distinct()
        )
        joined = materialize(joined, "edges")
        discard(edges)
        edges = joined
        now = hooks.select(F.col("hi").alias("node"), F.col("up").alias("root"))
        if found is not None:
            step = hooks.select(F.col("hi").alias("root"), F.col("up").alias("next"))
            now = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")).union(now)
        found = now
    if found is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return materialize(found, "components")
