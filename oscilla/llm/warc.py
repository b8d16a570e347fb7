"""WARC archives written and read by Spark, with boundary-chain verification (operator 6).

Writing: records are text rows whose separator is the record end, so Spark's own
writer makes the archives. Reading: Spark's line reader cuts the archives at every
magic ("WARC/1.1" and a line end), wherever it stands; each piece is a candidate record
whose length header gives the offset of its successor. Pointer jumping from offset 0
of each file keeps the candidates on the chain; pieces off the chain are payload and go
back to the record before them. Offsets are prefix sums of piece lengths: within a file
split, then over the splits of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, scratch_path

END = "\r\n\r\n"
MAGIC = "WARC/1.1\r\n"
MIN_REVISIT = 1000  # bytes from which equal payloads are stored once
PER_FILE = 5000  # records of one archive at most
DATE = "1970-01-01T00:00:00Z"  # pages name none
# The profile of revisits of equal payloads, and the head of a response's HTTP block up to its length.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record string): one WARC record for each row of pages (page_id, url, html); date stands for that of the crawl.

    A response's block is an HTTP response whose body is the payload.

    Of equal payloads of MIN_REVISIT bytes or more, rows with the largest page_id are
    responses and the others revisits without a payload; smaller ones are responses.
    """
    p = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    same = p.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    same = materialize(same.where("copies > 1 and keeper is not null").select("digest", "keeper"), "copies")
    p = p.join(same, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False)))
    p = p.withColumn("block", F.when(F.col("revisit"), F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(END), F.col("html"))))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")),
        F.lit("WARC-Record-ID: "),
        page("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), page("keeper"))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    return p.select(F.concat(head, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", date: str = DATE) -> None:
    """Archives under path: one stream a file if compressed; with "none" readers can seek in them."""
    records(pages, date).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).option("compression", compression).text(path)


def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `local`, the bytes of the pieces before this one in its file split; pieces arrive in order."""
    last, at = None, 0
    for b in it:
        if not b.num_rows:
            continue
        f, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        size = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + len(MAGIC)
        before = np.cumsum(size) - size
        new = np.concatenate([[(f[0], part[0]) != last], (f[1:] != f[:-1]) | (part[1:] != part[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(f)), -1))
        local = np.where(first < 0, at + before, before - before[np.maximum(first, 0)])
        last, at = (f[-1], part[-1]), int(local[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(local), b.column(2)], ["f", "part", "local", "body"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(f, part, local, body): what follows each magic, by file, file split and place in the split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("body"))
    return materialize(lines.mapInArrow(place, "f long, part long, local long, body string"), "pieces", compression="zstd")


def header(name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"(?i)\r\n{name}: *([^\r\n]*)", 1)


def reachable(nodes: DataFrame) -> DataFrame:
    """(f, off) of the candidates on the chain from offset 0; nodes: (f, off, next)."""
    jump = materialize(nodes.select("f", "off", "next"), "jump")
    live = nodes.select("f", "off")
    found = materialize(live.where("off = 0"), "reach")
    size = found.count()
    while size:
        step = found.join(jump.hint("merge"), ["f", "off"]).select("f", F.col("next").alias("off"))
        grown = materialize(found.union(step.join(live.hint("merge"), ["f", "off"], "left_semi")).distinct(), "reach")
        then = jump.select("f", F.col("off").alias("next"), F.col("next").alias("later"))
        longer = materialize(jump.join(then.hint("merge"), ["f", "next"]).select("f", "off", F.col("later").alias("next")), "jump")
        discard(found)
        n = grown.count()
        found, jump = grown, longer
        if n == size:
            break
        size = n
    return found


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, type, refers_to, digest, payload) of the true records of the archives under path.

    Offsets, successors and chains are worked out on rows without bodies; bodies are
    joined only with the pieces that are not whole records, which Spark broadcasts while
    they are few and shuffles otherwise.
    """
    every = pieces(spark, path)
    key = ["f", "part", "local"]
    split = F.split("body", END, 2)
    thin = every.select(*key, F.octet_length("body").cast("long").alias("n"), split[0].alias("head"), F.size(split).alias("parts"))
    length = header("Content-Length")
    length = F.when((F.col("parts") == 2) & length.rlike(r"^\d{1,18}$"), length.cast("long"))
    thin = materialize(thin.select(*key, "n", (len(MAGIC) + F.octet_length("head") + len(END) + length + len(END)).alias("span")), "thin")
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = thin.groupBy("f", "part").agg(F.sum(F.col("n") + len(MAGIC)).alias("size"))
    parts = materialize(parts.select("f", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "parts")
    # what stands before a file's first magic is no candidate
    off = F.col("base") + F.col("local") - len(MAGIC)
    nodes = materialize(thin.join(parts, ["f", "part"]).select(*key, off.alias("off"), (off + F.col("span")).alias("next")).where("off >= 0"), "nodes")
    chain = reachable(nodes)
    mark = nodes.join(chain.withColumn("true", F.lit(True)).hint("merge"), ["f", "off"], "left")
    upto = Window.partitionBy("f").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("true"), F.col("off")), ignorenulls=True).over(upto)
    mark = mark.select(*key, "off", owner.alias("owner"))
    mark = mark.withColumn("n", F.when(F.col("owner").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("f", "owner"))).otherwise(0))
    odd = materialize(mark.where("n <> 1"), "odd")
    blank = thin.join(parts, ["f", "part"]).where((F.col("base") == 0) & (F.col("local") == 0)).select(*key)
    single = every.join(odd.select(*key).union(blank), key, "left_anti").select("body")
    joined = F.concat_ws(MAGIC, F.transform(F.array_sort(F.collect_list(F.struct("off", "body"))), lambda x: x["body"]))
    several = every.join(odd.where("n > 1"), key).groupBy("f", "owner").agg(joined.alias("body")).select("body")
    rows = single.union(several).select(F.split("body", END, 2)[0].alias("head"), "body")
    # the payload of a response follows its HTTP head; a revisit has none
    http = F.octet_length(F.split("body", END, 3)[1]) + len(END)
    size = header("Content-Length").cast("int")
    http = F.when(size > 0, http).otherwise(0)
    start = F.octet_length("head") + len(END) + http + 1
    content = F.substring(F.col("body").cast("binary"), start, size - http)
    out = rows.select(header("WARC-Type").alias("type"), header("WARC-Payload-Digest").alias("d"), header("WARC-Record-ID").alias("i"), header("WARC-Refers-To").alias("r"), content.alias("payload"))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    return out.select(number("i").alias("page_id"), "type", number("r").alias("refers_to"), F.regexp_replace("d", "^sha1:", "").alias("digest"), "payload")


def round_trip(pages: DataFrame, path: str, compression: str = "gzip") -> DataFrame:
    """Write pages to archives under path, read them back, one row for each page.

    Returns page_id, payload_bytes, payload_digest (SHA-1 of the full payload, lower-case
    hex), record_type, refers_to. Null html is an empty payload; a null url is written
    empty and control characters of one as %20; a null page_id comes back null and is
    a revisit of an equal payload that has an id; rows of one page_id each give a row, all responses where they tie for
    the largest; payloads of any length that a record can hold (2 GB) are whole; further
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    write_archives(pages, path, compression)
    back = materialize(
        read_archives(pages.sparkSession, path).select(
            "page_id", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("own")
        ),
        "records",
    )
    answers = back.where("type = 'response'")
    full = answers.select(F.col("page_id").alias("refers_to"), F.col("own").alias("digest"), F.col("n").alias("full")).distinct()
    seen = back.where("type = 'revisit'").join(full.hint("merge"), ["refers_to", "digest"])
    one = answers.select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    two = seen.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return one.union(two)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (d)
"""
