import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from oscilla.llm import warc

REAL = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def rows():
    big = "<p>ünï</p>" * 200
    out = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i % 90)) for i in range(120)]
    out += [(200 + i, "u", big) for i in range(40)]
    out += [(300, None, None), (301, "a\r\nWARC/1.1\r\nb", ""), (302, "u", "small"), (303, "u", "small"), (None, "u", big), (None, "u", "no id")]
    out += [(400, "u", REAL), (401, "u", REAL * 30), (402, "u", "WARC/1.1\r\n"), (403, "u", "x" + REAL[:-4] + "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (404, "u", "z" * 300_000)]
    return out + [(405, "u", "\r\n\r\n"), (239, "u", big), (5, "u", "twice"), (5, "u", "twice")]


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    keeper = {}
    for p, b in data:
        if len(b) >= 1000 and p is not None:
            keeper[b] = max(p, keeper.get(b, p))
    out = []
    for p, b in data:
        k = keeper.get(b)
        visit = k is not None and p != k
        out.append((str(p), len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", str(k if visit else None)))
    return sorted(out)


@pytest.mark.parametrize("split", [None, "700"])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumns({"type": F.lit(1), "off": F.lit("x")})
    path = f"file://{tmp_path}/out"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in warc.round_trip(pages, path, "none" if split else "gzip").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == brute(rows())
    files = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    data = b"".join((open if split else gzip.open)(f, "rb").read() for f in files)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def parse(data):
    """Records of a WARC file, read strictly in order: (headers, block)."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        heads = dict(x.split(": ", 1) for x in lines)
        n = int(heads["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        assert len(block) == n and data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        out.append((heads, block))
        at = end + 8 + n
    return out


def test_records_are_valid(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/out", "none", "2026-01-02T03:04:05Z")
    found = [r for f in glob.glob(f"{tmp_path}/out/part-*") for r in parse(open(f, "rb").read())]
    assert len(found) == len(rows())
    payloads = {}
    for heads, block in found:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= heads.keys()
        if heads["WARC-Type"] == "response":
            http, payload = block.split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and int(http.rsplit(b": ", 1)[1]) == len(payload)
            assert heads["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            payloads[heads["WARC-Record-ID"]] = heads["WARC-Payload-Digest"]
    for heads, block in found:
        if heads["WARC-Type"] == "revisit":
            assert heads["WARC-Profile"] == warc.PROFILE and block == b""
            assert payloads[heads["WARC-Refers-To"]] == heads["WARC-Payload-Digest"]


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, f"file://{tmp_path}/out").collect() == []
