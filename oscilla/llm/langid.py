"""Language mixtures by expectation-maximisation (operator 10).

Each word of a document is a draw from one of the learned languages, whose
likelihood is the product of its byte trigrams' (with both word ends). EM estimates
the document's language proportions, to a tolerance; nested sets of the leading
languages are compared by likelihood less `PENALTY` * size * ln(words), growing while
that rises, and the best set's largest proportion names the document. Trigrams are
counted where the texts lie; only counts reach the driver.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, held_out, read_table

BUCKETS = 1 << 16
SAMPLE = 1200  # expected documents a language that the likelihoods are learned from
LANGUAGES = 400  # learned at most, unless given: the model is BUCKETS numbers for each
SLICE = 4 << 20
NUMBERS = 1 << 20  # of words by languages held at once, about: texts are taken in slices of as many bytes as fit
STEPS, TOLERANCE = 200, 1e-4
PENALTY = 1.0
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
BREAKS, RARE = re.compile(r"[\W\d_]+"), re.compile(f"[ {NUMERALS}]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"


def words_of(text: str | None) -> str:
    """Runs of letters (str.isalpha) in lower case with a space on both ends; '' if there is none."""
    inner = BREAKS.sub(" ", (text or "").lower())
    if not inner.replace(" ", "").isalpha():  # a large class of characters is slow
        inner = RARE.sub(" ", inner)
    inner = inner.strip()
    return f" {inner} " if inner else ""


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and the place of each word's first one."""
    x = np.frombuffer(data, dtype=np.uint8)
    y = x.astype(np.uint32)
    key = (y[:-2] * np.uint32(0x9E3779B1) ^ y[1:-1] * np.uint32(0x85EBCA6B) ^ y[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return (key >> np.uint32(16)).astype(np.int32), np.flatnonzero(x[:-2] == 32)


def count(text: str | None, into: np.ndarray) -> None:
    """Add a text's trigrams to counts by bucket."""
    if data := words_of(text).encode("utf-8", "surrogatepass"):
        into += np.bincount(trigrams(data)[0], minlength=BUCKETS)


def likelihoods(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-likelihoods (bucket, language) of counts by bucket."""
    langs = sorted(counts)
    table = np.stack([counts[x] + 0.05 for x in langs], axis=1) if langs else np.full((BUCKETS, 1), 0.05)
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def learn(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """The model of (text, lang) rows."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in rows:
        count(text, counts.setdefault(lang, np.zeros(BUCKETS)))
    return likelihoods(counts)


def mixtures(log_p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (document, language) and log-likelihood of the words log_p (word, language).

    A document takes part in the steps until none of its proportions moves by TOLERANCE.
    """
    n = np.diff(np.append(starts, len(log_p)))
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    doc = np.repeat(np.arange(len(starts)), n)
    share = np.full((len(starts), log_p.shape[1]), 1.0 / log_p.shape[1])
    live, own, at, first = np.arange(len(starts)), p, doc, starts
    for _ in range(STEPS if log_p.shape[1] > 1 else 0):
        r = share[at] * own
        r /= r.sum(axis=1, keepdims=True) + 1e-300
        new = np.add.reduceat(r, first) / n[live, None]
        moved = np.abs(new - share[live]).max(axis=1) >= TOLERANCE
        share[live] = new
        if not moved.any():
            break
        if not moved.all():
            rows = np.repeat(moved, n[live])
            live, own, at = live[moved], own[rows], at[rows]
            first = np.cumsum(n[live]) - n[live]
    total = np.log((share[doc] * p).sum(axis=1) + 1e-300) + top[:, 0]
    return share, np.add.reduceat(total, starts)


def word_likelihoods(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, log-likelihoods by language) of each word of data, whose words stand between spaces."""
    buckets, starts = trigrams(data)
    space = np.frombuffer(data, dtype=np.uint8)[1:-1] == 32
    out = np.zeros((len(starts), table.shape[1]))
    for low in range(0, len(buckets), SLICE):
        values = table[buckets[low : low + SLICE]]
        values[space[low : low + SLICE]] = 0  # those that reach into the next word
        cut = np.unique(np.concatenate([[low], starts[(starts > low) & (starts < low + SLICE)]]))
        out[np.searchsorted(starts, cut, side="right") - 1] += np.add.reduceat(values, cut - low, axis=0, dtype=np.float64)
    return starts, out


def room(languages: int) -> int:
    """Bytes of text whose words by languages are NUMBERS at most, unless words are very short."""
    return max(1, 4 * NUMBERS // max(1, languages))


def weighted_mixture(log_p: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of one document of words log_p (word, language) that occur `times`, `rows` words at once."""
    k, n = log_p.shape[1], times.sum()
    share = np.full(k, 1.0 / k)
    parts = [slice(low, low + rows) for low in range(0, len(log_p), rows)]
    top = log_p.max(axis=1)
    for _ in range(STEPS if k > 1 else 0):
        new = np.zeros(k)
        for at in parts:
            r = share * np.exp(log_p[at] - top[at, None], dtype=np.float64)
            new += times[at] @ (r / (r.sum(axis=1, keepdims=True) + 1e-300))
        new /= n
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    like = sum(float(times[at] @ (np.log(np.exp(log_p[at] - top[at, None], dtype=np.float64) @ share + 1e-300) + top[at])) for at in parts)
    return share, like


def infer_long(text: str, langs: list[str], table: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """infer() of one very long text: its different words and how often each occurs are held, as single precision."""
    words = Counter(text.split())
    size, held, parts = room(len(langs)), 0, [[]]
    for w in words:
        if held > size:
            parts.append([])
            held = 0
        parts[-1].append(w)
        held += len(w)
    spans = np.concatenate([word_likelihoods(f" {' '.join(p)} ".encode("utf-8", "surrogatepass"), table)[1].astype(np.float32) for p in parts])
    times, rows = np.fromiter(words.values(), dtype=np.float64, count=len(words)), max(1, NUMBERS // len(langs))
    share, _ = weighted_mixture(spans, times, rows)
    order, best, chosen = np.argsort(-share, kind="stable"), -np.inf, ([], [])
    for k in range(1, len(langs) + 1):
        part, like = weighted_mixture(spans[:, order[:k]], times, rows)
        like -= PENALTY * k * np.log(times.sum() + 1.0)
        if like <= best:
            break
        best = like
        full = np.zeros(len(langs))
        full[order[:k]] = part
        rank = np.argsort(-full, kind="stable")[:k]
        chosen = (rank, [float(min(1.0, x)) for x in full[rank]])
    return langs[chosen[0][0]], chosen[1][0], [langs[x] for x in chosen[0]], chosen[1]


def infer(texts: list[str | None], langs: list[str], table: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    """(lang_pred, score, languages of the chosen set, their shares) of each text."""
    out: list[tuple[str, float, list[str], list[float]]] = [("und", 0.0, [], [])] * len(texts)
    marked = []
    for i, t in enumerate(texts):
        if langs and (w := words_of(t)):
            if len(w) > room(len(langs)):
                out[i] = infer_long(w, langs, table)
            else:
                marked.append((i, w))
    if not marked:
        return out
    data = [w.encode("utf-8", "surrogatepass") for _, w in marked]
    ends = np.cumsum([len(d) for d in data])
    starts, spans = word_likelihoods(b"".join(data), table)
    # the space that closes one document starts no word
    closing = np.isin(starts, ends[:-1] - 1)
    starts, spans = starts[~closing], spans[~closing]
    firsts = np.searchsorted(starts, ends - [len(d) for d in data])
    n = np.diff(np.append(firsts, len(starts)))
    share, _ = mixtures(spans, firsts)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen, size = np.full(len(n), -np.inf), np.zeros_like(share), np.ones(len(n), dtype=int)
    live = np.arange(len(n))
    for k in range(1, len(langs) + 1):
        rows = np.isin(np.repeat(np.arange(len(n)), n), live)
        sub = np.take_along_axis(spans[rows], np.repeat(order[live, :k], n[live], axis=0), axis=1)
        part, like = mixtures(sub, np.cumsum(n[live]) - n[live])
        like -= PENALTY * k * np.log(n[live] + 1.0)
        better = like > best[live]
        live, part = live[better], part[better]
        if not len(live):
            break
        best[live], size[live], chosen[live] = like[better], k, 0
        full = np.zeros((len(live), share.shape[1]))
        np.put_along_axis(full, order[live, :k], part, axis=1)
        chosen[live] = full
    for j, (i, _) in enumerate(marked):
        rank = np.argsort(-chosen[j], kind="stable")[: size[j]]
        shares = [float(min(1.0, x)) for x in chosen[j][rank]]
        out[i] = (langs[rank[0]], shares[0], [langs[x] for x in rank], shares)
    return out


def train(docs: DataFrame, per_language: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The model of rows that do not count as held out, about per_language of each language; their trigrams are counted in tasks.

    More than `languages` of them are an error: a language is a quarter of a megabyte of the model that every task holds.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rate, sizes = F.lit(0.0), known.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    for lang, n in sizes:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003)) / 1_000_003.0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in bounded(it, 0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count(text, counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64)))
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    parts = known.where(drawn < rate).select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    found = {lang: np.zeros(BUCKETS) for lang, _ in sizes}
    for lang, at, n in zip(sums["lang"].to_pylist(), sums["bucket"].to_pylist(), sums["n"].to_pylist()):
        found[lang][at] = n
    return likelihoods(found)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages, shares.

    Null texts and texts without a letter (numerals and signs alone) are `und` with score
    0 and empty lists, as are all if nothing was learned; ties go to the language first
    in order; texts of any length count whole; repeated rows and null doc_ids (held out)
    stay; further columns, whatever their names, are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in bounded(it, 2, room(len(langs))):
            found = infer(b.column(2).to_pylist(), langs, table)
            cols = [list(c) for c in zip(*found)] or [[], [], [], []]
            types = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types))],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
