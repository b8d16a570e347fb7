"""Toxic spans by a linear-chain conditional random field (operator 8).

Token labels come from document labels: a token of a toxic document is toxic if one of
its forms (word or leading letters) is far more frequent in toxic documents of the
sample. A two-state chain with form features of the token and its neighbours is fitted
to them; forward-backward marginals give the offending tokens, and a small logistic
model turns a document's marginals into its score. The sample is bounded by SAMPLE;
scoring reads whole texts in lock-step over the documents of a slice.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, held_out, read_table

SAMPLE = {1: 1000, 0: 3000}  # expected labelled documents by class that the model is fitted on
BUCKETS = 1 << 17
SLICE = 4 << 20
MEMO = 1 << 18
ODDS = 3.5  # log ratio of document frequencies from which a form marks toxic tokens
STEPS = 40
BLOCK = 1 << 18  # tokens whose arrays are held at once while fitting
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans string"


def forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def bucket(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def features(word: str) -> list[int]:
    """Buckets of the word itself, its leading letters, its ending; always five."""
    found = [bucket(f) for f in forms(word)]
    return (found + [bucket("*" + word[-3:])] + [BUCKETS] * 4)[:5]


def chain(e: np.ndarray, start: np.ndarray, n: np.ndarray, m: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and marginals of state 1 at each token.

    e: odds of the emission at each token; the sequences start at `start`, have n tokens
    each, longest first; m: 2 x 2 transition factors.
    """
    a, b = np.empty_like(e), np.ones_like(e)
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    now = None
    for t, k in enumerate(alive):
        i = start[:k] + t
        now = e[i] * first if t == 0 else e[i] * (m[0, 1] + now[:k] * m[1, 1]) / (m[0, 0] + now[:k] * m[1, 0])
        a[i] = now
    last = start + n - 1
    for t, k in enumerate(alive[1:], 1):
        i = last[:k] - t
        x = e[i + 1] * b[i + 1]
        b[i] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    odds = a * b
    return a, b, odds / (1 + odds)


@dataclass
class Model:
    own: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    before: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -6.0
    first: float = 0.0
    document: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))

    def emissions(self, ids: np.ndarray, starts: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Odds at each token from the scores of each distinct word; neighbours stay within a sequence."""
        e = own[ids] + self.bias
        if len(ids) > 1:
            left, right = before[ids[:-1]], after[ids[1:]]
            inner = starts[starts > 0]
            left[inner - 1] = 0
            right[inner - 1] = 0
            e[1:] += left
            e[:-1] += right
        return np.exp(np.clip(e, -30, 30))


def summary(marginal: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the summed squared marginals (so many tiny ones weigh nothing), the largest marginal."""
    x = np.zeros((len(n), 3))
    x[:, 0] = 1
    x[:, 1] = np.log(1e-3)
    full = n > 0
    if full.any():
        x[full, 1] = np.log(1e-3 + np.add.reduceat(marginal**2, starts[full]))
        x[full, 2] = np.maximum.reduceat(marginal, starts[full])
    return x


def originals(docs: list[np.ndarray]) -> list[bool]:
    """False for a document that shares one of two min-hashes of word pairs with an earlier one: likely a copy."""
    seen: set[tuple[int, int]] = set()
    out = []
    for ids in docs:
        pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
        marks = {(i, int((pairs * np.uint64(m) ^ (pairs >> np.uint64(29))).min())) for i, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))} if len(pairs) else set()
        out.append(not (marks & seen))
        seen |= marks
    return out


def toxic_words(docs: list[np.ndarray], toxic: np.ndarray, vocab: list[str]) -> np.ndarray:
    """1 for each word with a form that is far more frequent in toxic documents, else 0; docs hold word numbers.

    Copies count once, so that the words of a much-copied toxic text do not stand out.
    """
    first_of = originals(docs)
    docs, toxic = [d for d, ok in zip(docs, first_of) if ok], toxic[np.array(first_of)]
    owner = [i for i, w in enumerate(vocab) for _ in forms(w)]
    names = np.array([hash(f) for w in vocab for f in forms(w)], dtype=np.int64)
    distinct, form = np.unique(names, return_inverse=True)
    owner = np.array(owner, dtype=np.int32)
    first = np.searchsorted(owner, np.arange(len(vocab) + 1))
    seen = np.zeros((2, len(distinct)))
    for ids, y in zip(docs, toxic):
        own = [form[first[w] : first[w + 1]] for w in np.unique(ids)]
        if own:
            seen[int(y), np.unique(np.concatenate(own))] += 1
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    strong = (seen[1] >= 3) & (odds >= ODDS)
    marks = np.zeros(len(vocab))
    marks[owner[strong[form]]] = 1
    return marks


def gradient(model: Model, ids: np.ndarray, y: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, m: np.ndarray, words: tuple, word: np.ndarray, g: np.ndarray) -> None:
    """Add the log-likelihood's slopes over the sequences at `cuts` to word (role, word) and to g's last six."""
    by = np.argsort(-sizes, kind="stable")
    e = model.emissions(ids, cuts, *words)
    a, b, p = chain(e, cuts[by], sizes[by], m, np.exp(model.first))
    gap = y - p
    inner = np.ones(len(ids), dtype=bool)
    inner[cuts] = False
    pairs = np.flatnonzero(inner)
    for k, (at, who) in enumerate(((ids, gap), (ids[pairs - 1], gap[pairs]), (ids[pairs], gap[pairs - 1]))):
        word[k] += np.bincount(at, weights=who, minlength=word.shape[1])
    y0, y1 = y[pairs - 1].astype(float), y[pairs].astype(float)
    x, z = a[pairs - 1], e[pairs] * b[pairs]
    joint = np.stack([np.full(len(pairs), m[0, 0]), m[0, 1] * z, x * m[1, 0], x * m[1, 1] * z])
    joint /= joint.sum(axis=0)
    real = np.stack([(1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1])
    g[-6:-2] += (real - joint).sum(axis=1)
    g[-2] += gap[cuts].sum()
    g[-1] += gap.sum()


def fit(rows: list[tuple[str | None, int, float]]) -> Model:
    """rows: (text, toxic, weight); weight undoes the sampling of a class."""
    model = Model()
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w.lower(), len(vocab)) for w in WORD.findall(t or "")], dtype=np.int32) for t, _, _ in rows]
    toxic, weight = np.array([y for _, y, _ in rows], dtype=int), np.array([w for _, _, w in rows], dtype=float)
    if not len(rows) or not vocab or toxic.min() == toxic.max():
        share = np.clip(np.average(toxic, weights=weight) if len(rows) else 0.0, 1e-6, 1 - 1e-6)
        model.document = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return model
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    docs, toxic, weight = [docs[i] for i in order], toxic[order], weight[order]
    n = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    ids = np.concatenate(docs)
    y = (toxic_words(docs, toxic, list(vocab))[ids] * np.repeat(toxic, n)).astype(np.int8)
    feats = np.array([features(w) for w in vocab], dtype=np.int64)
    # the chain is fitted on parts of 64 tokens, longest first
    cuts = np.concatenate([s + np.arange(0, k, 64) for s, k in zip(starts, n) if k] or [np.zeros(0, dtype=int)]).astype(int)
    sizes = np.diff(np.append(cuts, len(ids)))
    edges = np.searchsorted(cuts, np.arange(0, len(ids), BLOCK)).tolist() + [len(cuts)]
    blocks = [(x, z) for x, z in zip(edges, edges[1:]) if x < z]
    size = BUCKETS + 1
    params = np.zeros(3 * size + 6)
    params[-1] = model.bias
    moment, square = np.zeros_like(params), np.zeros_like(params)
    rate = np.full_like(params, 0.3)
    rate[size : 3 * size] = 0.03  # neighbours only tilt a token

    def load(p: np.ndarray) -> None:
        model.own, model.before, model.after = p[:size], p[size : 2 * size], p[2 * size : 3 * size]
        model.trans, model.first, model.bias = p[-6:-2].reshape(2, 2), p[-2], p[-1]

    def scores() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(w[feats].sum(axis=1) for w in (model.own, model.before, model.after))

    for step in range(1, STEPS + 1):
        load(params)
        m, words = np.exp(model.trans), scores()
        g, word = np.zeros_like(params), np.zeros((3, len(vocab)))
        for x, z in blocks:
            low, high = cuts[x], cuts[z] if z < len(cuts) else len(ids)
            gradient(model, ids[low:high], y[low:high], cuts[x:z] - low, sizes[x:z], m, words, word, g)
        for k in range(3):
            g[k * size : (k + 1) * size] = np.bincount(feats.ravel(), weights=np.repeat(word[k], feats.shape[1]), minlength=size)
        g = g / max(1.0, y.sum()) - 1e-4 * params
        g[[size - 1, 2 * size - 1, 3 * size - 1]] = 0  # the bucket that pads short words
        moment = 0.9 * moment + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        params = params + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    load(params.copy())
    m, words, first, parts = np.exp(model.trans), scores(), np.exp(model.first), []
    edges = np.searchsorted(starts, np.arange(0, len(ids), BLOCK)).tolist() + [len(n)]
    for i, j in zip(edges, edges[1:]):
        if i < j:
            low, k = starts[i], n[i:j]
            own = starts[i:j] - low
            e = model.emissions(ids[low : low + k.sum()], own[k > 0], *words)
            parts.append(summary(chain(e, own, k, m, first)[2], own, k))
    x = np.concatenate(parts)
    w = np.array([-3.0, 0.0, 0.0])
    for _ in range(25):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (weight * (toxic - q)) - 0.05 * w)
    model.document = w
    for name in ("own", "before", "after"):
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


class Scorer:
    """Scores texts, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.zeros((3, 0))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        docs = [list(map(str.lower, WORD.findall(t))) if t else [] for t in texts]
        ids = self.ids
        if len(ids) > MEMO:
            ids.clear()
            self.table = np.zeros((3, 0))
        new = list({w for d in docs for w in d}.difference(ids))
        if new:
            feats = np.array([features(w) for w in new])
            more = np.stack([w[feats].sum(axis=1, dtype=np.float64) for w in (self.model.own, self.model.before, self.model.after)])
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self.table = np.concatenate([self.table, more], axis=1)
        n = np.array([len(d) for d in docs], dtype=np.int64)
        return np.fromiter((ids[w] for d in docs for w in d), dtype=np.int64, count=int(n.sum())), n

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        ids, n = self.words(texts)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        e = self.model.emissions(ids, starts[n > 0], *self.table)
        by = np.argsort(-n, kind="stable")
        *_, p = chain(e, starts[by], n[by], np.exp(self.model.trans), np.exp(self.model.first))
        x = summary(p, starts, n)
        score = 1 / (1 + np.exp(-np.clip(x @ self.model.document, -700, 700)))
        spans = [""] * len(texts)
        for i in np.flatnonzero(x[:, 2] >= 0.5):
            hit = p[starts[i] : starts[i] + n[i]] >= 0.5
            spans[i] = ",".join(f"{m.start()}:{m.end()}" for m, h in zip(WORD.finditer(texts[i]), hit) if h)
        return score, spans


def training_rows(docs: DataFrame, labels: DataFrame, sample: dict[int, int]) -> DataFrame:
    """(doc_id, text, y, weight) of labelled documents that do not count as held out, about sample[y] of each class."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rate = {y: min(1.0, k / max(1, counts.get(y, 0))) for y, k in sample.items()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0
    of_class = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    marks = marks.where(drawn < of_class).withColumn("weight", 1 / of_class)
    # the drawn labels are about sum(sample.values()) rows however long the table is
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(marks), "doc_id")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    spans lists offending tokens as start:end in code points, comma-joined. Null and
    wordless texts get the score of a text without toxic tokens; texts of any length
    count whole; without labels of both classes all scores are near the only class;
    repeated rows and null doc_ids (held out) stay; further columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in bounded(it, 2, SLICE):
            scores, spans = scorer.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept; edge cases as in score_documents()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in bounded(it, "text", SLICE):
            score, _ = scorer.score(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample, in one executor task; only the model reaches the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in it for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"] or ""))
        model = fit([(r["text"], r["y"], r["weight"]) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = training_rows(docs, labels, SAMPLE).repartition(1)
    models = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else Model()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
