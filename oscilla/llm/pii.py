"""Personal data by candidate gradient boosting (operator 1).

Four base formats (email, ip, card, phone) are found exactly and always kept. Beside
them, high-recall generators propose overlapping looser spans; boosted trees score each
proposal from its format and its context, per-kind calibration turns scores into
probabilities, and those over their kind's threshold are added where they touch no base
span. Trees are fitted on a bounded sample: base spans and loosened copies of them
(plus sign dropped, separators changed, @ and dots spelled out) against proposals that
fail the formats. Trees thus know spellings like those of loosened(); others rest on
what these have in common.

All patterns are linear in the text: they start at rare marks ('@', '+', a digit) and
never back up over a run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read_table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # expected documents whose proposals train the trees
PER_DOCUMENT = 50  # training proposals of one sampled document
PRECISION = 0.995
MIN_SUPPORT = 20  # calibration positives without which a kind adds nothing

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LOOSE_MAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,5}"
)
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(] ?(?:\.|dot) ?[\])] ?[0-9]{1,3}){3}(?![0-9])")
LOOSE_NUMBER = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9])++\)?")
HINTS = tuple(
    re.compile(p, re.I)
    for p in (r"tel|phone|call|mobile|fax", r"mail|contact|write", r"card|visa|credit|pay", r"\bip\b|host|server|addr", r"order|isbn|invoice|serial|version|\bid\b|\bno\b|#|date|page")
)

Span = tuple[int, str, int]  # start, kind, end


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The exact formats, leftmost and non-overlapping per kind, failing matches dropped."""
    found: list[Span] = []
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            low = m.end()
            found.append((start, "email", low))
        at = text.find("@", max(at + 1, low))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if _octets(m[0].split(".")):
                found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), "card", m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def proposals(text: str) -> list[Span]:
    """Overlapping candidates of the generators."""
    out: list[Span] = []
    if "@" in text or re.search(r"[\[(] ?at ?[\])]", text):
        out += [(m.start(), "email", m.end()) for m in LOOSE_MAIL.finditer(text)]
    if DIGITS.search(text):
        out += [(m.start(), "ip", m.end()) for m in LOOSE_IP.finditer(text)]
        for m in LOOSE_NUMBER.finditer(text):
            n = len(_digits(m[0]))
            if 7 <= n <= 15:
                out.append((m.start(), "phone", m.end()))
            if 12 <= n <= 19:
                out.append((m.start(), "card", m.end()))
            if m[0].count(".") == 3 and 4 <= n <= 12:
                out.append((m.start(), "ip", m.end()))
    return out


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(span: Span, text: str, before: str, after: str) -> list[float]:
    """Format of `text` (the span's own) and its context."""
    digits = _digits(text)
    groups = re.findall(r"[0-9]+", text)
    tail = re.split(r"[.\]) ]", text.rstrip(")] "))[-1]
    return [
        float(KINDS.index(span[1])),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(text.count(".")),
        float(text.count(" ")),
        float(text.count("-")),
        float(text.count("/")),
        float(text.startswith("+")),
        float("(" in text),
        float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and _octets(groups)),
        float("@" in text),
        float(len(tail) if tail.isalpha() else 0),
        float(len(text)),
        float(_class(before[-1:])),
        float(_class(after[:1])),
        *(float(bool(h.search(before))) for h in HINTS),
    ]


def loosened(span: Span, text: str) -> list[tuple[Span, str]]:
    """Other spellings of a base span."""
    start, kind, _ = span
    if kind == "email":
        ways = [text.replace("@", " [at] "), text.replace("@", "(at)").replace(".", " (dot) "), text.replace("@", " @ ")]
    elif kind == "phone":
        ways = [text.lstrip("+"), text.lstrip("+").replace("(", "").replace(")", ""), text.replace(" ", "-"), text.replace(" ", ".")]
        ways += [re.sub(r"^\+[0-9]{1,3}[ .-]", "", text)]
    elif kind == "card":
        d = _digits(text)
        ways = [" ".join(d[i : i + 4] for i in range(0, len(d), 4)), ".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    else:
        ways = [text.replace(".", dot) for dot in ("[.]", "(.)", " [dot] ", "(dot)")]
    return [((start, kind, start + len(w)), w) for w in ways]


@dataclass
class Tree:
    """A balanced tree of three levels: seven splits, eight leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(3):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.leaf[node - 7]


@dataclass
class Model:
    trees: list[Tree] = field(default_factory=list)
    prior: float = -10.0
    slope: np.ndarray = field(default_factory=lambda: np.ones(len(KINDS)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS)))
    threshold: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), 2.0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((t(x) for t in self.trees), np.full(len(x), self.prior))

    def probability(self, x: np.ndarray) -> np.ndarray:
        k = x[:, 0].astype(int)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) * self.slope[k] + self.shift[k], -40, 40)))


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
    feature, cut = np.zeros(7, dtype=int), np.full(7, np.inf)
    node = np.zeros(len(x), dtype=np.int64)
    for at in range(7):
        rows = np.flatnonzero(node == at)
        best = 1e-6
        gs, hs = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c) or not len(rows):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            i = int(gain.argmax())
            if gain[i] > best:
                best, feature[at], cut[at] = gain[i], f, c[i]
        node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
    leaf = np.array([g[r].sum() / (h[r].sum() + 1) for r in (np.flatnonzero(node == k) for k in range(7, 15))])
    return Tree(feature, cut, 0.3 * leaf)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> Model:
    """Boost on two thirds, calibrate each kind and choose its threshold on the rest."""
    model = Model()
    if not len(x) or y.min() == y.max():
        return model
    held = np.arange(len(x)) % 3 == 2
    a, b = x[~held], y[~held]
    if not len(b) or b.min() == b.max():
        return model
    cuts = [(lambda u: (u[1:] + u[:-1]) / 2)(np.unique(np.quantile(c, np.linspace(0, 1, 33), method="nearest"))) for c in a.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, a.T)], axis=1)
    model.prior = float(np.log(b.mean() / (1 - b.mean())))
    score = np.full(len(b), model.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        model.trees.append(tree := grow(a, cuts, binned, b - p, p * (1 - p)))
        score += tree(a)
    for k in range(len(KINDS)):
        rows = held & (x[:, 0] == k)
        r, t = model.raw(x[rows]), y[rows]
        if t.sum() < MIN_SUPPORT:
            continue
        w = np.array([1.0, 0.0])
        design = np.stack([r, np.ones_like(r)], axis=1)
        for _ in range(20):  # Platt scaling, towards slope 1
            q = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
            hess = (design * (q * (1 - q))[:, None]).T @ design + np.eye(2)
            w = w + np.linalg.solve(hess, design.T @ (t - q) - (w - [1.0, 0.0]))
        model.slope[k], model.shift[k] = w
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        order = np.argsort(-p)
        right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(right >= PRECISION)
        if len(good):
            model.threshold[k] = max(0.9, p[order][good[-1]])
    return model


def _free(span: Span, base: list[Span], starts: list[int], reach: list[int]) -> bool:
    """Whether a span touches no base span; reach is the running largest end."""
    i = bisect_left(starts, span[2])
    return i == 0 or reach[i - 1] <= span[0]


def find_spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) in order of start, then kind."""
    if not text:
        return [], []
    base, more = base_spans(text), proposals(text)
    starts, reach = [s[0] for s in base], []
    for s in base:
        reach.append(max(s[2], reach[-1] if reach else 0))
    more = [s for s in more if _free(s, base, starts, reach)]
    if not more:
        return base, base
    x = np.array([features(s, text[s[0] : s[2]], text[max(0, s[0] - 24) : s[0]], text[s[2] : s[2] + 4]) for s in more])
    p = model.probability(x)
    kept: list[Span] = []  # in order, apart from each other
    for i in np.lexsort((np.arange(len(more)), -p)):  # surest first, no overlaps among the added
        s = more[i]
        if p[i] >= model.threshold[KINDS.index(s[1])]:
            j = bisect_left(kept, s)
            if (j == 0 or kept[j - 1][2] <= s[0]) and (j == len(kept) or s[2] <= kept[j][0]):
                kept.insert(j, s)
    return base, sorted(base + kept, key=lambda s: (s[0], KINDS.index(s[1])))


def examples(text: str | None) -> list[tuple[list[float], float]]:
    """Training rows of a text, at most PER_DOCUMENT."""
    out: list[tuple[list[float], float]] = []
    if not text:
        return out
    base = base_spans(text)
    taken = {(s, e) for s, _, e in base}

    def add(span: Span, own: str, end: int, y: float) -> None:
        out.append((features(span, own, text[max(0, span[0] - 24) : span[0]], text[end : end + 4]), y))

    for s in base[: PER_DOCUMENT // 5]:
        own = text[s[0] : s[2]]
        add(s, own, s[2], 1.0)
        for t, spelled in loosened(s, own):
            add(t, spelled, s[2], 1.0)
    for s in proposals(text)[:PER_DOCUMENT]:
        if (s[0], s[2]) not in taken and not any(s[0] < e and b < s[2] for b, e in taken):
            add(s, text[s[0] : s[2]], s[2], 0.0)
    return out[:PER_DOCUMENT]


def train(docs: DataFrame) -> Model:
    """Fit on about SAMPLE documents, drawn by a hash of the id."""
    rate = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_003)) / 1_000_003.0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(d, x, y) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x, y in examples(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.list_(pa.float64()), pa.float64()))], ["doc_id", "x", "y"]
            )

    sample = docs.where(drawn < rate).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = sample.mapInArrow(run, "doc_id long, x array<double>, y double").collect()
    rows.sort(key=lambda r: (_mixed(r["doc_id"]), r["x"], r["y"]))
    return fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])) if rows else Model()


def _mixed(x: int | None) -> int:
    return hash((x or 0) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_<kind> of the base spans, base_sha256, spans.

    spans are kind:start:end in code points, by start, then kind; base_sha256 is the
    SHA-256 of the base ones so joined. Null and empty texts have none; texts of any
    length are searched whole; of overlapping added spans the surest stays, of equally
    sure ones the first proposed; repeated rows and null doc_ids stay; further columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(it, 1):
            found = [find_spans(t, shared.value) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([listed(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            )

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redacted(text: str | None, model: Model) -> str | None:
    """The text with every span replaced by its kind; overlapping spans by the first's."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in find_spans(text, model)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with spans of `text` replaced and n_chars, if there, set to the new length.

    All other columns and all rows stay as they are; null and empty texts stay null and
    empty; texts of any length are searched whole; of spans that overlap the first one's kind
    stands for both, of two that start together the kind listed first; repeated rows are
    redacted alike; columns of any name pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(it, "text"):
            i = b.schema.get_field_index("text")
            text = [redacted(t, shared.value) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i).with_nullable(True), pa.array(text, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
