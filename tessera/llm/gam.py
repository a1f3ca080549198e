"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features: round after round, each feature in turn
gets a tree of at most three leaves fitted to the current residuals, and its leaves are added to
that feature's lookup table; then the pairs that promise most do the same with trees of four
leaves. A text's score is the logistic of a sum of table entries, read for whole batches at once.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

#: Most labelled rows used for fitting: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, MIN_ROWS = 32, 8, 8, 150, 60, 0.15, 4
THRESHOLD = 0.3

FEATURES = (
    "log_chars log_words word_length distinct_words adjacent_repeats upper_words top_word symbols stops exclaims digits "
    "upper_chars bars repeated_lines words_per_line non_ascii lower_start long_words"
).split()
_CLASSES = {"symbols": b"#$%&*@^~<>{}[]\\=_+/", "stops": b".,;:", "exclaims": b"!?", "digits": b"0123456789", "upper_chars": bytes(range(65, 91)), "bars": b"|"}
_LONG = re.compile(r"\S{25,}")


def features(text: str | None) -> list[float]:
    """Counts and shares over the whole text; null and empty texts have all zeros."""
    text = text or ""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    lines = text.split("\n")
    counts = Counter(words)
    share = {k: (len(raw) - len(raw.translate(None, c))) / len(raw) for k, c in _CLASSES.items()}
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        sum(map(len, words)) / m,
        len(counts) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        sum(map(str.isupper, words)) / m,
        max(counts.values()) / m,
        share["symbols"],
        share["stops"],
        share["exclaims"],
        share["digits"],
        share["upper_chars"],
        share["bars"],
        1 - len(set(lines)) / len(lines),
        float(np.log1p(m / len(lines))),
        (len(raw) - n) / n,
        sum(map(str.islower, words)) / m,
        len(_LONG.findall(text)) / m,
    ]


@dataclass
class Gam:
    """Lookup tables: edges[j] cut feature j into bins; bias and tables are in log-odds."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts halfway between different neighbouring quantiles."""
    v = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="nearest"))
    v = np.unique(x) if len(np.unique(x)) <= bins else v
    return (v[:-1] + v[1:]) / 2


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The steps, per bin, of the best tree of three leaves or fewer over ordered bins."""
    G, H, N = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    b = len(g)
    gain = lambda a, c: (G[c] - G[a]) ** 2 / (H[c] - H[a] + 1)
    best, cuts = gain(0, b) + 1e-9, (0, b)
    one = np.arange(1, b)
    if len(one):
        p, q = (m.ravel() for m in np.meshgrid(one, np.arange(1, b + 1), indexing="ij"))
        ok = (q > p) & (N[p] >= MIN_ROWS) & (N[q] - N[p] >= MIN_ROWS) & ((q == b) | (N[b] - N[q] >= MIN_ROWS))
        p, q = p[ok], q[ok]
        if len(p):
            total = gain(0, p) + gain(p, q) + np.where(q < b, gain(q, b), 0)
            k = int(np.argmax(total))
            if total[k] > best:
                cuts = (0, int(p[k]), int(q[k]), b) if q[k] < b else (0, int(p[k]), b)
    step = np.zeros(b)
    for a, c in zip(cuts, cuts[1:]):
        step[a:c] = (G[c] - G[a]) / (H[c] - H[a] + 1)
    return step


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a table at one row and one column."""
    G, H = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, step = 0.0, np.zeros(g.shape)
    for p in range(1, g.shape[0]):
        for q in range(1, g.shape[1]):
            parts = [(slice(0, p), slice(0, q)), (slice(0, p), slice(q, None)), (slice(p, None), slice(0, q)), (slice(p, None), slice(q, None))]
            gs = [G[p, q], G[p, -1] - G[p, q], G[-1, q] - G[p, q], G[-1, -1] - G[p, -1] - G[-1, q] + G[p, q]]
            hs = [H[p, q], H[p, -1] - H[p, q], H[-1, q] - H[p, q], H[-1, -1] - H[p, -1] - H[-1, q] + H[p, q]]
            gain = sum(a * a / (b + 1) for a, b in zip(gs, hs, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
            if gain > best:
                best, step = gain, np.zeros(g.shape)
                for at, a, b in zip(parts, gs, hs, strict=True):
                    step[at] = a / (b + 1)
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit on rows x and labels y (0 or 1). Without rows of both kinds, scores are constant."""
    d = len(FEATURES)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
        return Gam(float(np.clip(np.log((p + 1e-6) / (1 - p + 1e-6)), -8, 8)), [np.array([])] * d, [np.zeros(1)] * d)
    edges = [_edges(x[:, j], BINS) for j in range(d)]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p = y.mean()
    model = Gam(float(np.log(p / (1 - p))), edges, tables)
    z = np.full(len(y), model.bias)
    sizes = [np.bincount(a, minlength=len(t)) for a, t in zip(at, tables, strict=True)]
    for _ in range(ROUNDS):
        for j in range(d):
            if len(tables[j]) < 2:
                continue
            s = 1 / (1 + np.exp(-z))
            n = len(tables[j])
            step = RATE * _tree(np.bincount(at[j], y - s, n), np.bincount(at[j], s * (1 - s), n), sizes[j])
            tables[j] += step
            z += step[at[j]]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        s, key = 1 / (1 + np.exp(-z)), low[i] * shape[1] + low[j]
        return tuple(np.bincount(key, w, shape[0] * shape[1]).reshape(shape) for w in (y - s, s * (1 - s)))

    gains = sorted(((_quarters(*sums(i, j))[0], i, j) for i, j in combinations(range(d), 2)), reverse=True)[:PAIRS]
    model.pairs = [(i, j) for gain, i, j in gains if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _quarters(*sums(i, j))[1]
            t += step
            z += step[low[i], low[j]]
    return model


def held_out() -> F.Column:
    """Rows never learnt from: crc32 of the id as text is a multiple of 5, or the id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Gam:
    """Fit on at most MAX_TRAIN labelled rows outside the held-out fold; null labels are ignored."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MAX_TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id")  # MAX_TRAIN rows of two numbers at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = rows.select("doc_id", "text", "y").mapInArrow(work, "doc_id long, y int, x array<double>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(MAX_TRAIN).collect()
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], dtype=float))


def scores(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts are scored too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns: no shuffle."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(work, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Train on labels, score all of docs. Repeated rows get equal results, an empty table none;
    columns other than the id and the text are not looked at."""
    return scores(docs, train(docs, labels, text), text)
