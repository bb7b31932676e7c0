"""Quality classifier: an additive model with pairwise interactions.

Each numeric feature of a text is cut into bins. Cyclic boosting visits the features in turn and adds a shallow tree
on one feature's bins to that feature's lookup table; then the pairs with the largest gain get two-way tables, boosted
in the same way with trees that split once on each feature. A score is the sum of table entries, one per feature and pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, slices, small_or_not, staged, table, texts
from .toxicity import held_out, labelled

FEATURES = (
    "log_words", "word_length", "symbols_per_word", "symbol_kinds", "letter_share", "upper_share", "digit_share", "punctuation_share",
    "marked_words", "lines", "line_words", "duplicate_lines", "ended_lines", "distinct_words", "commonest_word", "short_words", "repeated_triples",
)
THRESHOLD = 0.3
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>!=~^@_{}[]\\/+"
_WORD_MARK = regex.compile(r"\p{L}[.,;:]?[^\p{L}\p{N}\s.,;:'’\-)\"»]+(?=\s|$)")


def features(text: str) -> list[float]:
    """The values of FEATURES for a whole text; an empty one has zeros."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total, chars = len(data), len(text)
    space = counts[[9, 10, 11, 12, 13, 32]].sum()
    seen = max(total - space, 1)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    wide = counts[128:].sum()
    symbols = counts[_SYMBOL_CODES]
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    of_word = Counter(words)
    # triples of equal words: identity by position of first use
    first = {w: i for i, w in enumerate(of_word)}
    at = np.fromiter((first[w] for w in words), np.int64, n)
    repeated = 0.0
    if n > 3:
        k = (at[:-2] * len(first) + at[1:-1]) * len(first) + at[2:]
        repeated = 1 - len(np.unique(k)) / len(k)
    marked = len(_WORD_MARK.findall(text))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), chars / n, float(symbols.sum()) / n, float((symbols > 0).sum()), float(upper + lower + wide) / seen,
        float(upper) / max(upper + lower, 1), float(counts[48:58].sum()) / seen, float(counts[[33, 44, 46, 58, 59, 63]].sum()) / n,
        marked / n, float(len(lines)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(x.rstrip(_SPACE)[-1:] in ".!?" for x in lines) / max(len(lines), 1), len(of_word) / n, max(of_word.values()) / n,
        float((lengths <= 3).mean()), repeated,
    ]


_SYMBOL_CODES = [ord(c) for c in _SYMBOLS]


@dataclass
class AdditiveModel:
    """intercept + tables[j][bin of feature j] + pairs[(j, k)][coarse bin of j, coarse bin of k]."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    intercept: float = 0.0
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def coarse_bins(self, b: np.ndarray) -> np.ndarray:
        width = np.array([len(e) + 1 for e in self.edges])
        return b * np.minimum(self.coarse, width) // width

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        c = self.coarse_bins(b)
        for (j, k), t in self.pairs.items():
            z += t[c[:, j], c[:, k]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Leaf value per bin of the best tree of that depth on one ordered feature, from sums of gradients by bin."""
    whole = -g.sum() / (h.sum() + l2)
    if not depth or len(g) < 2:
        return np.full(len(g), whole)
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 1e-3) & (hr > 1e-3), gl**2 / (hl + l2) + gr**2 / (hr + l2), -np.inf)
    cut = int(np.argmax(gain)) + 1
    if not gain[cut - 1] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
        return np.full(len(g), whole)
    return np.concatenate((_tree(g[:cut], h[:cut], depth - 1, l2), _tree(g[cut:], h[cut:], depth - 1, l2)))


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best four leaves: one cut on each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            q = [(cg[a - 1, b - 1], ch[a - 1, b - 1]), (cg[a - 1, -1] - cg[a - 1, b - 1], ch[a - 1, -1] - ch[a - 1, b - 1])]
            q += [(cg[-1, b - 1] - cg[a - 1, b - 1], ch[-1, b - 1] - ch[a - 1, b - 1])]
            q += [(cg[-1, -1] - sum(x[0] for x in q), ch[-1, -1] - sum(x[1] for x in q))]
            gain = sum(x * x / (y + l2) for x, y in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)
            if gain > best:
                best = gain
                values = np.empty_like(g)
                v = [-x / (y + l2) for x, y in q]
                values[:a, :b], values[:a, b:], values[a:, :b], values[a:, b:] = v
    return best, values


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, rate: float = 0.1, depth: int = 2, n_pairs: int = 6, pair_rounds: int = 20, l2: float = 1.0) -> AdditiveModel:
    """No rows: every score is 0.5. Constant features get one bin and an empty table."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(x):
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p / (1 - p)))
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            if len(t) > 1:
                g, h = gradients()
                step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), depth, l2)
                t += step
                z += step[b[:, j]]
    c = model.coarse_bins(b)
    shape = [min(model.coarse, len(t)) for t in model.tables]

    def sums(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        cell = c[:, j] * shape[k] + c[:, k]
        return tuple(np.bincount(cell, v, shape[j] * shape[k]).reshape(shape[j], shape[k]) for v in (g, h))

    ranked = sorted(((_quadrants(*sums(j, k), l2)[0], j, k) for j in range(width) for k in range(j) if shape[j] > 1 and shape[k] > 1), reverse=True)
    chosen = [(j, k) for gain, j, k in ranked[:n_pairs] if gain > 1]
    model.pairs = {x: np.zeros((shape[x[0]], shape[x[1]])) for x in chosen}
    for _ in range(pair_rounds):
        for (j, k), t in model.pairs.items():
            step = rate * _quadrants(*sums(j, k), l2)[1]
            t += step
            z += step[c[:, j], c[:, k]]
    return model


def _rows(values: list[list[float]]) -> np.ndarray:
    return np.array(values, float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """Fits on about ``max_rows`` labelled documents at most (the documented bound), by features of their whole texts."""
    chosen = labelled(labels, "quality", 5, 0, max_rows)
    rows = chosen.count()
    sample = docs.select("doc_id", F.col("text").cast("string")).join(small_or_not(chosen, rows), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([features(t) for t in texts(b.column("text"))], pa.list_(pa.float64()))], ["y", "x"])

    got = staged(sample.mapInArrow(run, "y int, x array<double>"), "quality-sample").toArrow()
    x, y = _rows(got["x"].to_pylist()), np.array(got["y"].to_pylist(), float)
    order = np.lexsort((*x.T[::-1], y))  # the bounded sample in an order of its own, so that reruns agree
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with quality (double), the score of each whole text; null and empty texts score as zeros in every feature."""
    kept = [c for c in docs.columns if c != "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(_rows([features(t) for t in texts(b.column("text"))]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64())], [*kept, "quality"])

    docs = docs.select(*kept)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality", DoubleType())]))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document. Null doc_ids are never held out; null and empty texts have zeros as features."""
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", F.col("text").cast("string")), model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))
