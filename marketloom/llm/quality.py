"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed in Spark tasks over whole texts. Trees are fitted in numpy on a sample of
labelled documents of bounded size, flattened into arrays and sent along with the scoring tasks, where
a batch of documents descends all trees at once.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches

FEATURES = (
    "log_bytes", "log_words", "word_len", "distinct_words", "repeated_words", "longest_word", "lines",
    "distinct_lines", "line_len", "upper", "lower", "digits", "space", "high_bytes", "exclaim", "pipe",
    "stops", "commas", "brackets", "quotes", "symbols", "control",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars)] = 1
    return t


_CLASSES = np.stack(
    [
        _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(b" \t\n\r\x0b\x0c"),
        _table(bytes(range(128, 256))), _table(b"!"), _table(b"|"), _table(b".?"), _table(b",;:"), _table(b"()[]{}<>"),
        _table(b"\"'`"), _table(b"#$%&*+-/=@\\^_~"), _table(bytes([*range(0, 9), *range(14, 32), 127])),
    ],
    axis=1,
)


def statistics(text: str | None) -> list[float]:
    """The features of one whole text. Null and empty: all zero."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    words = raw.split()
    lines = raw.split(b"\n")
    n, m = len(raw), max(1, len(words))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    again = sum(map(operator.eq, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, len(set(words)) / m, again / m,
        np.log1p(max(map(len, words), default=0)), np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), *shares,
    ]


@dataclass
class Forest:
    """Complete binary trees in heap order: children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray  # tree x inner node
    cut: np.ndarray  # tree x inner node; right if above
    leaf: np.ndarray  # tree x leaf
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.leaf))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(self.depth):
            right = x[row, self.feature[tree, node]] > self.cut[tree, node]
            node = 2 * node + 1 + right
        inner = self.feature.shape[1]
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0
) -> Forest:
    """Boosts on the logistic loss. Labels may be fractions. One class only, or no rows: a constant."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        none = np.zeros((0, inner))
        return Forest(none.astype(int), none, np.zeros((0, inner + 1)), float(np.log(share / (1 - share))), depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    width = max(len(e) for e in edges) + 1
    n, p = x.shape
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    feature = np.zeros((trees, inner), int)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, int)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            split = np.zeros((count, 2), int)
            split[:, 1] = -1
            for f in range(p):
                at = (node - first) * width + binned[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < 1) | (ha - hs < 1)] = -np.inf
                gain[:, len(edges[f]) :] = -np.inf
                b = gain.argmax(axis=1)
                value = gain[np.arange(count), b]
                better = value > best
                best[better] = value[better]
                split[better, 0], split[better, 1] = f, b[better]
            for k in range(count):
                f, b = split[k]
                if b >= 0:
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        gl, hl = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf[t] = -rate * gl / (hl + ridge)
        raw += leaf[t][at]
    return Forest(feature, cut, leaf, base, depth)


def _with_statistics(rows: DataFrame) -> DataFrame:
    """``__row, __text`` to ``__row, x``."""
    schema = rows.select("__row", F.array().cast("array<double>").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["__row", "x"])

    return rows.mapInArrow(run, schema)


def sampled(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows, all if there are no more: those whose key hashes low. The same key is in or
    out wherever it is."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    max_rows: int = 20_000,
    **options,
) -> Forest:
    """Fits on the labelled documents, a hashed sample of about ``max_rows`` of them if there are more.

    Rows without id or label are skipped; several labels of one id count as their mean, several
    documents of one id as one of them.
    """
    bounded_batches(docs.sparkSession)
    marked = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL")
        .groupBy("id")
        .agg(F.avg("y").alias("y"))
    )
    chosen = sampled(marked, F.col("id"), max_rows)
    # At most about max_rows pairs of id and label.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "id")
    measured = _with_statistics(rows.select(F.struct("id", "y").alias("__row"), "__text"))
    found = measured.groupBy("__row").agg(F.min("x").alias("x")).select("__row.*", "x").toPandas().sort_values("id")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    return fit(x, found["y"].to_numpy(float), **options)


def score(docs: DataFrame, model: Forest, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``__row`` (the document's columns), ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    Null or empty text: scored as a document whose statistics are all zero. Nulls elsewhere, repeated rows and columns of any name: each row is
    returned with its own columns. Empty table: empty result.
    """
    bounded_batches(docs.sparkSession)

    def probability(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    # Only the text goes to Python and only the score comes back.
    scored = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.arrow_udf(probability, "double")(F.col(f"`{text}`")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
