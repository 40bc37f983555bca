"""Language identification by a convolutional network over bytes.

Filters of widths 2, 3 and 4 slide over fixed windows of bytes; each filter keeps its maximum over the
window and a softmax layer reads the maxima. As a byte is a one-hot vector, a filter is a table with a
row for each byte and offset, and a convolution is a sum of table rows. Trained in numpy on a sample of labelled
texts of bounded size; every window of every text is then scored in batches, and a text gets the
mean of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches, stage

WINDOW = 192
WIDTHS = (2, 3, 4)
_CHUNK = 64


@dataclass
class ByteConv:
    """tables[k]: row of the byte at offset k, for the filters wider than k (narrow ones come first)."""

    langs: list[str]
    per_width: int
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray
    _pairs: tuple[np.ndarray, np.ndarray] | None = None

    def _maps(self, x: np.ndarray) -> np.ndarray:
        """Filter responses at every position: window x position x filter."""
        n = x.shape[1] - max(WIDTHS) + 1
        maps = self.tables[0][x[:, :n]]
        for k, table in enumerate(self.tables[1:], 1):
            maps[:, :, self.per_width * max(0, k - 1) :] += table[x[:, k : k + n]]
        return maps

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two neighbouring bytes, added once: offsets 0 and 1, and offsets 2 and 3."""
        if self._pairs is None:
            near = self.tables[0][:, None, :] + self.tables[1][None, :, :]
            last = np.zeros((256, self.tables[2].shape[1]), np.float32)
            last[:, self.per_width :] = self.tables[3]
            far = self.tables[2][:, None, :] + last[None, :, :]
            self._pairs = near.reshape(65536, -1), far.reshape(65536, -1)
        return self._pairs

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for windows of bytes, in batches of bounded size."""
        near, far = self._pair_tables()
        n = x.shape[1] - max(WIDTHS) + 1
        parts = []
        for i in range(0, len(x), _CHUNK):
            wide = x[i : i + _CHUNK].astype(np.intp)
            pair = (wide[:, :-1] << 8) | wide[:, 1:]
            maps = np.take(near, pair[:, :n], axis=0)
            maps[:, :, self.per_width :] += np.take(far, pair[:, 2 : 2 + n], axis=0)
            while maps.shape[1] > 1:  # maximum by halves, each a pass over whole rows
                half = maps.shape[1] // 2
                low = maps[:, :half]
                np.maximum(low, maps[:, half : 2 * half], out=low)
                if maps.shape[1] % 2:
                    np.maximum(low[:, 0], maps[:, -1], out=low[:, 0])
                maps = low
            parts.append(_softmax(np.maximum(maps[:, 0] + self.bias, 0) @ self.dense + self.out))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(raw: bytes) -> np.ndarray:
    """The whole text in windows; the last one is padded with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def fit(
    x: np.ndarray, y: list[str], *, per_width: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7
) -> ByteConv:
    """Cross-entropy with Adam; the gradient of a maximum goes to its own position only."""
    langs = sorted(set(y))
    index = {v: i for i, v in enumerate(langs)}
    target = np.array([index[v] for v in y], int)
    rng = np.random.default_rng(seed)
    total = per_width * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (256, total - per_width * max(0, k - 1))).astype(np.float32) for k in range(max(WIDTHS))]
    params = [
        *tables,
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    ]
    model = ByteConv(langs, per_width, params[:4], params[4], params[5], params[6])
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb, tb = x[rows], target[rows]
            maps = model._maps(xb)
            where = maps.argmax(axis=1)
            pre = np.take_along_axis(maps, where[:, None, :], axis=1)[:, 0] + model.bias
            hidden = np.maximum(pre, 0)
            d = _softmax(hidden @ model.dense + model.out)
            d[np.arange(len(tb)), tb] -= 1
            d /= len(tb)
            back = (d @ model.dense.T) * (pre > 0)
            grads = []
            for k in range(max(WIDTHS)):
                skip = per_width * max(0, k - 1)
                g = np.zeros_like(params[k])
                byte = np.take_along_axis(xb, where[:, skip:] + k, axis=1)
                np.add.at(g, (byte, np.arange(total - skip)[None, :]), back[:, skip:])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    per_lang: int = 1000,
    max_docs: int = 64_000,
    least: int = 20,
    per_doc: int = 6,
    **options,
) -> ByteConv | None:
    """Fits on a sample of the rows of ``docs`` that have a language and a letter; None if there are none.

    Sample: about ``per_lang`` documents of every language, fewer where these would be more than ``max_docs``, but not
    below ``least``; chosen by the hash of their id, ``per_doc`` windows of each, evenly spaced over the text.
    """
    bounded_batches(docs.sparkSession)
    marked = docs.select(
        F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = stage(marked.groupBy("lang").agg(F.count("*").alias("n")), "langid_counts")
    per_lang = min(per_lang, max(least, max_docs // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    chosen = marked.join(counts, "lang").where(place < share).select("id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for t in b.column(2):
                w = windows(t.as_py().encode())
                w = w[np.unique(np.linspace(0, len(w) - 1, per_doc).astype(int))]
                parts.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.binary())], names=["id", "lang", "w"])

    schema = chosen.select("id", "lang", F.lit(b"").alias("w")).schema
    # One document of each id; ids repeat in odd data only.
    rows = chosen.mapInArrow(cut, schema).groupBy("id", "lang").agg(F.min("w").alias("w"))
    found = rows.toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "w"])
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in found["w"]]
    y = [v for v, w in zip(found["lang"], x) for _ in range(len(w))]
    return fit(np.concatenate(x), y, **options)


def predict(docs: DataFrame, model: ByteConv | None, *, text: str = "text") -> DataFrame:
    """``__row`` (the document's columns), ``lang_pred``, ``score``.

    All windows of a text count, the last by its share of real bytes; score is the mean probability of
    the language. Null text, or text without a letter: ``und`` with score 0; so is everything when
    there was nothing to learn from. Each row is returned, repeated or not; empty table: empty result.
    """
    lettered = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`"))
    bounded_batches(docs.sparkSession)

    def judge(raws: list[bytes]) -> list[tuple[str, float]]:
        cut = [windows(r) for r in raws]
        first = np.cumsum([0, *(len(w) for w in cut)])
        p = model.forward(np.concatenate(cut)).astype(float)
        weight = np.full(len(p), float(WINDOW))
        weight[first[1:] - 1] = [len(r) - WINDOW * (len(w) - 1) for r, w in zip(raws, cut)]
        sums = np.add.reduceat(p * weight[:, None], first[:-1], axis=0)
        mean = sums / np.add.reduceat(weight, first[:-1])[:, None]
        best = mean.argmax(axis=1)
        return [(model.langs[k], float(min(1.0, m[k]))) for k, m in zip(best, mean)]

    def language(texts: pa.Array) -> pa.Array:
        out = [("und", 0.0)] * len(texts)
        rows: list[int] = []
        raws: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            if model is not None and t.is_valid:
                rows.append(i)
                raws.append(t.as_py().encode())
                size += len(raws[-1])
            if raws and (size > 1_000_000 or i == len(texts) - 1):
                for k, o in zip(rows, judge(raws)):
                    out[k] = o
                rows, raws, size = [], [], 0
        return pa.StructArray.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
            names=["lang_pred", "score"],
        )

    # Only the text goes to Python and only the verdict comes back.
    judged = F.arrow_udf(language, "lang_pred string, score double")(lettered)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), judged.alias("p")).select(
        "__row", "p.lang_pred", "p.score"
    )
