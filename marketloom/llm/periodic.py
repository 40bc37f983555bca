"""Maximal periodic runs of words by block convolution.

A run with period q is a stretch that holds at least three periods and 24 words. At scale L (8, 16, 32, ...) a document is
cut into blocks of L words. Every run with a period from L to 2L - 1 (1 to 15 at scale 8) holds a whole block and its
copy q words later: words that equal those q later number at least 2q, 15 at least, and any 2L - 1 words in a row hold a
block. So each block is laid over the words that follow it. The sum of squared differences of word numbers at every
distance is a convolution, taken by number-theoretic transforms over integers; it is exact, as the product of the primes
used exceeds the largest possible sum. Zero means that the block occurs again there. Such distances seed extensions to
both sides, which compare words; what is long enough is a run.

Distances are taken in ascending order. A stretch with a distance that is a multiple of its period has been found with
the period before, with the same borders.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches

PRIMES = ((998244353, 3), (469762049, 3), (167772161, 3))
"""Primes below 2^30 with a primitive root: 2^23, 2^26 and 2^25 divide them less one."""

MIN_WORDS, MIN_PERIODS, FIRST_SCALE = 24, 3, 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_CHUNK = 1 << 16
_U = np.uint64


@functools.lru_cache(64)
def _roots(n: int, p: int, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an n-th root of unity and their inverses, in bit-reversed order, n / 2 of each."""
    w = pow(g, (p - 1) // n, p)
    out = []
    for base in (w, pow(w, p - 2, p)):
        # Bit-reversed exponents double up: each half repeats the former with n / 4, n / 8, ... added.
        powers, step = np.ones(1, _U), n // 4
        while len(powers) < n // 2:
            powers = np.concatenate([powers, powers * _U(pow(base, step, p)) % _U(p)])
            step //= 2
        out.append(powers[:, None, None])
    return out[0], out[1]


def _reduce(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - x // p * p


def transform(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transform along the first axis, natural to bit-reversed order; not fully reduced. x: below p, shape (n, b)."""
    n, b = x.shape
    roots, q = _roots(n, p, g)[0], _U(p)
    m, h, bound = 1, n // 2, 1
    while h:
        v = x.reshape(m, 2, h, b)
        low = v[:, 0]
        t = v[:, 1] if m == 1 else _reduce(v[:, 1] * roots[:m], q)
        nxt = np.empty_like(v)
        np.add(low, t, out=nxt[:, 0])
        np.add(low, q - t, out=nxt[:, 1])
        x, m, h, bound = nxt.reshape(n, b), m * 2, h // 2, bound + 1
        if bound > 14:  # a further product would pass 2^64
            x, bound = _reduce(x, q), 1
    return _reduce(x, q)


def inverse(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """n times the inverse of ``transform``, below p."""
    n, b = x.shape
    roots, q = _roots(n, p, g)[1], _U(p)
    m, h, bound = n // 2, 1, 1
    while m:
        v = x.reshape(m, 2, h, b)
        nxt = np.empty_like(v)
        np.add(v[:, 0], v[:, 1], out=nxt[:, 0])
        d = v[:, 0] + (q * _U(bound) - v[:, 1])
        nxt[:, 1] = _reduce(d, q) if m == 1 else _reduce(d * roots[:m], q)
        x, m, h, bound = nxt.reshape(n, b), m // 2, h * 2, bound * 2
        if bound > 4:
            x, bound = _reduce(x, q), 1
    return _reduce(x, q)


def _zero_distances(x: np.ndarray, at: np.ndarray, off: int, size: int, primes: list, squares: list) -> np.ndarray:
    """Whether block ``x[a : a + size]`` equals the words ``off + d`` later, 0 aside: shape (size, len(at)), d by row.

    Sum of squared differences = sum of squares of both sides - 2 x correlation; the correlation is cyclic of length
    2 x size, where no wanted distance wraps around.
    """
    n, steps = 2 * size, np.arange(size)[:, None]
    zero = np.ones((size, len(at)), bool)
    zero[0] = off > 0
    live = np.arange(len(at))
    for (p, g), sums in zip(primes, squares):
        a, q = at[live], _U(p)
        block = np.zeros((n, len(a)), _U)
        block[-np.arange(size) % n] = x[a[None, :] + np.arange(size)[:, None]]
        window = x[a[None, :] + (off + np.arange(n))[:, None]]
        product = _reduce(transform(block, p, g) * transform(window, p, g), q)
        twice = _reduce(_U(2) * inverse(product, p, g)[:size], q)
        both = (sums[a + size] - sums[a])[None, :] + (sums[a[None, :] + off + steps + size] - sums[a[None, :] + off + steps])
        zero[:, live] &= twice == _reduce(_reduce(both, q) * _U(n), q)
        live = live[zero[:, live].any(axis=0)]  # the next prime only confirms
        if not len(live):
            break
    return zero


def _right(x: np.ndarray, i: int, d: int, stop: int) -> int:
    """First position from i on whose word differs from that d later, or stop - d."""
    step = 32
    while i + d < stop:
        k = min(step, stop - d - i)
        differ = x[i : i + k] != x[i + d : i + d + k]
        at = int(differ.argmax())
        if differ[at]:
            return i + at
        i, step = i + k, step * 2
    return i


def _left(x: np.ndarray, i: int, d: int, start: int) -> int:
    """Smallest position from which all words up to i equal those d later."""
    step = 32
    while i > start:
        k = min(step, i - start)
        differ = (x[i - k : i] != x[i - k + d : i + d])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return i - at
        i, step = i - k, step * 2
    return i


class _Found:
    """Runs of one document; for each word the run that reaches furthest, to skip seeds inside it."""

    def __init__(self, x: np.ndarray, start: int, stop: int):
        self.x, self.start, self.stop = x, start, stop
        self.runs: dict[tuple[int, int], int] = {}
        self.until = self.period = None

    def seeds(self, at: np.ndarray, distance: np.ndarray, size: int) -> None:
        """Extend the blocks at ``at`` that occur again ``distance`` later."""
        for d in np.unique(distance).tolist():
            here = np.sort(at[distance == d])
            if self.until is not None:
                i = here - self.start
                here = here[(self.until[i] < i + size + d) | (d % self.period[i] != 0)]
            done = -1
            for b in here.tolist():
                if b < done:
                    continue
                done = _right(self.x, b + size, d, self.stop)
                self._keep(_left(self.x, b, d, self.start) - self.start, done + d - self.start, d)

    def _keep(self, s: int, e: int, d: int) -> None:
        if e - s < max(MIN_WORDS, MIN_PERIODS * d) or (s, e) in self.runs:
            return
        self.runs[s, e] = d
        if self.until is None:
            self.until = np.zeros(self.stop - self.start, np.int64)
            self.period = np.ones(self.stop - self.start, np.int64)
        further = np.flatnonzero(self.until[s:e] < e) + s
        self.until[further], self.period[further] = e, d


def runs(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each document's word numbers (from 0, by document), by start and period."""
    sizes = np.array([len(w) for w in documents], np.int64)
    if not len(sizes) or sizes.max() < MIN_WORDS:
        return [[] for _ in documents]
    stops = np.cumsum(sizes)
    starts = stops - sizes
    highest = np.array([int(w.max(initial=0)) for w in documents], np.int64)
    found: dict[int, _Found] = {}
    size = FIRST_SCALE
    while True:
        some = np.flatnonzero(sizes >= max(MIN_WORDS, MIN_PERIODS * size))
        if not len(some):
            break
        _scale(documents, some, sizes, starts, highest, size, found)
        size *= 2
    out: list[list[tuple[int, int, int]]] = []
    for i in range(len(documents)):
        of = found[i].runs if i in found else {}
        out.append(sorted((s, e - s, d) for (s, e), d in of.items()))
        out[-1].sort(key=lambda r: (r[0], r[2]))
    return out


def _scale(documents, some, sizes, starts, highest, size, found) -> None:
    n, largest = 2 * size, size * (int(highest[some].max()) + 1) ** 2
    primes, product = [], 1
    for p, g in PRIMES:
        if product <= largest and (p - 1) % n == 0:
            primes.append((p, g))
            product *= p
    if product <= largest:
        raise ValueError(f"documents of {sizes[some].max()} words are too long")
    of = sizes[some]
    ends = np.cumsum(of)
    begins = ends - of
    x = np.zeros(int(ends[-1]) + 3 * size + 1, _U)
    for i, b in zip(some.tolist(), begins.tolist()):
        x[b : b + sizes[i]] = documents[i]
    squares = []
    for p, _ in primes:
        part = x % _U(p)
        squares.append(np.concatenate([np.zeros(1, _U), np.cumsum(part * part % _U(p), dtype=_U)]))
    for off in (0, size) if size == FIRST_SCALE else (size,):
        nearest = max(off, 1)
        blocks = np.maximum((of - nearest) // size, 0)
        owner = np.repeat(np.arange(len(some)), blocks)
        at = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
        width = max(1, _CHUNK // n)
        for lo in range(0, len(at), width):
            part, doc = at[lo : lo + width], owner[lo : lo + width]
            d, k = np.nonzero(_zero_distances(x, part, off, size, primes, squares))
            distance = d + off
            fits = part[k] + distance + size <= ends[doc[k]]
            k, distance = k[fits], distance[fits]
            _extend(x, part[k], distance, doc[k], size, some, begins, ends, found)


def _extend(x, at, distance, doc, size, some, begins, ends, found) -> None:
    if not len(at):
        return
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for group in np.split(order, cuts):
        j = int(doc[group[0]])
        i = int(some[j])
        start, stop = int(begins[j]), int(ends[j])
        if i not in found:
            found[i] = _Found(x, start, stop)
        f = found[i]
        f.x, f.start, f.stop = x, start, stop
        f.seeds(at[group], distance[group], size)


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        depth[s + q] += 1
        depth[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), _U, len(words))


def find(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Runs of every document: ``__row`` (the columns but the text), ``n_words``, ``runs`` (start, length, period, by
    start and period) and ``collapsed``, the text with one period of each run.

    Words are cut at ``[\\x20\\x09-\\x0D]`` and compared byte by byte. A run holds at least 24 words and three times its
    smallest period, and no neighbouring word extends it. A word inside several runs goes if any of them holds it after
    its first period. Null, empty and blank texts: no words, no runs, an empty text. Repeated rows and null ids: each
    row stands alone. Other columns may have any name. Empty table: empty result.
    """
    bounded_batches(docs.sparkSession, 4)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    source = docs.select(row.alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    added = {"n_words": F.lit(0).cast("long"), "runs": F.lit(None).cast(RUNS), "collapsed": F.lit("")}
    schema = source.select("__row", *[c.alias(k) for k, c in added.items()]).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.as_py().encode().split() for t in batch.column(1)]
            found = runs([numbered(w) for w in words])
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0] + [len(f) for f in found])
            each = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each),
                    pa.array([collapse(w, f).decode() for w, f in zip(words, found)], pa.string()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def strongest(found: str = "runs"):
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. No run: null."""

    def order(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left != right, F.when(left > right, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1))
            .otherwise(0)
        )

    return F.try_element_at(F.array_sort(F.col(found), order), F.lit(1))
