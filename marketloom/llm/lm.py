"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, P(w | c) = (count(c w) + m P(w | c')) / (count(c) + m),
c' being the context without its first word. Read as an automaton, a context seen in training is a
state, a seen n-gram an arc with its log-probability, and every state has a failure arc to the shorter
context with weight log(m / (count(c) + m)). One pass from left to right carries the state and adds
the weights; a word without an arc falls back along failure arcs.

The model grows with the corpus, so it is never gathered. Documents are dealt into blocks. A block
lists the distinct n-grams of its texts, as hashes, with its own counts; they meet the other blocks'
lists in tasks that own a range of hashes, and the totals come back in the order of the list, without
the keys. With them a block builds just the states and arcs that its texts can reach, and walks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches, stage

# Local ids of the two words that no text can contain.
_START, _END = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """The n-grams of one block. Level 0 has the words; level k its n-grams of k+1 words.

    ``ids[k][i]``: n-gram of level k that ends at token i, -1 where it would begin before the text.
    ``parts[k]``: (context at level k-1, last word) of each n-gram. ``own[k]``: times it ends in a
    training document.
    """

    def __init__(self, tokens: np.ndarray, begins: np.ndarray, trains: np.ndarray, words: np.ndarray, order: int):
        self.tokens = tokens
        self.hashes = [words]
        self.ids = [tokens]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.own = [np.bincount(tokens, trains, len(words)).astype(np.int64)]
        for level in range(1, order):
            before = self.ids[-1]
            known = np.flatnonzero(~begins[: len(tokens)])
            known = known[before[known - 1] >= 0]
            pairs = before[known - 1].astype(np.int64) << 32 | tokens[known]
            distinct, where = np.unique(pairs, return_inverse=True)
            context, word = distinct >> 32, distinct & 0xFFFFFFFF
            ids = np.full(len(tokens), -1, np.int64)
            ids[known] = where
            self.ids.append(ids)
            self.parts.append((context, word))
            with np.errstate(over="ignore"):
                self.hashes.append(_mixed(self.hashes[-1][context] * _MIX + words[word] + np.uint64(level)))
            self.own.append(np.bincount(where, trains[known], len(distinct)).astype(np.int64))


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block: local ids of all tokens, where texts begin, and hashes of the distinct words.

    A text is its start mark, its words with A-Z lower-cased, and one end.
    """
    ids: defaultdict[bytes, int] = defaultdict(count(2).__next__)
    seqs, begins = [], [0]
    for t in texts:
        words = (t or "").encode().lower().split()
        seq = np.empty(len(words) + 2, np.int32)
        seq[0], seq[-1] = _START, _END
        seq[1:-1] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        seqs.append(seq)
        begins.append(begins[-1] + len(seq))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(b" start"), h64(b" end"), *map(h64, ids)], np.uint64)
    return np.concatenate(seqs), np.array(begins), hashes


def _block_columns() -> str:
    return "block bigint, n bigint, ids array<bigint>, train array<boolean>, tokens binary, begins binary, words binary"


def blocks_of(docs: DataFrame, *, doc_id: str, text: str, train: Column, block_tokens: int) -> DataFrame:
    """One row for each block of consecutive documents with about ``block_tokens`` tokens.

    A longer document is a block of its own.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), train.alias("train"), F.col(text).alias("text"), F.spark_partition_id().alias("part")
    )

    def row(block: int, ids: list, train_: list, texts: list) -> pa.RecordBatch:
        tokens, begins, words = encode(texts)
        pack = pa.Codec("zstd", 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train_], pa.list_(pa.bool_())),
                pa.array([_squeeze(tokens, pack)], pa.binary()), pa.array([begins.astype(np.int64).tobytes()], pa.binary()),
                pa.array([words.tobytes()], pa.binary()),
            ],
            names=["block", "n", "ids", "train", "tokens", "begins", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        train_: list = []
        texts: list = []
        size, number, part = 0, 0, 0
        for b in batches:
            for i, t, x, p in zip(*(b.column(k) for k in range(4))):
                part = p.as_py()
                ids.append(i.as_py())
                train_.append(t.as_py())
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size >= 6 * block_tokens:
                    yield row((part << 32) + number, ids, train_, texts)
                    ids, train_, texts, size, number = [], [], [], 0, number + 1
        if texts:
            yield row((part << 32) + number, ids, train_, texts)

    return rows.mapInArrow(run, _block_columns())


def _squeeze(a: np.ndarray, codec: pa.Codec) -> bytes:
    """Integers as byte planes, compressed; the high planes are mostly zero."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(8, "little") + codec.compress(np.ascontiguousarray(planes).tobytes()).to_pybytes()


def _unsqueeze(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.Codec("zstd").decompress(b[8:], n * size)
    planes = np.frombuffer(raw, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _grams_of(ids: list, train: list, tokens: bytes, begins: bytes, words: bytes | None, order: int) -> tuple[Grams, np.ndarray]:
    t = _unsqueeze(tokens, np.int32)
    at = np.frombuffer(begins, np.int64)
    first = np.zeros(len(t), bool)
    first[at[:-1]] = True
    trains = np.repeat(np.array(train, float), np.diff(at))
    n = int(t.max()) + 1
    hashes = np.frombuffer(words, np.uint64) if words is not None else np.zeros(n, np.uint64)
    return Grams(t, first, trains, hashes, order), at


def _listed(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's n-grams on the way: by owner (the top bits), then hash; and the bounds of the owners."""
    order = np.argsort(hashes, kind="stable")
    shift = np.uint64(64 - parts.bit_length() + 1)
    owner = (hashes[order] >> shift) if parts > 1 else np.zeros(len(order), np.uint64)
    return order, np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))


def _delta(a: np.ndarray) -> bytes:
    """Sorted 64-bit values as six low bytes of their differences; wider differences apart."""
    d = np.diff(a, prepend=np.uint64(0))
    wide = d >> np.uint64(48)
    planes = d.view(np.uint8).reshape(-1, 8)
    odd = np.flatnonzero(wide)
    head = len(a).to_bytes(8, "little") + len(odd).to_bytes(8, "little")
    high = wide[odd].astype(np.uint16).tobytes()
    return head + odd.astype(np.uint32).tobytes() + high + np.ascontiguousarray(planes[:, :6]).tobytes()


def _undelta(b: bytes) -> np.ndarray:
    n, m = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little")
    odd = np.frombuffer(b, np.uint32, m, 16)
    high = np.frombuffer(b, np.uint16, m, 16 + 4 * m)
    d = np.zeros((n, 8), np.uint8)
    d[:, :6] = np.frombuffer(b, np.uint8, 6 * n, 16 + 6 * m).reshape(n, 6)
    d = d.reshape(-1).view(np.uint64)
    d[odd] |= high.astype(np.uint64) << np.uint64(48)
    return np.cumsum(d, dtype=np.uint64)


class Automaton:
    """States, arcs and failure arcs that one block can reach.

    A state is (level, id): the root at level 0, else the n-gram of ``level`` words that was read last.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], train_tokens: int, vocabulary: int, mass: float, add: float):
        order = len(grams.ids)
        self.order = order
        base = (totals[0] + add) / (train_tokens + add * (vocabulary + 1))
        self.base = np.log10(base)
        prob = [base]
        self.back: list[np.ndarray] = []
        # Suffix of each n-gram: the same words without the first. Words have the root.
        self.fail = [np.zeros(len(base), np.int64)]
        arcs: list[dict[int, int]] = []
        for level in range(1, order):
            context, word = grams.parts[level]
            if level == 1:
                suffix = word
            else:
                lower = {k: i for i, k in enumerate((grams.parts[level - 1][0] << 32 | grams.parts[level - 1][1]).tolist())}
                keys = self.fail[level - 1][context] << 32 | word
                suffix = np.array([lower[k] for k in keys.tolist()], np.int64)
            self.fail.append(suffix)
            seen = totals[level - 1][context]
            prob.append((totals[level] + mass * prob[level - 1][suffix]) / (seen + mass))
            self.back.append(np.log10(mass / (totals[level - 1] + mass)))
            there = np.flatnonzero(totals[level])
            arcs.append(dict(zip((context[there] << 32 | word[there]).tolist(), there.tolist())))
        self.arcs = arcs
        self.log = [np.log10(p).tolist() for p in prob]
        self.back_list = [b.tolist() for b in self.back]
        self.fail_list = [f.tolist() for f in self.fail]

    def walk(self, words: list[int]) -> float:
        """Log10 probability of a text, given as start mark, words, end."""
        if self.order == 1:
            return math.fsum(self.log[0][w] for w in words[1:])
        arcs, logs, back, fail, top = self.arcs, self.log, self.back_list, self.fail_list, self.order - 1
        total, level, state = 0.0, 1, words[0]
        for w in words[1:]:
            while level:
                arc = arcs[level - 1].get(state << 32 | w)
                if arc is not None:
                    break
                total += back[level - 1][state]
                state = fail[level - 1][state]
                level -= 1
            if level:
                total += logs[level][arc]
                if level < top:
                    level, state = level + 1, arc
                else:
                    state = fail[level][arc]
            else:
                total += logs[0][w]
                level, state = 1, w
        return total


def score(
    docs: DataFrame,
    train: Column,
    *,
    order: int = 2,
    mass: float = 100.0,
    add: float = 0.1,
    block_tokens: int = 1_000_000,
    range_tokens: int = 1 << 21,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores every document with a model of the documents where ``train`` holds.

    Returns ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``. Tokens are the words,
    A-Z lower-cased, and one end; n_known are those seen in training. base_score takes words one by one with ``add`` smoothing,
    score is the automaton's, both in log10. ``mass`` is m above. A task that adds up counts
    owns one of as many hash ranges as the corpus has ``range_tokens``, rounded up to a power of two.

    Null or empty text: only the end. Null train: not in training. No training document at all: every word is equally unlikely. Repeated rows and ids: each
    row is scored, and counts if in training. Empty table: empty result.
    """
    blocks = stage(
        blocks_of(docs, doc_id=doc_id, text=text, train=F.coalesce(train, F.lit(False)), block_tokens=block_tokens), "lm_blocks"
    )

    tokens_in_all = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 << max(0, math.ceil(math.log2(max(1, tokens_in_all) / range_tokens)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                grams, _ = _grams_of(r["ids"], r["train"], r["tokens"], r["begins"], r["words"], order)
                rows = []
                for level in range(order):
                    at, bounds = _listed(grams.hashes[level], parts)
                    keys, own = grams.hashes[level][at], grams.own[level][at]
                    codec = pa.Codec("zstd", 1)
                    for p in range(parts):
                        i, j = bounds[p], bounds[p + 1]
                        if i < j:
                            rows.append((level * parts + p, r["block"], _delta(keys[i:j]), _squeeze(own[i:j], codec)))
                columns = list(zip(*rows))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["owner", "block", "keys", "own"]
                )

    def total(t: pa.Table) -> pa.Table:
        """Totals of one hash range over all blocks, given back to each block in its own order."""
        owner = t.column("owner")[0].as_py()
        lists = [_undelta(k.as_py()) for k in t.column("keys")]
        own = [_unsqueeze(c.as_py(), np.int64) for c in t.column("own")]
        distinct, where = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(where, np.concatenate(own), len(distinct)).astype(np.int64)
        out, at, codec = [], 0, pa.Codec("zstd", 1)
        for keys in lists:
            out.append(_squeeze(sums[where[at : at + len(keys)]], codec))
            at += len(keys)
        blocks_ = t.column("block").to_pylist()
        # Words of training, without the start mark: tokens and types, on the first row only.
        tokens = types = 0
        if owner < parts:
            start = np.uint64(xxhash.xxh64_intdigest(b" start"))
            words = distinct != start
            tokens, types = int(sums[words].sum()), int(np.count_nonzero(sums[words]))
        zeros = [0] * (len(out) - 1)
        return pa.table(
            {
                "owner": pa.array([owner] * len(out), pa.int32()), "block": pa.array(blocks_, pa.int64()),
                "sums": pa.array(out, pa.binary()), "tokens": pa.array([tokens, *zeros], pa.int64()),
                "types": pa.array([types, *zeros], pa.int64()),
            }
        )

    sent = blocks.select("block", "ids", "train", "tokens", "begins", "words").mapInArrow(
        send, "owner int, block bigint, keys binary, own binary"
    )
    back = stage(
        sent.groupBy("owner").applyInArrow(total, "owner int, block bigint, sums binary, tokens bigint, types bigint"), "lm_totals"
    )
    n_train, n_types = back.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    out = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def walk(block: pa.Table, sums: pa.Table) -> pa.Table:
        result: list[tuple] = []
        answers = sorted(zip(sums.column("owner").to_pylist(), sums.column("sums")), key=lambda x: x[0])
        for r in block.to_pylist():
            grams, at = _grams_of(r["ids"], r["train"], r["tokens"], r["begins"], r["words"], order)
            totals = []
            for level in range(order):
                place, _ = _listed(grams.hashes[level], parts)
                got = [_unsqueeze(s.as_py(), np.int64) for o, s in answers if o // parts == level]
                counts = np.zeros(len(place), np.int64)
                counts[place] = np.concatenate(got) if got else 0
                totals.append(counts)
            machine = Automaton(grams, totals, n_train, n_types, mass, add)
            known = totals[0] > 0
            for i, (doc, train_) in enumerate(zip(r["ids"], r["train"])):
                words = grams.tokens[at[i] : at[i + 1]]
                base = math.fsum(machine.base[words[1:]].tolist())
                result.append(
                    (doc, train_, len(words) - 1, int(known[words[1:]].sum()), n_train, base, machine.walk(words.tolist()))
                )
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = list(zip(*result)) if result else [[] for _ in kinds]
        names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    return blocks.groupBy("block").cogroup(back.select("owner", "block", "sums").groupBy("block")).applyInArrow(walk, out)
