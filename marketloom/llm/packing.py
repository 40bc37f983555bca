"""Packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into pieces whose lengths are powers of two: as many pieces of the limit as
fit, then the binary digits of what is left, longest first. Each piece is a sequence of its own, so no sequence crosses
documents and none is padded. Sequences of one length form a bucket; a batch is drawn from one bucket.

The job is a single pass without a shuffle: the number of a sequence is its bucket, the partition of its document and a
counter in that partition, so it is unique, and numbers in order go bucket by bucket.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches

MAX_CACHED_WORDS = 700_000
_FLUSH_BYTES = 4 << 20
_PART_BITS, _ROW_BITS = 24, 32
_loaded: dict[tuple, Encoder] = {}
_TRAILING = regex.compile(r"(.*\p{L})([!-/:-@\[-`{-~]+)", regex.DOTALL | regex.VERSION0)


def _ascii_pattern(path: str) -> regex.Pattern | None:
    """The tokenizer's own pattern of pieces, if all it does to printable ASCII is lower-casing and that cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cut, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    as_bytes = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
    matches = cut.get("type") == "Split" and cut["behavior"] == "Removed" and cut["invert"] and "Regex" in cut["pattern"]
    if before != ["NFC", "Replace", "Lowercase"] or not (matches and as_bytes):
        return None
    return regex.compile(cut["pattern"]["Regex"])


class _Words(dict):
    """Ids by word; a missing word is looked up by ``learn`` and kept."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit integers.

    ``by_words``: for tokenizers that drop white space and never look across it. Each distinct word is then encoded
    once and looked up afterwards; the ids are those of the whole text. Words of printable ASCII are cut by the
    tokenizer's own pattern first, as the same pieces stand in many words; others lose what ASCII signs follow their last
    letter. A full table is emptied; words stay for one more turn.
    """

    def __init__(self, path: str, by_words: bool, max_words: int = MAX_CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        self.by_words, self.max_words = by_words, max_words
        self.known = _Words(self._word)
        self.old: dict[bytes, bytes] = {}  # the words before the last time the table was full
        self.pieces: dict[str, bytes] = {}
        self.pattern = _ascii_pattern(path) if by_words else None

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = [t.id for t in self.tokenizer.model.tokenize(piece)]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _stem(self, stem: str) -> bytes:
        ids = self.pieces.get(stem)
        if ids is None:
            ids = self.pieces[stem] = self._whole(stem)
        return ids

    def _word(self, w: bytes) -> bytes:
        if w in self.old:
            return self.old[w]
        word = w.decode()
        if self.pattern is None:
            return self._whole(word)
        if w.isascii() and word.isprintable():
            return b"".join(map(self._piece, self.pattern.findall(word.lower())))
        cut = _TRAILING.fullmatch(word)
        return self._stem(cut[1]) + self._piece(cut[2]) if cut else self._stem(word)

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        if len(self.known) > self.max_words:
            self.old, self.known = self.known, _Words(self._word)
        if len(self.pieces) > self.max_words:
            self.pieces = {}
        return b"".join(map(self.known.__getitem__, text.encode().split()))


def _encoder(path: str, by_words: bool) -> Encoder:
    """One for each worker and tokenizer; workers live longer than tasks."""
    if (path, by_words) not in _loaded:
        _loaded[path, by_words] = Encoder(path, by_words)
    return _loaded[path, by_words]


def binary_lengths(n: int, limit: int) -> list[int]:
    """Powers of two that add up to n, none above the limit (a power of two), longest first."""
    out = [limit] * (n // limit)
    rest = n % limit
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, *, tokenizer: str, text: str = "text", doc_id: str = "doc_id", limit: int = 2048, end_id: int = 1,
    by_words: bool = True,
) -> DataFrame:
    """Sequences of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer file that every executor can open. ``ids`` are the piece's ids as
    little-endian unsigned 32-bit integers, ``start`` the ids of its document before it, ``doc_tokens`` the document's
    ids with ``end_id``. ``length`` is a power of two up to ``limit`` and ``offset`` always 0.

    Null, empty and blank texts: the end id alone, one sequence of length 1. Null ids, repeated ids and repeated rows:
    each row is a document of its own. Other columns are ignored, whatever their names. Empty table: empty result.
    Sequence numbers follow the partitions of ``docs``: a lost task gives the same numbers again.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    zero = F.lit(0).cast("long")
    added = {"start": zero, "length": zero, "ids": F.lit(b""), "doc_tokens": zero, "sequence_id": zero, "offset": zero}
    schema = source.select("doc_id", *[c.alias(k) for k, c in added.items()]).schema
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer, by_words), TaskContext.get().partitionId()
        if part >> _PART_BITS:
            raise ValueError("too many partitions")
        used = [0] * limit.bit_length()
        for batch in batches:
            at, pieces, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                ids = encoder.encode(t.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, limit):
                    bucket = length.bit_length() - 1
                    number = (bucket << _PART_BITS | part) << _ROW_BITS | used[bucket]
                    used[bucket] += 1
                    at.append(i)
                    pieces.append((start, length, ids[4 * start : 4 * (start + length)], n, number))
                    start, size = start + length, size + 4 * length
                    if size > _FLUSH_BYTES:
                        yield _batch(batch, at, pieces)
                        at, pieces, size = [], [], 0
            if at:
                yield _batch(batch, at, pieces)

    def _batch(batch: pa.RecordBatch, at: list[int], pieces: list[tuple]) -> pa.RecordBatch:
        start, length, ids, n, number = zip(*pieces)
        whole = [pa.array(c, pa.int64()) for c in (start, length)] + [pa.array(ids, pa.binary())]
        whole += [pa.array(c, pa.int64()) for c in (n, number, [0] * len(at))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *whole], names=schema.names)

    return source.mapInArrow(run, schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, as a trainer reads them: rows of a folder are arrays of one shape."""
    packed.write.partitionBy("length").parquet(path)
