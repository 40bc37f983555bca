"""Line deduplication over levelled sorted runs of line hashes.

Each batch of documents gives one run: the 128-bit hash of every line key with the number of documents
that hold it, sorted by hash. Runs of one size class form a level; when a level is full its runs are
merged into one run of the next level, where equal hashes add up. A key whose total reaches the
threshold moves to the runs of settled keys. A new batch is merged against the settled runs first (sort-merge
anti join), and only what is not settled is written, so frequent lines cost nothing later on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches, stage, text_key, text_of

_STRIP = b" \t\n\x0b\f\r"
_NONE = (0, 0)
KEYS = "array<struct<a:bigint,b:bigint>>"


def line_keys(text: str, min_chars: int = 1) -> list[tuple[int, int]]:
    """Hash of each line's key: stripped, A-Z lower-cased. Keys that are too short give (0, 0)."""
    keys = []
    for line in text.encode().split(b"\n"):
        key = line.strip(_STRIP).lower()
        if not key or (min_chars > 1 and len(key.decode()) < min_chars):
            keys.append(_NONE)
        else:
            d = hashlib.blake2b(key, digest_size=16).digest()
            keys.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
    return keys


def keyed_lines(docs: DataFrame, *, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``k1, k2`` (key of the whole text) and ``keys``, the hashes of its lines in order."""
    bounded_batches(docs.sparkSession)
    k1, k2 = text_key(text_of(text))
    source = docs.select(k1.alias("k1"), k2.alias("k2"), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            flat_a: list[int] = []
            flat_b: list[int] = []
            offsets = [0]
            for t in batch.column(2):
                for a, b in line_keys(t.as_py(), min_chars):
                    flat_a.append(a)
                    flat_b.append(b)
                offsets.append(len(flat_a))
            pairs = pa.StructArray.from_arrays([pa.array(flat_a, pa.int64()), pa.array(flat_b, pa.int64())], fields=list(struct))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=["k1", "k2", "keys"])

    return source.mapInArrow(run, f"k1 bigint, k2 bigint, keys {KEYS}")


class LineRuns:
    """The runs of one corpus. Batches may come at any time; totals do not depend on how rows were
    cut into batches or on when levels were merged."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _sorted(self, run: DataFrame, name: str) -> DataFrame:
        return stage(run.sortWithinPartitions("a", "b"), name)

    def _unsettled(self, run: DataFrame) -> DataFrame:
        for done in self.settled:
            run = run.hint("merge").join(done.select("a", "b"), ["a", "b"], "left_anti")
        return run

    def add(self, keyed: DataFrame) -> None:
        """One batch of ``keyed_lines`` becomes one run of the lowest level."""
        key = keyed.select(F.explode(F.array_distinct("keys")).alias("k")).where("k.a <> 0 OR k.b <> 0")
        run = key.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n"))
        # Written first: else the optimiser moves the anti join below the counting, and every single
        # occurrence of a frequent line goes to one task.
        run = stage(run, "line_counts")
        self.levels[0].append(self._sorted(self._unsettled(run), "line_run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.settled.append(self._sorted(merged.where(F.col("n") >= self.threshold), "line_settled"))
            self.levels[level + 1].append(self._sorted(merged.where(F.col("n") < self.threshold), "line_level"))
            level += 1

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Equal hashes add up. Part of a key may already be settled (merged from other runs later)."""
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        out = out.groupBy("a", "b").agg(F.sum("n").alias("n"))
        return stage(self._unsettled(out), "line_merge")

    def frequent(self) -> DataFrame:
        """Hashes ``a, b`` found in at least ``threshold`` documents of all batches so far."""
        open_runs = [r for level in self.levels for r in level]
        found = [s.select("a", "b") for s in self.settled]
        if open_runs:
            found.append(self._merge(open_runs).where(F.col("n") >= self.threshold).select("a", "b"))
        if not found:
            return self.spark.createDataFrame([], "a bigint, b bigint")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.distinct()


def _without_lines(text: pd.Series, at: pd.Series) -> pd.Series:
    def cut(t, drop):
        if drop is None:
            return t
        gone = set(drop)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([cut(t, d) for t, d in zip(text, at)], dtype=object)


def dedup(
    docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4
) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns ``__row`` (the document's columns), ``n_lines``, ``n_dropped``, ``kept`` (the text that is
    left). A null or empty text is one empty line; empty keys are never dropped. A line repeated within
    one document counts once for it; each row is a document, so repeated rows count each. A document may lose all its lines
    and is then empty. Empty table: empty result. The corpus is dealt into ``batches`` by text.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.col("k1"), F.lit(batches)).alias("batch")
    keyed = stage(keyed_lines(docs, text=text, min_chars=min_chars), "line_keys").select("*", batch)
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(keyed.where(F.col("batch") == b))
    frequent = stage(runs.frequent(), "line_frequent")
    lines = keyed.select("k1", "k2", F.posexplode("keys").alias("at", "k")).select("k1", "k2", "at", "k.a", "k.b")
    drops = stage(
        lines.join(frequent, ["a", "b"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("at")), "line_drops"
    )
    k1, k2 = text_key(text_of(text))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        text_of(text).alias("t"), k1.alias("k1"), k2.alias("k2"),
    )
    cut = F.pandas_udf(_without_lines, "string")
    joined = rows.join(drops, ["k1", "k2"], "left")
    return joined.select(
        "__row",
        (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(cut(F.when(F.col("at").isNotNull(), F.col("t")), "at"), "t").alias("kept"),
    )
