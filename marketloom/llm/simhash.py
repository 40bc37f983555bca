"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. If two fingerprints differ in at most three bits, one of
their segments differs in at most one. So each fingerprint is stored under both its segment values and
looks up the Hamming ball of radius one around each; what it meets is verified over all 64 bits. Both
table and probes hold distinct fingerprints, never documents: copies add nothing.

Segment values shared by more than ``crowd`` fingerprints would make a quadratic number of candidates.
These fingerprints, and those within one bit of such a value, are linked exactly in another way: each
emits the 65 values within one bit of its whole fingerprint. Two fingerprints within two bits have such
a value in common, and all that share one are within two bits of each other, so a star per value
carries the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_batches, stage

_CHUNK = 255 * 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, as a signed integer; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        grams = zip(*(words[at + k : stop + k] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.fromiter((h64(b" ".join(g), seed) for g in grams), dtype=">u8", count=stop - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        if full:  # sums of 255 bits fit in a byte
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``__row`` (all columns of docs but the text) and ``fp``."""
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    source = docs.select(row.alias("__row"), F.col(text).alias("__text"))
    schema = source.select("__row", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["__row", "fp"])

    return source.mapInArrow(run, schema)


def _ball(key: str, bits: int, *, upper: bool = False) -> Column:
    """The value and its neighbours at one bit; upper: only those not below it."""
    k = F.col(key)
    if not upper:
        return F.array(k, *[k.bitwiseXOR(F.lit(_bit(i))) for i in range(bits)])
    flipped = [F.when(k.bitwiseAND(F.lit(_bit(i))) == 0, k.bitwiseOR(F.lit(_bit(i)))) for i in range(bits)]
    return F.array_compact(F.array(k, *flipped))


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def links(distinct: DataFrame, *, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints (column ``fp``) whose components are those of all
    pairs at ``max_bits`` or fewer: every pair itself, but within crowds stars instead of pairs."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the exact way for crowds holds for at most two bits")
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
    )
    table = stage(distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.seg", "h.key"), "simhash_table")
    crowds = stage(
        table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "key"),
        "simhash_crowds",
    )
    calm = table if (no_crowd := crowds.isEmpty()) else table.join(crowds, ["seg", "key"], "left_anti")
    # Each unordered pair of segment values is met once, from the lower value.
    probes = calm.select("seg", F.col("fp").alias("p"), F.explode(_ball("key", 32, upper=True)).alias("key"), F.col("key").alias("own"))
    met = probes.join(calm.withColumnRenamed("fp", "q"), ["seg", "key"])
    met = met.where((F.col("own") != F.col("key")) | (F.col("p") < F.col("q")))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    found = met.where((near > 0) & (near <= max_bits)).select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")
    )
    if no_crowd:
        return found.distinct()
    around = crowds.select("seg", F.explode(_ball("key", 32)).alias("key")).distinct()
    flagged = table.join(around, ["seg", "key"], "left_semi").select("fp").distinct()
    # At most 65 fingerprints lie within one bit of a value, so the lists are short. With one bit
    # allowed, only a fingerprint and its own neighbours count.
    stars = (
        flagged.select("fp", F.explode(_ball("fp", 64)).alias("key"))
        .groupBy("key")
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
    )
    if max_bits == 2:
        crowded = stars.select("a", F.explode("all").alias("b"))
    else:
        inside = stars.where(F.array_contains("all", F.col("key"))) if max_bits else stars.limit(0)
        crowded = inside.select(F.col("key").alias("a"), F.explode("all").alias("b"))
    crowded = crowded.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(crowded).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge ``a, b``; root is the smallest node reachable.

    Alternates large-star and small-star steps, each a written table, until nothing changes. A node's
    neighbours are only ever reduced to their minimum, never gathered.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc_edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc_low")
        large = stage(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc_large"
        )
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc_low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc_small")
        before, now = now, state(e)
        if now == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def group(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2, crowd: int = 64
) -> DataFrame:
    """Near-duplicate groups: the columns of ``docs`` without the text as struct ``__row``, with
    ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id of the component).

    Null or empty text, or only white space: fingerprint zero, linked like any other. Fewer words than
    a shingle: the whole sequence is one. Null doc_id: takes part, but names a component only if it has
    no other id (then null). Repeated rows and ids: each row is returned. Empty table: empty result.
    """
    printed = stage(fingerprints(docs, text=text, shingle=shingle), "simhash_prints")
    classes = stage(printed.groupBy("fp").agg(F.min(f"__row.{doc_id}").alias("least")), "simhash_classes")
    edges = links(classes.select("fp"), max_bits=max_bits, crowd=crowd)
    rooted = classes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stage(rooted, "simhash_rooted")
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash_named")
    of_print = stage(rooted.join(named, "root").select("fp", "component_id"), "simhash_components")
    return printed.join(of_print, "fp").select(
        "__row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", grouped_by: Callable[..., DataFrame] | None = None, **options
) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest doc_id stays.

    ``grouped_by`` makes the groups, by default ``group``; ``options`` go to it. A component without any doc_id keeps one row. Where several rows share the smallest doc_id, the one
    whose text has the smallest pair of hashes stays; equal texts are the same row up to other columns.
    """
    id_ = F.col(f"`{doc_id}`")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        id_.alias("__id"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__hash"),
    )
    grouped = (grouped_by or group)(
        keyed.select("__id", "__hash", F.col(f"__row.`{text}`").alias("__text")), text="__text", doc_id="__id", **options
    )
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone")
    best = stage(
        grouped.groupBy("component_id", alone, "__row")
        .agg(F.count("*").alias("n"))
        .groupBy("component_id", "alone")
        .agg(F.min(F.struct(F.col("__row.__id").isNull(), F.col("__row.__id"), F.col("__row.__hash"), "n")).alias("b"))
        .select("b.__id", "b.__hash", "b.n"),
        "simhash_best",
    )

    def rows_of(winners: DataFrame) -> DataFrame:
        same = F.col("k.__id").eqNullSafe(F.col("b.__id")) & (F.col("k.__hash") == F.col("b.__hash"))
        return keyed.alias("k").join(winners.alias("b"), same, "left_semi")

    kept = rows_of(best.where("n = 1"))
    repeated = best.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows_of(repeated).dropDuplicates(["__id", "__hash"]))
    return kept.select("__row.*")
