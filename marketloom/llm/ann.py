"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash is a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) followed by the nearest signed axis. A vector is stored under its axis in every table; a
query probes the axes nearest to it. What the probed buckets hold is ranked exactly.

The measure is the inner product, so vectors first get one more coordinate that brings all of a norm
class to the same length; then the nearest by angle is the nearest by inner product. Norm classes are
octaves, each with tables of its own, so that one long vector does not squeeze the rest together.

A bucket of any size is cut into blocks of bounded size, on both sides, and each pair of blocks is one
task's work; a vector that a third of the rows repeat only means more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import stage


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotations(tables: int, width: int, seed: int) -> np.ndarray:
    """Signs of three rounds for each table."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, width))


def axis_scores(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Closeness of each row to each signed axis: axis a, then a + width for its negative."""
    z = np.zeros((len(x), signs.shape[1]))
    z[:, : x.shape[1]] = x
    for s in signs:
        z = hadamard(z * s)
    return np.concatenate([z, -z], axis=1)


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v`` (doubles) of the vectors that take part, one row for each id."""
    v = F.col("v")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & sound)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = [np.frombuffer(b, np.float64) for b in column.to_pylist()]
    return np.stack(parts) if parts else np.zeros((0, 0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, each summed in order of the components, so that equal vectors tie exactly."""
    out = np.zeros((len(q), len(v)))
    for j in range(q.shape[1]):
        out += np.multiply.outer(q[:, j], v[:, j])
    return out


def _nearest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple]:
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    for at in range(0, len(q), 64):
        s = products(q[at : at + 64], v)
        ids = q_ids[at : at + 64]
        own = v_ids[None, :] == ids[:, None]
        s[own] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for i, row in enumerate(best):
            row = row[~own[i, row]]
            if len(row):
                yield int(ids[i]), v_ids[row], s[i, row]


_FOUND = "query_id bigint, ids array<bigint>, scores array<double>"


def _block_search(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, block_rows: int) -> DataFrame:
    """Best k of each query among the rows with the same keys: ``query_id, ids, scores``, one row for
    each pair of blocks. ``queries`` and ``rows`` have ``id, packed`` beside the keys."""
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("row_blocks"))
    n_queries = queries.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("query_blocks"))
    blocks = stage(n_rows.join(n_queries, keys), "ann_blocks")

    def dealt(df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        # By id, not by place: a task that runs again must deal its rows alike.
        each = df.join(blocks, keys).withColumn(own_block, F.pmod(F.xxhash64("id", F.lit("block")), F.col(own)).cast("int"))
        return each.withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            *keys, "row_block", "query_block", "id", "packed"
        )

    full = [*keys, "row_block", "query_block"]
    left = dealt(queries, "query_blocks", "row_blocks", "query_block", "row_block")
    right = dealt(rows, "row_blocks", "query_blocks", "row_block", "query_block")

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and v.num_rows:
            q_ids, v_ids = q.column("id").to_numpy(), v.column("id").to_numpy()
            out = list(_nearest(q_ids, _matrix(q.column("packed")), v_ids, _matrix(v.column("packed")), k))
        return pa.table(
            {
                "query_id": pa.array([o[0] for o in out], pa.int64()),
                "ids": pa.array([o[1] for o in out], pa.list_(pa.int64())),
                "scores": pa.array([o[2] for o in out], pa.list_(pa.float64())),
            }
        )

    return left.groupBy(*full).cogroup(right.groupBy(*full)).applyInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query over all its blocks and tables: ``query_id, ids, scores``."""

    def merge(t: pa.Table) -> pa.Table:
        ids = t.column("ids").combine_chunks().flatten().to_numpy()
        scores = t.column("scores").combine_chunks().flatten().to_numpy()
        ids, first = np.unique(ids, return_index=True)
        scores = scores[first]
        order = np.lexsort((ids, -scores))[:k]
        return pa.table(
            {
                "query_id": t.column("query_id").slice(0, 1),
                "ids": pa.array([ids[order]], pa.list_(pa.int64())),
                "scores": pa.array([scores[order]], pa.list_(pa.float64())),
            }
        )

    return found.groupBy("query_id").applyInArrow(merge, _FOUND)


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    tables: int = 10,
    hashes: int = 1,
    probe_share: float = 0.125,
    seed: int = 11,
    block_rows: int = 2048,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """k nearest of each query by inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``id``. Each table has (2 x width) ** ``hashes`` buckets; a query
    probes ``probe_share`` of the axes in each. Ties go to the smaller id. Vectors null, zero or with null
    or non-finite components, null ids, and vectors of another than the most common length take no
    part. Rows of one id are one vector (the least, if they differ). Fewer than k other vectors: all of
    them. If the buckets hold fewer than that for a query, it is searched against all rows, in blocks. Empty table: empty result.
    """
    rows = stage(valid_vectors(vectors, vec_id, vector), "ann_vectors")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return rows.select(*[F.lit(0).cast(t).alias(c) for c, t in _RESULT]).limit(0)
    d = size["n"]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.where(F.size("v") == d).withColumn("norm", norm)
    rows = rows.withColumn("octave", F.floor(F.log2("norm") + 0.5).cast("int"))
    # One row for each power of two between the shortest and the longest vector, 2,200 at most.
    longest = {r["octave"]: r["m"] for r in rows.groupBy("octave").agg(F.max("norm").alias("m")).collect()}
    uneven = rows.where(F.col("norm") < 0.999999 * _by_octave(longest)).limit(1).count() > 0
    width = 1 << max(1, math.ceil(math.log2(d + uneven)))
    signs = [rotations(tables, width, seed + 1000 * h) for h in range(hashes)]
    probes = max(1, round(probe_share * 2 * width))

    def codes(x: np.ndarray, t: int, count: int) -> np.ndarray:
        """The nearest bucket, or the ``count`` nearest, of each row in table t."""
        total = None
        for h in range(hashes):
            s = axis_scores(x, signs[h][t])
            top = np.argsort(-s, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(s, top, axis=1)
            if total is None:
                total, code = value, top.astype(np.int64)
            else:
                value = (total[:, :, None] + value[:, None, :]).reshape(len(x), -1)
                both = (code[:, :, None] * (2 * width) + top[:, None, :]).reshape(len(x), -1)
                keep = np.argsort(-value, axis=1, kind="stable")[:, :count]
                total, code = np.take_along_axis(value, keep, axis=1), np.take_along_axis(both, keep, axis=1)
        return code

    bucket = "octave int, t int, code bigint, id bigint, packed binary"

    def hashed(count: int, octaves: list[int] | None):
        """Rows under their own bucket (octaves None), or queries under their probes in every octave."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    yield from part(b.slice(at, 1024))

        def part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            v = np.stack([np.asarray(x, float) for x in b.column(1).to_pylist()])
            packed = [x.tobytes() for x in v]
            ids = b.column(0).to_pylist()
            octave = np.array(b.column(2).to_pylist())
            if octaves is None:
                m = np.array([longest[o] for o in octave])[:, None]
                x = v / m
                if uneven:
                    x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)
            else:
                x = v
            for t in range(tables):
                code = codes(x, t, count)
                for o in octaves or [None]:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(octave if o is None else np.full(len(v), o), count), pa.int32()),
                            pa.array(np.full(len(v) * count, t), pa.int32()),
                            pa.array(code.reshape(-1), pa.int64()),
                            pa.array([i for i in ids for _ in range(count)], pa.int64()),
                            pa.array([p for p in packed for _ in range(count)], pa.binary()),
                        ],
                        names=["octave", "t", "code", "id", "packed"],
                    )

        return run

    plain = rows.select("id", "v", "octave")
    asked = plain.where(is_query)
    table = plain.mapInArrow(hashed(1, None), bucket)
    probed = asked.mapInArrow(hashed(probes, sorted(longest)), bucket)
    found = stage(_best(_block_search(probed, table, ["octave", "t", "code"], k, block_rows), k), "ann_found")

    others = rows.count() - 1
    short = asked.join(found.where(F.size("ids") >= min(k, others)).withColumnRenamed("query_id", "id"), "id", "left_anti")
    if others > 0 and not short.isEmpty():

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = [np.asarray(x, float).tobytes() for x in b.column(1).to_pylist()]
                ones = pa.array([0] * b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([ones, b.column(0), pa.array(packed, pa.binary())], names=["all", "id", "packed"])

        every = "all int, id bigint, packed binary"
        rest = _block_search(
            short.select("id", "v").mapInArrow(pack, every), plain.select("id", "v").mapInArrow(pack, every), ["all"], k, block_rows
        )
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_best(rest, k))
    return found.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
    )


_RESULT = (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "double"))


def _by_octave(longest: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in longest.items() for x in kv]), F.col("octave"))
