"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size takes every document floor(r) times and one more copy with
probability r - floor(r). Which documents get the extra copy is decided by the cube method: the vector
of inclusion probabilities moves along the null space of the balancing constraints (number of
documents, number of words) until each probability is 0 or 1. Every step keeps both totals exactly, so
only the last two documents of a source, where no direction is left, are rounded.

On Spark the flight runs in blocks of bounded size. A block ends with at most two undecided documents;
these meet in the blocks of the next round, until a source fits in one block, which then lands. A
source of any size is split, so a hot source only has more blocks.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.indexing import with_row_index
from marketloom.llm.common import WORD, stage, text_of

_EPS = 1e-9


def targets(
    sources: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, cap: float = 3.0
) -> DataFrame:
    """Target of each source: ``source, source_size`` to ``..., weight, target``.

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of the total
    size by weight. Nobody takes more than ``cap`` times its size: those above stop there and the
    others share what is left, until none is above. Only sums come to the driver.
    """
    ranked = with_row_index(
        sources.select("source", "source_size", F.col("source").isNull().alias("_last")), "_last", "source"
    ).drop("_last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    free = stage(ranked.select("source", "source_size", weight.alias("weight")), "source_weights")
    total = share * (free.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(cap)
    # A source is capped once the level (words per unit of weight) passes cap * size / weight; the
    # level only rises as capped sources leave, so it tells the whole state.
    level = 0.0
    while True:
        over = limit < F.lit(level) * F.col("weight")
        kept, open_weight = free.agg(
            F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        new = (total - kept) / open_weight
        if new <= level:
            break
        level = new
    return free.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def fly(sizes: Sequence[int], probs: Sequence[float], rng: random.Random) -> list[float]:
    """Flight phase over one block, with two constraints: number of documents and of words.

    Any three undecided documents span the constraints, so their null vector is a cross product. The
    step goes to either end of the segment with odds that keep every expected value.
    """
    p = list(probs)
    active: list[int] = []
    queue = iter(range(len(p)))

    def settled(i: int) -> bool:
        if p[i] <= _EPS:
            p[i] = 0.0
        elif p[i] >= 1 - _EPS:
            p[i] = 1.0
        return p[i] in (0.0, 1.0)

    while True:
        active = [i for i in active if not settled(i)]
        while len(active) < 3:
            i = next(queue, None)
            if i is None:
                break
            if not settled(i):
                active.append(i)
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            v = (c - b, a - c, b - a)
            if v == (0, 0, 0):
                v = (1, -1, 0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            v = (1, -1)
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, v) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, v) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, v):
            p[i] += step * x


def land(sizes: Sequence[int], probs: Sequence[float]) -> list[float]:
    """Landing phase: of the roundings of the last (at most two) documents, the nearest in words."""
    p = list(probs)
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    best = min(
        range(1 << len(rest)),
        key=lambda bits: (
            abs(sum(sizes[i] * ((bits >> k & 1) - p[i]) for k, i in enumerate(rest))),
            abs(sum((bits >> k & 1) - p[i] for k, i in enumerate(rest))),
            bits,
        ),
    )
    for k, i in enumerate(rest):
        p[i] = float(best >> k & 1)
    return p


def _fly_and_land(sizes: Sequence[int], probs: Sequence[float], rng: random.Random, tries: int = 16) -> list[float]:
    """The last block of a source. A large document may be among the last two and leave a large error;
    of some flights the one that lands nearest is taken."""
    goal = sum(s * p for s, p in zip(sizes, probs))
    best, least = list(probs), float("inf")
    for _ in range(tries):
        p = land(sizes, fly(sizes, probs, rng))
        error = abs(sum(s * x for s, x in zip(sizes, p)) - goal)
        if error < least:
            best, least = p, error
        if least <= 0.001 * goal:
            break
    return best


def _round(rows: DataFrame, block_rows: int, number: int) -> DataFrame:
    """One flight over all undecided documents; a source in one block lands as well."""
    counts = stage(rows.groupBy("source").agg(F.count("*").alias("n")), "mix_counts")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    dealt = (
        rows.alias("r")
        .join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
        .select("r.*", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(number)), F.col("blocks")))
    )

    def flight(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id"], ascending=[False, True])
        sizes, first = df["size"].tolist(), df.iloc[0]
        rng = random.Random(zlib.crc32(f"{first['source']}|{number}|{first['block']}".encode()))
        probs = df["p"].tolist()
        df["p"] = _fly_and_land(sizes, probs, rng) if first["blocks"] == 1 else fly(sizes, probs, rng)
        return df[["source", "doc_id", "size", "p"]]

    return dealt.groupBy("source", "block").applyInPandas(flight, rows.select("source", "doc_id", "size", "p").schema)


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    cap: float = 3.0,
    block_rows: int = 4096,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """What the mix takes of each document.

    Returns ``doc_id, size, source_size, target, taken, source, copies``: size is the number of words
    (null or empty text: 0), taken the words of all its copies, copies = taken / size.

    Null source: a source of its own, last in order. Null doc_id: allowed, several are repeats of one
    key. Rows that agree in (source, doc_id, size) are one unit of the sampling and share its words
    evenly; what the division leaves goes to some of them, a word each, so that the unit's total is exact. A document of size 0 takes 0. Empty table: empty result. Other columns of
    ``docs`` are not read. The result depends on the rows alone, not on their order or partitions.
    """
    sized = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix_sizes",
    )
    by_source = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sources")
    goal = stage(targets(by_source, weights, share, cap), "mix_targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    # Whole copies first; p is what is left to the draw.
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))
    expected = F.col("m") * rate
    whole = F.floor(expected + _EPS)
    units = stage(
        units.alias("u")
        .join(goal.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source")))
        .select(
            "u.*", F.col("u.doc_id").cast("string").alias("key"), whole.alias("whole"),
            F.when(F.col("size") > 0, F.greatest(expected - whole, F.lit(0.0))).otherwise(F.lit(0.0)).alias("p"),
        ),
        "mix_units",
    )
    # Ids travel as text: in pandas, whole numbers beside a null would become floats.
    open_ = units.where(F.col("p") > 0).select("source", F.col("key").alias("doc_id"), "size", "p")
    taken_extra: list[DataFrame] = []
    number = 0
    while not open_.isEmpty():
        flown = stage(_round(open_, block_rows, number), f"mix_round_{number}")
        taken_extra.append(flown.where(F.col("p") == 1.0).select("source", "doc_id", "size"))
        open_ = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        number += 1
    extra = units.select("source", F.col("key").alias("doc_id"), "size").limit(0)
    for part in taken_extra:
        extra = extra.unionByName(part)
    drawn = extra.select("source", F.col("doc_id").alias("key"), "size").withColumn("one", F.lit(1))
    by_key = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("source", "key", "size")]
    decided = stage(
        units.alias("a")
        .join(drawn.alias("b"), by_key, "left")
        .select("a.*", (F.col("whole") + F.coalesce("one", F.lit(0))).alias("copies")),
        "mix_decided",
    )
    # The rows of a unit are alike, so they are made from it: one by one, or in blocks that are dealt out.
    unit = decided.withColumn("words", F.col("size") * F.col("copies"))
    row = F.struct("source", "doc_id", "size", "copies", "m", "words")
    single = unit.where("m = 1").select(row.alias("b"), F.lit(0).cast("long").alias("row"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(block_rows).cast("long"))).alias("start")
    blocks = unit.where("m > 1").select(row.alias("b"), starts)
    stop = F.least(F.col("start") + block_rows, F.col("b.m")) - 1
    several = blocks.repartition("b", "start").select("b", F.explode(F.sequence("start", stop)).alias("row"))
    spare = F.pmod(F.col("b.words"), F.col("b.m"))
    taken = F.expr("b.words div b.m") + F.when(F.col("row") < spare, 1).otherwise(0)
    copies = F.when((F.col("b.m") > 1) & (F.col("b.size") > 0), taken / F.col("b.size")).otherwise(F.col("b.copies") / F.col("b.m"))
    return (
        single.unionByName(several)
        .join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .select(
            "b.doc_id", "b.size", "g.source_size", "g.target", taken.alias("taken"), "b.source", copies.alias("copies")
        )
    )


def materialise(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as it was taken. Needs one row per doc_id."""
    times = mixed.select(F.col("doc_id").alias("_mixed_id"), F.col("copies").cast("int").alias("_copies"))
    return (
        docs.join(times.where("_copies > 0"), docs[doc_id] == F.col("_mixed_id"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .drop("_mixed_id", "_copies", "_copy")
    )

