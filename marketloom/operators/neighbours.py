"""All near-duplicates among candidate portfolios: an exact l1 self join.

Equal portfolios are one class. A class carries a sketch: its names fall into 16 groups, and the weights of a group are
summed with signs. The l1 distance of two sketches never exceeds that of the portfolios, nor does the difference of any
signed sum of the groups, a projection. The three projections with the widest spread place the classes in a grid.

Many near copies would pair up in any cell. So the first class of a cell of the grid gathers those within a quarter of the
radius into a ball, a few times over. Members of a ball are links of each other without being paired. Two balls whose farthest
members must be within the radius are linked as a whole; two that cannot reach each other are not linked; only what lies
between is compared member by member, first by the distances to the balls' centres, then by sketch, then by weights.

Balls meet in cells that get smaller as there are more of them: each cell is cut in two at the median of one more projection,
until about ``LEAF`` balls are left in one. A ball close to a cut also goes to the other side. So the work grows with the
balls times the sides they go to, not with their square.
"""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import stage

GROUPS, PROJECTIONS = 16, 16
# The grid takes the widest so many of the first projections.
DIMENSIONS, GRID = 3, 8
BALL_ROUNDS = 3
# Balls in a cell where they meet, and cells that a ball goes to, both on average.
LEAF, MOST_CELLS = 32, 64
_HAIR = 1 + 1e-9


@dataclasses.dataclass
class Links:
    """Links within a radius; a candidate's links are those of its class.

    ``members``: cand_id, class_id (smallest cand_id of the class). ``balls``: class_id, ball, to_centre, copies; classes of
    one ball are linked. ``whole``: ball, other; all of one are linked with all of the other. ``pairs``: class_id, other;
    what is left. ``whole`` and ``pairs`` hold each link in both directions.
    """

    members: DataFrame
    balls: DataFrame
    whole: DataFrame
    pairs: DataFrame

    def counts(self) -> DataFrame:
        """``cand_id, class_id, n_equal, n_links``: other candidates that are equal, and all others within the radius."""
        sizes = self.balls.groupBy("ball").agg(F.sum("copies").alias("size"))
        by_ball = (
            self.whole.join(sizes.withColumnRenamed("ball", "other"), "other").groupBy("ball").agg(F.sum("size").alias("around"))
        )
        copies = self.balls.select(F.col("class_id").alias("other"), F.col("copies").alias("n"))
        by_class = self.pairs.join(copies, "other").groupBy("class_id").agg(F.sum("n").alias("single"))
        each = (
            self.balls.join(sizes, "ball").join(by_ball, "ball", "left").join(by_class, "class_id", "left")
            .select(
                "class_id", (F.col("copies") - 1).alias("n_equal"),
                (F.col("size") - 1 + F.coalesce("around", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("n_links"),
            )
        )
        return self.members.join(each, "class_id").select("cand_id", "class_id", "n_equal", "n_links")


def sketches(weights: DataFrame) -> DataFrame:
    """``cand_id, h1, h2`` (order-free hashes of the weights that are not 0) and ``s``, the signed group sums."""
    w = F.coalesce("w", F.lit(0.0)) + 0.0
    placed = weights.select(
        "cand_id", w.alias("w"), F.pmod(F.xxhash64("symbol", F.lit(7)), F.lit(GROUPS)).alias("g"),
        (F.pmod(F.xxhash64("symbol", F.lit(8)), F.lit(2)) * 2 - 1).alias("sign"),
        *[F.when(w != 0, F.xxhash64("symbol", w, F.lit(seed))).cast("decimal(38,0)").alias(f"x{seed}") for seed in (1, 2)],
    )
    sums = [F.sum(F.when(F.col("g") == k, F.col("w") * F.col("sign")).otherwise(0.0)) for k in range(GROUPS)]
    return placed.groupBy("cand_id").agg(
        *[F.coalesce(F.sum(f"x{seed}"), F.lit(0)).cast("string").alias(f"h{seed}") for seed in (1, 2)], F.array(*sums).alias("s")
    )


def _projections() -> list[Column]:
    """Signed sums of the groups; the signs of projection j are those of row j of a Hadamard matrix."""
    return [
        functools.reduce(lambda a, b: a + b, [F.col("s")[k] * (-1.0 if (j & k).bit_count() % 2 else 1.0) for k in range(GROUPS)])
        for j in range(PROJECTIONS)
    ]


def _sketch_distance(a: str, b: str) -> Column:
    """Written out: a lambda over the arrays would not be compiled."""
    return functools.reduce(lambda x, y: x + y, [F.abs(F.col(a)[k] - F.col(b)[k]) for k in range(GROUPS)])


def distances(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``a, b, l1`` for pairs of candidates. Names that only one of them holds count through its total."""
    held = weights.select("cand_id", "symbol", F.coalesce("w", F.lit(0.0)).alias("w"))
    mass = stage(held.groupBy("cand_id").agg(F.sum(F.abs("w")).alias("mass")), "masses")
    of_a = held.select(F.col("cand_id").alias("a"), "symbol", F.col("w").alias("x"))
    of_b = held.select(F.col("cand_id").alias("b"), "symbol", F.col("w").alias("y"))
    delta = F.abs(F.col("x") - F.col("y")) - F.abs("x") - F.abs("y")
    common = pairs.select("a", "b").join(of_a, "a").join(of_b, ["b", "symbol"]).groupBy("a", "b").agg(F.sum(delta).alias("delta"))
    return (
        pairs.select("a", "b").join(common, ["a", "b"], "left")
        .join(mass.select(F.col("cand_id").alias("a"), F.col("mass").alias("ma")), "a")
        .join(mass.select(F.col("cand_id").alias("b"), F.col("mass").alias("mb")), "b")
        .select("a", "b", F.greatest(F.col("ma") + F.col("mb") + F.coalesce("delta", F.lit(0.0)), F.lit(0.0)).alias("l1"))
    )


def _gathered(placed: DataFrame, weights: DataFrame, reach: float) -> DataFrame:
    """``class_id, ball, to_centre``: classes near the first of their cell, the others again, at last alone."""
    balls, rest = None, placed
    for _ in range(BALL_ROUNDS):
        crowded = rest.groupBy("cell").agg(F.min("class_id").alias("ball"), F.count("*").alias("n")).where("n > 1")
        near = stage(rest.join(crowded, "cell").select("class_id", "ball"), "ball_candidates")
        if near.isEmpty():
            break
        apart = distances(near.where("class_id <> ball").select(F.col("ball").alias("a"), F.col("class_id").alias("b")), weights)
        inside = apart.where(F.col("l1") <= reach).select(F.col("b").alias("class_id"), F.col("a").alias("ball"), F.col("l1").alias("to_centre"))
        centres = near.where("class_id = ball").select("class_id", "ball", F.lit(0.0).alias("to_centre"))
        new = stage(inside.unionByName(centres), "balls")
        balls = new if balls is None else balls.unionByName(new)
        rest = stage(rest.join(new, "class_id", "left_anti"), "ball_rest")
    alone = rest.select("class_id", F.col("class_id").alias("ball"), F.lit(0.0).alias("to_centre"))
    return alone if balls is None else balls.unionByName(alone)


def _cuts(centres: DataFrame, radius: float) -> list[tuple[int, float]]:
    """Projections and their medians to cut at, those that fewest balls are close to first: as many as leave ``LEAF`` balls in
    a cell, but no more than let a ball go to ``MOST_CELLS`` cells on average."""
    wanted = [F.percentile_approx(F.col("p")[j], 0.5, 1000).alias(f"m{j}") for j in range(PROJECTIONS)]
    found = centres.agg(F.count("*").alias("n"), F.max("extent").alias("extent"), *wanted).first()
    most = min(PROJECTIONS, max(0, math.ceil(math.log2(max(found.n, 1) / LEAF))))
    if not most:
        return []
    close = {j: _close(j, found[f"m{j}"], radius, found.extent) for j in range(PROJECTIONS)}
    share = centres.agg(*[F.avg(close[j].cast("int")).alias(f"c{j}") for j in range(PROJECTIONS)]).first()
    best = [j for j in sorted(range(PROJECTIONS), key=lambda j: share[j]) if share[j] < 0.95][:most]
    sides = [functools.reduce(lambda a, b: a * b, [F.when(close[j], 2.0).otherwise(1.0) for j in best[: k + 1]]) for k in range(len(best))]
    cells = centres.agg(*[F.avg(c) for c in sides]).first() if sides else []
    return [(j, found[f"m{j}"]) for j, c in zip(best, cells) if c <= MOST_CELLS]


def _close(j: int, cut: float, radius: float, widest: float) -> Column:
    """Whether a ball may be within reach of one on the other side of a cut; ``widest`` is the largest extent of all."""
    return F.abs(F.col("p")[j] - F.lit(cut)) <= (F.lit(radius + widest) + F.col("extent")) * _HAIR


def _cells(centres: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """``a, ra, sa, own, cell``: balls in their own cell and in later ones that they reach into; ``b, rb, sb, cell``: all balls at
    home. Two balls within reach of each other meet once, or both ways round in one cell."""
    cuts = _cuts(centres, radius)
    widest = centres.agg(F.coalesce(F.max("extent"), F.lit(0.0))).first()[0]
    over = [F.when(F.col("p")[j] > F.lit(cut), 1 << i).otherwise(0) for i, (j, cut) in enumerate(cuts)]
    own = functools.reduce(lambda a, b: a + b, over, F.lit(0))
    home = centres.withColumn("own", own)
    right = home.select(F.col("ball").alias("b"), F.col("extent").alias("rb"), F.col("s").alias("sb"), F.col("own").alias("cell"))
    reached = F.array(F.col("own"))
    if cuts:
        sides = F.array_compact(F.array(*[F.when(_close(j, cut, radius, widest), 1 << i) for i, (j, cut) in enumerate(cuts)]))
        both = lambda cells, bit: F.concat(cells, F.transform(cells, lambda c: c.bitwiseXOR(bit)))
        reached = F.filter(F.aggregate(sides, reached, both), lambda c: c >= F.col("own"))
    left = home.select(
        F.col("ball").alias("a"), F.col("extent").alias("ra"), F.col("s").alias("sa"), "own", F.explode(reached).alias("cell")
    )
    return left, right


def near_links(weights: DataFrame, radius: float) -> Links:
    """All links of candidates ``cand_id, symbol, w`` within the l1 radius. Stage ``weights``: it is read often.

    Absent names weigh 0, null weights too. One row for each candidate and name.
    """
    printed = stage(sketches(weights), "sketches")
    classes = stage(
        printed.groupBy("h1", "h2").agg(F.min("cand_id").alias("class_id"), F.count("*").alias("copies"), F.min("s").alias("s")),
        "classes",
    )
    members = printed.join(classes, ["h1", "h2"]).select("cand_id", "class_id")
    held = stage(weights.join(classes.select(F.col("class_id").alias("cand_id")), "cand_id", "left_semi"), "class_weights")

    projections = _projections()
    projected = stage(classes.select("class_id", "copies", "s", F.array(*projections).alias("p")), "projected")
    p = F.col("p")
    spread = projected.agg(*[F.coalesce(F.stddev_pop(p[j]), F.lit(0.0)).alias(f"p{j}") for j in range(GRID)]).first()
    widest = sorted(range(GRID), key=lambda j: -spread[j])[:DIMENSIONS]
    reach = radius / 4
    width = max(radius + 2 * reach, 1e-12) * _HAIR
    cell = F.array(*[F.floor(p[j] / width) for j in widest])
    placed = projected.withColumn("cell", cell)
    balls = stage(
        _gathered(placed.select("class_id", "cell"), held, reach).join(placed.select("class_id", "copies", "s"), "class_id"), "balls"
    )
    extents = balls.groupBy("ball").agg(F.max("to_centre").alias("extent"))
    centres = stage(
        extents.join(placed.select(F.col("class_id").alias("ball"), "s", "p"), "ball"), "centres"
    )
    left, right = _cells(centres, radius)
    limit = (F.lit(radius) + F.col("ra") + F.col("rb")) * _HAIR
    # Each pair once: from the ball of the lower cell to the home of the other.
    met = left.join(right, "cell").where((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    met = stage(met.where(_sketch_distance("sa", "sb") <= limit).select("a", "b", "ra", "rb"), "ball_pairs")
    apart = stage(met.join(distances(met, held), ["a", "b"]).where(F.col("l1") <= limit), "ball_distances")
    all_near = F.col("l1") + F.col("ra") + F.col("rb") <= radius
    whole = apart.where(all_near).select("a", "b")
    pairs = _between(apart.where(~all_near), balls, held, radius)
    return Links(members, balls.select("class_id", "ball", "to_centre", "copies"), _both(whole, "ball"), _both(pairs, "class_id"))


def _both(links: DataFrame, name: str) -> DataFrame:
    there = links.select(F.col("a").alias(name), F.col("b").alias("other"))
    return there.unionByName(links.select(F.col("b").alias(name), F.col("a").alias("other")))


def _between(apart: DataFrame, balls: DataFrame, weights: DataFrame, radius: float) -> DataFrame:
    """Linked members ``a, b`` of two balls that are neither linked as a whole nor out of reach."""
    side = lambda n: balls.select(
        F.col("ball").alias(n), F.col("class_id").alias(f"c{n}"), F.col("to_centre").alias(f"d{n}"), F.col("s").alias(f"s{n}")
    )
    slack = F.col("da") + F.col("db")
    met = apart.select("a", "b", "l1").join(side("a"), "a").join(side("b"), "b").where(F.col("l1") - slack <= F.lit(radius) * _HAIR)
    open_ = met.where(_sketch_distance("sa", "sb") <= F.lit(radius) * _HAIR).select(
        F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("l1") + slack <= radius).alias("sure"),
        ((F.col("da") == 0) & (F.col("db") == 0)).alias("centres"), "l1",
    )
    open_ = stage(open_, "member_pairs")
    known = open_.where("centres OR sure").where(F.col("sure") | (F.col("l1") <= radius)).select("a", "b")
    rest = open_.where("NOT centres AND NOT sure")
    return stage(known.unionByName(distances(rest, weights).where(F.col("l1") <= radius).select("a", "b")), "member_links")
