"""All near-duplicate links of candidates, and greedy removal by batches, against all pairs."""

import numpy as np
import pytest

from marketloom.operators import dedup, neighbours
from marketloom.session import stage


def long_rows(x, ids=None):
    return [(int(ids[i]) if ids is not None else i, f"s{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v != 0]


def frame(spark, rows):
    return stage(spark.createDataFrame(rows, "cand_id bigint, symbol string, w double").repartition(3), "w")


def plain_counts(x, radius):
    d = np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2)
    equal = (x[:, None, :] == x[None, :, :]).all(axis=2)
    return {
        i: (int(np.flatnonzero(equal[i])[0]), int(equal[i].sum()) - 1, int((d[i] <= radius).sum()) - 1) for i in range(len(x))
    }


def counted(links):
    return {r.cand_id: (r.class_id, r.n_equal, r.n_links) for r in links.counts().collect()}


def test_links_of_mixed_candidates(spark):
    rng = np.random.default_rng(3)
    base = np.round(rng.dirichlet(np.ones(12), 40), 3)
    near = np.round(np.repeat(base[:15], 6, axis=0) + rng.choice([-0.004, 0.0, 0.004, 0.01], (90, 12)), 3)
    sparse = np.where(rng.random((30, 12)) < 0.7, 0.0, np.round(rng.random((30, 12)) * 0.02, 3))
    x = np.concatenate([base, near, sparse, base[:8], np.full((5, 12), 0.083)])
    x = x[np.abs(x).sum(axis=1) > 0]
    got = counted(neighbours.near_links(frame(spark, long_rows(x)), 0.0301))
    expected = plain_counts(x, 0.0301)
    assert got == expected
    assert {v[2] for v in expected.values()} >= {0, 1}


def test_explicit_zeros_and_nulls_are_absent_names(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.0), (2, "a", 0.5), (3, "a", 0.5), (3, "b", None), (4, "a", -0.0), (5, "b", 0.0), (6, "c", 0.009)]
    got = counted(neighbours.near_links(frame(spark, rows), 0.01))
    assert got == {1: (1, 2, 2), 2: (1, 2, 2), 3: (1, 2, 2), 4: (4, 1, 2), 5: (4, 1, 2), 6: (6, 0, 2)}
    assert neighbours.near_links(frame(spark, rows).limit(0), 0.01).counts().count() == 0


def test_a_crowd_is_linked_without_pairs(spark):
    """Distinct copies close together: their number of links is that of all pairs, their pairs are never made."""
    rng = np.random.default_rng(5)
    centre = rng.dirichlet(np.ones(20))
    x = centre + rng.uniform(-1, 1, (400, 20)) * 1e-5
    links = neighbours.near_links(frame(spark, long_rows(x)), 0.02)
    assert counted(links) == plain_counts(x, 0.02)
    assert links.pairs.count() == 0
    assert links.balls.select("ball").distinct().count() <= 8


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_greedy_by_batches(spark, batch):
    """Objectives that follow a projection, so that each candidate's fate hangs on the one before it."""
    t = np.arange(60) * 0.012
    x = np.stack([0.5 + t, 0.5 - t], axis=1)
    obj = {i: -i / 7 for i in range(60)}
    obj[13] = obj[14]
    kept = []
    for i in sorted(obj, key=lambda i: (-obj[i], i)):
        if all(np.abs(x[i] - x[j]).sum() > 0.05 for j in kept):
            kept.append(i)
    scored = stage(spark.createDataFrame(list(obj.items()), "cand_id bigint, obj double"), "s")
    got = dedup.greedy_keep(scored, frame(spark, long_rows(x)), 0.05, 9, batch).orderBy("place").collect()
    assert [(r.cand_id, r.place) for r in got] == [(c, i + 1) for i, c in enumerate(kept[:9])]


def test_greedy_with_empty_portfolios(spark):
    scored = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 3.0), (4, 2.0), (5, None)], "cand_id bigint, obj double")
    weights = frame(spark, [(2, "a", 0.5), (3, "b", 0.004), (4, "a", 0.505)])
    for batch in (1, 5):
        got = dedup.greedy_keep(scored, weights, 0.01, 4, batch).orderBy("place").collect()
        assert [r.cand_id for r in got] == [1, 2]
    assert dedup.greedy_keep(scored.limit(0), weights, 0.01).count() == 0


@pytest.mark.parametrize("cells", [0.9, 64])
def test_scattered_balls_meet_few_others(spark, monkeypatch, cells):
    """Balls are cut into ever smaller cells: what meets is a small part of all pairs, and no link is lost at a cut."""
    rng = np.random.default_rng(8)
    base = rng.dirichlet(np.ones(24), 240)
    x = np.concatenate([base, base[:120] + rng.uniform(-1, 1, (120, 24)) * 9e-4])
    met = []
    cells_of = neighbours._cells

    def counted_cells(centres, radius):
        left, right = cells_of(centres, radius)
        met.append((centres.count(), left.join(right, "cell").where("own <> cell OR a < b").count(), left.count()))
        return left, right

    monkeypatch.setattr(neighbours, "LEAF", 4)
    monkeypatch.setattr(neighbours, "MOST_CELLS", cells)
    monkeypatch.setattr(neighbours, "_cells", counted_cells)
    got = counted(neighbours.near_links(frame(spark, long_rows(x)), 0.02))
    assert got == plain_counts(x, 0.02) and sum(v[2] for v in got.values()) > 100
    [(n, pairs, copies)] = met
    assert pairs <= n * (n - 1) / 2 and copies <= cells * n * 1.01 + n
    if cells == 64:
        assert pairs < n * n / 20
