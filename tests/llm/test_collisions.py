"""Vectors of few dimensions against all pairs."""

from __future__ import annotations

import numpy as np

from askmill.llm import collisions


def turned(unit, cosine, rng):
    turn = rng.standard_normal(unit.shape)
    turn -= (turn * unit).sum(axis=1, keepdims=True) * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)


def test_pairs_at_the_threshold_collide_in_few_dimensions():
    rng = np.random.default_rng(9)
    for dimension in range(2, 9):
        unit = rng.standard_normal((1000, dimension))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        projections = collisions.projections_for(unit)
        one, two = (collisions.extremes(v, projections) for v in (unit, turned(unit, 0.951, rng)))
        codes, values = (np.concatenate(x) for x in zip(one, two, strict=True))
        at = np.arange(1000)
        hit = collisions.collisions(codes, values, at, at + 1000, collisions.half_window(0.95, dimension)).sum(axis=1)
        assert (hit >= 2).mean() >= 0.97, dimension
    assert collisions.projections_for(rng.standard_normal((500, 64))) == collisions.PROJECTIONS


def test_near_duplicates_of_few_dimensions_equal_all_pairs(spark):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for dimension in range(2, 9):
        unit = rng.standard_normal((40, dimension))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        own = np.concatenate([unit, turned(unit, 0.955, rng)])
        near = (own @ own.T >= 0.95).sum(axis=1) - 1
        for i, v in enumerate(own.tolist()):
            want[dimension * 1000 + i] = int(near[i])
            rows.append((dimension * 1000 + i, v))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in collisions.near_duplicates(docs).collect()}
    for dimension in range(2, 9):
        ids = [i for i in want if i // 1000 == dimension]
        assert all(got[i] <= want[i] for i in ids)
        assert sum(got[i] for i in ids) >= 0.97 * sum(want[i] for i in ids), dimension
