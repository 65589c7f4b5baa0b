"""Matches of nearby points against the assignment on each label's whole matrix, with distances cut at the radius."""

import numpy as np
import pytest

from lattica.geometry import Geometry
from lattica.operators import skeleton, spatial
from lattica.operators.kernels import assignment

POINT = "label long, iv long, z long, y long, x long"
G = Geometry(8, 40, 40, (3, 2, 1))


def points(seed, n, labels):
    rng = np.random.default_rng(seed)
    ivs = sorted({int(v) for v in rng.integers(0, 8 * 40 * 40, n)})
    return [(1 + v % labels, v, v // 1600, v // 40 % 40, v % 40) for v in ivs]


def matched(spark, t, p, radius):
    got = spatial.nearby_matching(spark.createDataFrame(t, POINT), spark.createDataFrame(p, POINT), G, radius).collect()
    return sorted((r.label, r.truth_iv, r.proposed_iv, r.distance) for r in got)


def gap(a, b):
    return sum(((x - y) * r) ** 2 for x, y, r in zip(a[2:], b[2:], G.resolution, strict=True)) ** 0.5


@pytest.mark.parametrize(("seed", "radius"), [(1, 6), (2, 12), (3, 30)])
def test_matching_has_the_least_cost(spark, seed, radius):
    t, p = points(seed, 70, 3), points(seed + 50, 60, 3)
    got = matched(spark, t, p, radius)
    place = {("t", r[1]): r for r in t} | {("p", r[1]): r for r in p}
    assert len({g[1] for g in got}) == len({g[2] for g in got}) == len(got)
    assert got and all(g[3] < radius and abs(g[3] - gap(place["t", g[1]], place["p", g[2]])) < 1e-9 for g in got)
    for label in (1, 2, 3):
        a, b = [r for r in t if r[0] == label], [r for r in p if r[0] == label]
        cost = np.array([[min(gap(x, y), radius) for y in b] for x in a])
        best = sum(cost[i, j] for i, j in assignment(cost))
        own = [g[3] for g in got if g[0] == label]
        assert abs(sum(own) + radius * (min(len(a), len(b)) - len(own)) - best) < 1e-6


def test_far_partners_do_not_cost_a_near_match(spark):
    t, p = [(1, 10, 0, 0, 10), (1, 14, 0, 0, 14)], [(1, 13, 0, 0, 13)]
    assert matched(spark, t, p, 5) == [(1, 14, 13, 1.0)]
    # Equal points of both sides, repeated rows, another label at the radius, no points.
    assert matched(spark, t * 2, t, 3) == [(1, 10, 10, 0.0), (1, 14, 14, 0.0)]
    assert matched(spark, t, [(2, 13, 0, 0, 13)], 5) == [] and matched(spark, t, [], 5) == [] and matched(spark, t, p, 1) == []


def test_scores_of_nearby_matches(spark):
    t, p = (spark.createDataFrame(points(s, 40, 2), POINT) for s in (7, 8))
    m = spatial.nearby_matching(t, p, G, 20)
    one = skeleton.endpoint_scores(m, t, p).first()
    assert one.tp == m.count() and one.tp + one.fn == t.count() and one.tp + one.fp == p.count()
