import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.operators import kernels as k


def volume(box):
    return np.argwhere(np.asarray(box, dtype=bool))


LINE = volume(np.ones((1, 1, 5)))
PLANE = volume(np.ones((1, 4, 4)))
CUBE = volume(np.ones((4, 4, 4)))
HOLLOW = volume(np.pad(np.zeros((3, 3, 3)), 1, constant_values=1))
SHAPES = {"line": LINE, "plane": PLANE, "cube": CUBE, "hollow": HOLLOW, "voxel": volume(np.ones((1, 1, 1)))}


def brute_distance(cost):
    places = list(itertools.product(*map(range, cost.shape)))
    out = np.zeros(cost.shape, dtype=np.int64)
    for p in places:
        out[p] = min(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) + cost[q] for q in places)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0, 1, k.FAR]), min_size=12, max_size=12))
def test_distance_transform_equals_brute_force(values):
    cost = np.array(values, dtype=np.int64).reshape(3, 4)
    got, want = k.squared_distance(cost), brute_distance(cost)
    near = want < k.FAR
    assert (got[near] == want[near]).all() and (got[~near] >= k.FAR).all()


def test_boundary_distance_of_a_cube():
    field = k.boundary_distance(volume(np.ones((5, 5, 5))))
    assert field.max() == pytest.approx(5**0.5) and field.min() == 1.0


@pytest.mark.parametrize("shape", list(SHAPES))
def test_thinning_keeps_parts(shape):
    points = SHAPES[shape]
    left = points[k.thin(points)]
    assert len(np.unique(k.parts_of(left))) == len(np.unique(k.parts_of(points)))
    assert len(left) <= len(points)


def test_thinning_is_stable_and_thin():
    rod = volume(np.ones((3, 3, 12)))
    left = rod[k.thin(rod)]
    assert len(left) < len(rod) / 4
    # isthmuses are frozen when first met, so a second run can take the two ends only
    assert k.thin(left).sum() >= len(left) - 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.booleans(), min_size=48, max_size=48).filter(any))
def test_thinning_keeps_parts_of_any_volume(bits):
    points = volume(np.array(bits).reshape(3, 4, 4))
    left = points[k.thin(points)]
    assert len(np.unique(k.parts_of(left))) == len(np.unique(k.parts_of(points)))


def test_geodesic_steps():
    d, before = k.geodesic(LINE, np.zeros(5), 0)
    assert d.tolist() == [0, 1, 2, 3, 4] and before.tolist() == [-1, 0, 1, 2, 3]
    two = np.array([[0, 0, 0], [1, 1, 1], [5, 5, 5]])
    d, _ = k.geodesic(two, np.array([0.0, 2.0, 0.0]), 0)
    assert d[1] == pytest.approx(3**0.5 + 2) and np.isinf(d[2])


@pytest.mark.parametrize("shape", list(SHAPES))
def test_teaser_reaches_and_connects(shape):
    points = SHAPES[shape]
    left = points[k.teaser(points)]
    assert len(left) and len(np.unique(k.parts_of(left))) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = k.assignment(cost)
    assert len(got) == min(n, m)
    total = sum(cost[i, j] for i, j in got)
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
    assert total == pytest.approx(best)


def naive_contraction(edges):
    """Contract the heaviest positive pair of clusters, again and again."""
    clusters = {v: {v} for e in edges for v in e[:2]}

    def between(a, b):
        return sum(w for x, y, w in edges if (x in clusters[a] and y in clusters[b]) or (x in clusters[b] and y in clusters[a]))

    while True:
        pairs = [(-between(a, b), a, b) for a, b in itertools.combinations(sorted(clusters), 2)]
        pairs = [p for p in pairs if p[0] < 0]
        if not pairs:
            return {v: r for r, own in clusters.items() for v in own}
        _, a, b = min(pairs)
        clusters[a] |= clusters.pop(b)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_contraction_equals_naive(seed):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(rng.choice(7, 2, replace=False).tolist())) for _ in range(12)}
    edges = [(a, b, float(rng.integers(-64, 64)) / 8) for a, b in sorted(pairs)]
    assert k.contract(edges) == naive_contraction(edges)


@pytest.mark.parametrize("seed", range(20))
def test_contraction_on_a_matrix_equals_that_of_pairs(seed):
    rng = np.random.default_rng(seed)
    pairs = np.array([(7 * a, 7 * b) for a in range(14) for b in range(a + 1, 14)])
    weight, original = rng.integers(-6, 5, len(pairs)).astype(float), rng.random(len(pairs)) < 0.4
    rows = [(int(a), int(b), float(w)) for (a, b), w in zip(pairs, weight, strict=True)]
    roots = k.contract([r for r, o in zip(rows, original, strict=True) if o], [r for r, o in zip(rows, original, strict=True) if not o])
    got = k.contract_complete(pairs[:, 0], pairs[:, 1], weight, original)
    assert got.tolist() == [roots[a] != roots[b] for (a, b, _), o in zip(rows, original, strict=True) if o]


def test_lifted_pairs_alone_are_never_contracted():
    roots = k.contract([(0, 1, -1.0), (1, 2, 1.0)], [(0, 2, 5.0)])
    assert roots == {0: 0, 1: 0, 2: 0}
    assert k.contract([(0, 1, -1.0)], [(0, 2, 5.0)])[2] == 2


def test_paths():
    assert k.has_path({tuple(p) for p in LINE.tolist()}, (0, 0, 0), (0, 0, 4))
    assert not k.has_path({(0, 0, 0), (0, 0, 3)}, (0, 0, 0), (0, 0, 3))


@pytest.mark.parametrize("shape", list(SHAPES))
def test_medial_axis_keeps_parts_and_ends(shape):
    points = SHAPES[shape]
    left = points[k.medial(points)]
    assert len(np.unique(k.parts_of(left))) == len(np.unique(k.parts_of(points)))
    # what is left is stable: ends stay, and nothing else can go
    assert k.medial(left).all()


def test_medial_axis_of_a_line_is_the_line():
    assert k.medial(LINE).all() and k.few_neighbours(LINE).sum() == 2


@pytest.mark.parametrize("reach", [0, 1, 3])
def test_pairs_within_a_reach(reach):
    rng = np.random.default_rng(reach)
    points = [tuple(p) for p in rng.integers(-9, 9, (60, 3)).tolist()]
    want = {(i, j) for j in range(60) for i in range(j) if max(abs(u - v) for u, v in zip(points[i], points[j], strict=True)) <= reach}
    got = k.pairs_within(points, reach)
    assert set(got) == want and len(got) == len(want)
