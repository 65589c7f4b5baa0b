"""Neighbours and components over the faces of bricks, against brute force."""

import itertools

import numpy as np
import pytest

from lattica.operators import graph, neighbors
from lattica.plans import bricks


@pytest.fixture(params=[(32, 64, 64), (2, 3, 2), (1, 1, 1)])
def brick(request, monkeypatch):
    monkeypatch.setattr(bricks, "BRICK", request.param)


def volume(seed, shape=(5, 7, 6), labels=4, holes=0.1, low=(-3, 0, 5)):
    rng = np.random.default_rng(seed)
    out = {}
    for i, p in enumerate(np.ndindex(shape)):
        if rng.random() > holes:
            out[tuple(int(a + b) for a, b in zip(p, low, strict=True))] = (i, int(rng.integers(0, labels)), int(rng.integers(0, 99)))
    return out


def frame(spark, v):
    return spark.createDataFrame([(i, *p, label, c, c + 1, c + 2) for p, (i, label, c) in v.items()], "iv long, z long, y long, x long, label long, aff_z long, aff_y long, aff_x long").repartition(3)


def faces(v):
    for p, (i, label, c) in v.items():
        for axis, step in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))):
            q = tuple(a + b for a, b in zip(p, step, strict=True))
            if q in v and v[q][1] != label:
                yield p, axis, i, label, c, *v[q][:2]


def test_faces(spark, brick):
    v = volume(1)
    df = frame(spark, v)
    found = list(faces(v))
    got = neighbors.face_pairs(df).select("iv", "n_iv", "axis", "label", "n_label", "z", "n_z").collect()
    assert sorted((r.iv, r.n_iv, r.axis, r.label, r.n_label, r.n_z - r.z) for r in got) == sorted((i, j, "zyx"[a], la, lb, int(a == 0)) for _, a, i, la, _, j, lb in found)
    assert {tuple(r) for r in neighbors.adjacency(df).collect()} == {tuple(sorted((a, b))) for _, _, _, a, _, _, b in found if a and b}
    sums = {}
    for p, axis, _, a, c, _, b in found:
        s = sums.setdefault(tuple(sorted((a, b))), [0, 0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += c + axis
        for k in range(3):
            s[2 + k] += p[k] + 0.5 * (axis == k)
    assert {(r.label_one, r.label_two): (r.n, r.total) for r in neighbors.mean_affinity(df).collect()} == {k: (s[0], s[1]) for k, s in sums.items()}
    for r in neighbors.middle_boundary(df).collect():
        s = sums[r.label_one, r.label_two]
        assert np.allclose((r.z_mean, r.y_mean, r.x_mean), [x / s[0] for x in s[2:]])


@pytest.mark.parametrize("seed", [2, 3])
def test_components(spark, brick, seed):
    v = volume(seed, labels=3, holes=0.4)
    left, want = dict(v), {}
    while left:
        start = min(left, key=lambda p: v[p][0])
        stack, own = [start], []
        label = left.pop(start)[1]
        while stack:
            p = stack.pop()
            own.append(p)
            for o in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if q in left and left[q][1] == label:
                    del left[q]
                    stack.append(q)
        want |= {v[p][0]: (label, min(v[q][0] for q in own)) for p in own if label}
    got = {r.iv: (r.label, r.component) for r in graph.voxel_components(frame(spark, v)).collect()}
    assert got == want


def test_nothing(spark):
    df = frame(spark, volume(1)).where("label = 9")
    assert neighbors.adjacency(df).count() == neighbors.face_pairs(df).count() == graph.voxel_components(df).count() == graph.force_connectivity(df).count() == 0


@pytest.mark.parametrize("tile", [1, 3, 128])
def test_lifted_edges_are_best_paths(spark, tile):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(p)) for a, b, p in zip(rng.integers(0, 14, 22), rng.integers(0, 14, 22), rng.random(22) * 0.9, strict=True)] + [(50, 51, 0.0), (60, 60, 0.5), (70, 71, 1e-200), (71, 72, 1e-200)]
    best = {}
    for a, b, p in edges:
        if a != b and p > 0:
            for s, t in ((a, b), (b, a)):
                best[s, t] = max(best.get((s, t), 0.0), p)
    names = sorted({a for a, _ in best})
    for m in names:
        for a in names:
            for b in names:
                if a != b and (a, m) in best and (m, b) in best:
                    best[a, b] = max(best.get((a, b), 0.0), best[a, m] * best[m, b])
    got = {(r.v1, r.v2): r.p for r in graph.lifted_edges(spark.createDataFrame(edges, "v1 long, v2 long, p double"), tile).collect()}
    want = {k: p for k, p in best.items() if k[0] < k[1]}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
