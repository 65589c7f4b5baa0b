"""Thinning, masks and fields over many boxes, against one box, the kernels and brute force."""

import itertools

import numpy as np
import pytest

from lattica.geometry import Geometry
from lattica.operators import graph, kernels, neighbors, skeleton
from lattica.plans import bricks

SCHEMA = "iv long, z long, y long, x long, label long"


@pytest.fixture(params=[(64, 128, 256), (8, 12, 16)], ids=["one box", "many boxes"])
def boxes(request, monkeypatch):
    for module in (skeleton, neighbors, graph):
        monkeypatch.setattr(module, "BOX", request.param)
    if request.param[0] < 64:
        monkeypatch.setattr(bricks, "LINES", 40)


def blobs(seed, shape=(9, 11, 14), labels=3):
    """A volume of a few thick labels with holes."""
    rng = np.random.default_rng(seed)
    out = np.zeros(shape, np.int64)
    for _ in range(9):
        at, size = rng.integers(0, shape), rng.integers(2, 7, 3)
        out[tuple(slice(a, a + s) for a, s in zip(at, size, strict=True))] = rng.integers(1, labels + 1)
    out[rng.random(shape) < 0.03] = 0
    return out


def frame(spark, box, low=(0, 0, 0)):
    return spark.createDataFrame([(i, *(int(a + b) for a, b in zip(p, low, strict=True)), int(v)) for i, (p, v) in enumerate(np.ndenumerate(box))], SCHEMA).repartition(3)


def euler(points):
    """Euler number of a union of closed voxels: corners - edges + faces - voxels."""
    cells = [set(), set(), set(), set()]
    for p in points:
        for d in itertools.product((-1, 0, 1), repeat=3):
            cells[3 - sum(map(abs, d))].add(tuple(2 * a + b for a, b in zip(p, d, strict=True)))
    return sum((-1) ** k * len(c) for k, c in enumerate(cells))


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("name", ["thinning", "medial_axis"])
def test_thinning_of_boxes_is_that_of_one_box(spark, boxes, seed, name):
    box = blobs(seed)
    got = getattr(skeleton, name)(frame(spark, box)).collect()
    kernel = kernels.thin if name == "thinning" else kernels.medial
    want = {}
    for label in np.unique(box[box > 0]):
        points = np.argwhere(box == label)
        left = points[kernel(points)]
        for p, end in zip(left, kernels.few_neighbours(left), strict=True):
            want[int(np.ravel_multi_index(p, box.shape))] = (int(label), bool(end))
    assert {r.iv: (r.label, r.is_endpoint) for r in got} == want and len(got) == len(want)


def test_labels_that_overlap_are_thinned_apart(spark, boxes):
    """Cells of a coarser grid: several labels have the same place."""
    own = {label: np.argwhere(blobs(label, labels=1) > 0) for label in (1, 2, 3)}
    rows = [(10_000 * label + i, *map(int, p), label) for label, points in own.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.label, r.iv): r.is_endpoint for r in skeleton.thinning(df).collect()}
    mask = {(r.label, r.iv): r.n for r in neighbors.neighbour_mask(df).collect()}
    field = {(r.label, r.iv): r.dbf for r in skeleton.dbf_3d(df).collect()}
    want = {}
    for label, points in own.items():
        stays = kernels.thin(points)
        want |= {(label, 10_000 * label + int(i)): bool(e) for i, e in zip(np.flatnonzero(stays), kernels.few_neighbours(points[stays]), strict=True)}
        here = set(map(tuple, points.tolist()))
        for i, (p, d) in enumerate(zip(points.tolist(), kernels.boundary_distance(points), strict=True)):
            assert mask[label, 10_000 * label + i] == sum(tuple(a + b for a, b in zip(p, o, strict=True)) in here for o in kernels.OFFSETS_26)
            assert field[label, 10_000 * label + i] == round(float(d), 6)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kernel", [kernels.thin, kernels.medial])
def test_thinning_keeps_topology(seed, kernel):
    points = np.argwhere(blobs(seed, labels=1) > 0)
    left = points[kernel(points)]
    assert len(left) < len(points) and euler(left.tolist()) == euler(points.tolist())
    assert len(np.unique(kernels.parts_of(left))) == len(np.unique(kernels.parts_of(points)))


def test_a_label_over_many_boxes(spark, monkeypatch):
    """A bar over many boxes becomes one curve with two ends."""
    monkeypatch.setattr(skeleton, "BOX", (64, 64, 20))
    points = [(z, y, x) for z in range(3) for y in range(3) for x in range(300)]
    df = spark.createDataFrame([(i, *p, 7) for i, p in enumerate(points)], SCHEMA)
    got = skeleton.thinning(df).collect()
    assert sum(r.is_endpoint for r in got) == 2 and 290 <= len(got) <= 300


def brute_parts(cube, start_in, near):
    left = {p for p in itertools.product(range(3), repeat=3) if cube[p] and p != (1, 1, 1)}
    found = 0
    while left:
        stack, hit = [left.pop()], False
        while stack:
            p = stack.pop()
            hit |= p in start_in
            for o in near:
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if q in left:
                    left.remove(q)
                    stack.append(q)
        found += hit
    return found


def test_simple_points_and_isthmuses():
    rng = np.random.default_rng(0)
    masks = [0, 2**26 - 1, *(int(rng.integers(0, 2**26)) & (int(rng.integers(0, 2**26)) if i % 2 else -1) for i in range(600))]
    simple, isthmus = kernels.topology(np.array(masks))
    eighteen = np.array([sum(map(abs, o)) <= 2 for o in itertools.product((-1, 0, 1), repeat=3)]).reshape(3, 3, 3)
    everything, faces = set(itertools.product(range(3), repeat=3)), {tuple(1 + a for a in f) for f in kernels.FACES}
    for i, m in enumerate(masks):
        cube = np.zeros((3, 3, 3), bool)
        cube[1, 1, 1] = True
        for k, o in enumerate(kernels.OFFSETS_26):
            cube[tuple(1 + a for a in o)] = m >> k & 1
        objects, holes = brute_parts(cube, everything, kernels.OFFSETS_26), brute_parts(~cube & eighteen, faces, kernels.FACES)
        assert (simple[i], isthmus[i]) == (objects == 1 and holes == 1, objects > 1)


def test_neighbour_masks(spark, boxes):
    box = blobs(2)
    got = {r.iv: (r.mask, r.n) for r in neighbors.neighbour_mask(frame(spark, box, (-5, 3, 0))).collect()}
    padded = np.pad(box, 1, constant_values=-1)
    for i, p in enumerate(np.ndindex(box.shape)):
        mask = sum(1 << k for k, o in enumerate(kernels.OFFSETS_26) if padded[tuple(a + b + 1 for a, b in zip(p, o, strict=True))] == box[p])
        assert got[i] == (mask, mask.bit_count())


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_boundary_and_dilation_in_planes(spark, boxes, distance):
    box = blobs(3, (4, 9, 12))
    df = frame(spark, box)
    edge = np.zeros(box.shape, bool)
    for axis, step in itertools.product((1, 2), (-1, 1)):
        other = np.roll(box, step, axis)
        there = np.ones(box.shape, bool)
        there[tuple(slice(None) if a != axis else (0 if step == 1 else -1) for a in range(3))] = False
        edge |= (other != box) & there
    assert {r.iv for r in neighbors.plane_boundary(df).collect()} == set(np.flatnonzero(edge).tolist())
    want = box.copy()
    for p in np.ndindex(box.shape):
        if any(edge[p[0], y, x] and (y - p[1]) ** 2 + (x - p[2]) ** 2 <= distance**2 for y in range(box.shape[1]) for x in range(box.shape[2])):
            want[p] = 0
    got = {r.iv: r.label for r in neighbors.dilate_gold(df, distance).collect()}
    assert [got[i] for i in range(box.size)] == want.ravel().tolist()


@pytest.mark.parametrize("seed", range(3))
def test_envelopes_of_many_lines(seed):
    rng = np.random.default_rng(seed)
    costs = np.where(rng.random((200, 23)) < 0.5, kernels.FAR, rng.integers(0, 90, (200, 23)))
    costs[0] = kernels.FAR
    want = np.array([kernels.lower_envelope(row) for row in costs])
    got = kernels.envelopes(costs, block=100)
    assert (np.where(got < kernels.FAR, got, kernels.FAR) == np.where(want < kernels.FAR, want, kernels.FAR)).all()
    line = np.repeat(np.arange(60), rng.integers(1, 9, 60))
    values = rng.integers(0, 50, len(line))
    got = kernels.envelopes_of_runs(line, values)
    for k in range(60):
        assert got[line == k].tolist() == kernels.lower_envelope(values[line == k]).tolist()


@pytest.mark.parametrize("seed", [4, 5])
def test_distance_from_boundary_of_many_boxes(spark, boxes, seed):
    box = blobs(seed)
    got = {r.iv: r.dbf for r in skeleton.dbf_3d(frame(spark, box, (2, -7, 1))).collect()}
    assert len(got) == (box > 0).sum()
    for label in np.unique(box[box > 0]):
        points = np.argwhere(box == label)
        for p, d in zip(points, kernels.boundary_distance(points), strict=True):
            assert got[int(np.ravel_multi_index(p, box.shape))] == round(float(d), 6)


def test_plane_distances_of_many_boxes(spark, boxes):
    box = blobs(6, (3, 13, 10))
    box[2] = 5
    df = frame(spark, box).where("iv % 17 <> 3")
    there = (np.arange(box.size) % 17 != 3).reshape(box.shape)
    got = {r.iv: r.distance for r in skeleton.distance_transform_2d(df, Geometry(*box.shape)).collect()}
    edges = {r.iv for r in neighbors.plane_boundary(df).collect()}
    places = [np.unravel_index(e, box.shape) for e in edges]
    for p in np.argwhere(there):
        near = [(q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2 for q in places if q[0] == p[0]]
        want = round(min(near) ** 0.5, 6) if near else None
        assert got[int(np.ravel_multi_index(p, box.shape))] == want
    assert len(got) == there.sum()


@pytest.mark.parametrize("seed", [7, 8])
def test_geodesic_field_of_many_boxes(spark, boxes, seed):
    from pyspark.sql import functions as F

    box = blobs(seed)
    df = frame(spark, box).withColumn("cost", (F.col("iv") * 37 % 11).cast("double") / 3)
    for penalty in (None, "cost"):
        got = {r.iv: r.distance for r in graph.voxel_geodesic(df, penalty=penalty).collect()}
        assert len(got) == (box > 0).sum()
        for label in np.unique(box[box > 0]):
            points = np.argwhere(box == label)
            ivs = np.ravel_multi_index(points.T, box.shape)
            want, _ = kernels.geodesic(points, (ivs * 37 % 11) / 3 if penalty else np.zeros(len(points)), 0)
            for iv, d in zip(ivs.tolist(), want, strict=True):
                assert got[iv] is None if np.isinf(d) else got[iv] == pytest.approx(d)


def test_a_path_through_hundreds_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(graph, "BOX", (1, 8, 3))
    snake = [(0, y, x) for y in range(0, 9, 2) for x in range(12)] + [(0, y, 11 if y % 4 == 1 else 0) for y in range(1, 9, 2)]
    df = spark.createDataFrame([(i, *p, 1) for i, p in enumerate(sorted(snake))], SCHEMA)
    points = np.array(sorted(snake))
    want, _ = kernels.geodesic(points, np.zeros(len(points)), 0)
    got = {r.iv: r.distance for r in graph.voxel_geodesic(df).collect()}
    assert [got[i] for i in range(len(points))] == pytest.approx(want.tolist()) and max(want) > 40


@pytest.mark.parametrize(("reach", "expansion"), [(3, 1.5), (2, 1.1)])
def test_endpoints_by_paths_of_many_boxes(spark, boxes, reach, expansion):
    box = blobs(9)
    rng = np.random.default_rng(9)
    chosen = np.flatnonzero((box.ravel() > 0) & (rng.random(box.size) < 0.08))
    points = spark.createDataFrame([(int(box.ravel()[i]), int(i)) for i in chosen], "label long, up_iv long")
    got = {r.iv: (r.label, r.is_endpoint) for r in skeleton.upsample_endpoints(points, frame(spark, box), reach=reach, expansion=expansion).collect()}
    want = {}
    for label in np.unique(box[box > 0]):
        own = [int(i) for i in chosen if box.ravel()[i] == label]
        at = [tuple(map(int, np.unravel_index(i, box.shape))) for i in own]
        ends = kernels.lonely({tuple(map(int, p)) for p in np.argwhere(box == label)}, at, reach, expansion)
        want |= {i: (int(label), bool(e)) for i, e in zip(own, ends, strict=True)}
    assert got == want and len({e for _, e in want.values()}) == 2


@pytest.mark.parametrize("run", [skeleton.thinning, skeleton.medial_axis, skeleton.dbf_3d, graph.voxel_geodesic, neighbors.neighbour_mask, neighbors.plane_boundary])
def test_nothing(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
