"""Steps whose cost must not run ahead of the input."""

import numpy as np
import pytest

from lattica import fixtures as fx
from lattica.operators import spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_never_broadcast(spark, sf_dir):
    points = fx.points(spark, sf_dir)
    assert "BroadcastHashJoin" not in plan_of(spatial.binned_join(points, points, (100,) * 3))
    own = spark.createDataFrame([(i, i, 0, 0) for i in range(20)], "label long, z long, y long, x long")
    assert "BroadcastHashJoin" not in plan_of(spatial.binned_join(own, own, (2, 2, 2), by=["label"], half=True))


def test_a_cone_joins_nothing(spark, sf_dir):
    """Voxels are looked up in boxes; the cells around endpoints are neither exploded nor joined with voxels."""
    ends = fx.endpoints(spark, sf_dir).localCheckpoint()
    found = spatial.endpoint_cone(ends, fx.labels(spark, sf_dir), fx.geometry(spark, sf_dir), fx.REACH)
    assert "Join" not in plan_of(found)


def test_triangles_of_all_labels_at_once():
    """Those of each label on its own, in the same order."""
    from lattica.operators import surface

    volume = np.random.default_rng(5).integers(0, 40, (9, 8, 10))
    points = np.argwhere(volume > 0) - (3, 0, 2)
    labels = volume[volume > 0] * 7
    of, got = surface.triangles_of(*surface.cut_cubes(points, labels))
    at = 0
    for name in np.unique(labels):
        want, _ = surface.isosurface(points[labels == name])
        assert (of[at : at + len(want)] == name).all() and (got[at : at + len(want)] == want).all()
        at += len(want)
    assert at == len(got)


@pytest.mark.parametrize("rate", [1, 2])
def test_corners_and_sizes_are_those_of_the_mesh(spark, monkeypatch, rate):
    from lattica.operators import surface

    monkeypatch.setattr(surface, "BOX", (3, 4, 5))
    volume = np.random.default_rng(6).integers(0, 4, (7, 8, 9))
    rows = [(*map(int, p - 2), int(volume[tuple(p)])) for p in np.argwhere(volume >= 0)]
    df = spark.createDataFrame(rows, "z int, y int, x int, label long").localCheckpoint()
    found = surface.mesh(df, rate)
    assert sorted(map(tuple, surface.mesh_vertices(df, rate).collect())) == sorted(map(tuple, surface.vertices(found).collect()))
    assert sorted(map(tuple, surface.mesh_sizes(df, rate).collect())) == sorted(map(tuple, found.groupBy("label").count().collect()))
    assert "Exchange hashpartitioning(label" not in plan_of(surface.mesh_vertices(df))


def test_a_sweep_takes_labels_together(spark, sf_dir, monkeypatch):
    """A few tasks for all labels, and the same counts however labels are dealt."""
    from lattica.operators import skeleton, sweep

    labels, g = fx.labels(spark, sf_dir).localCheckpoint(), fx.geometry(spark, sf_dir)
    truth = skeleton.skeleton_endpoints(fx.skeleton_points(spark, sf_dir)).localCheckpoint()
    found = []
    for together in (1 << 15, 50):
        monkeypatch.setattr(sweep, "TOGETHER", together)
        scores = sweep.endpoint_sweep(labels, truth, g, (60,), (0, 15), (13,), (2,))
        assert "bundle" in plan_of(scores)
        found.append(sorted(map(tuple, scores.collect())))
    assert found[0] == found[1] and len(found[0]) == 5


@pytest.mark.parametrize("shape", [(1, 1, 1), (4, 5, 6), (9, 20, 21)])
def test_boundary_distance_without_a_search_of_each_line(monkeypatch, shape):
    from lattica.operators import kernels

    points = np.argwhere(np.random.default_rng(1).random(shape) < 0.97)
    points = points if len(points) else np.zeros((1, 3), np.int64)
    box, low = kernels.grid_of(points)
    edge = np.array([any(not box[tuple(p - low + f)] for f in kernels.FACES) for p in points])
    edges, empty = points[edge], np.argwhere(~box) + low
    want = [1 if e else min(((p - empty) ** 2).sum(axis=1).min(), ((p - edges) ** 2).sum(axis=1).min() + 1) for p, e in zip(points, edge, strict=True)]
    monkeypatch.setattr(kernels, "lower_envelope", None)
    assert np.array_equal(kernels.boundary_distance(points), np.sqrt(np.array(want, float)))


def test_triangles_are_numbered_without_a_sort_of_them(spark, sf_dir):
    from lattica.operators import surface

    shown = surface.marching(fx.labels(spark, sf_dir))
    assert "row_number" not in plan_of(shown)
    own = [r.ordinal for r in shown.where("label = 1").collect()]
    assert sorted(own) == list(range(len(own))) and own


@pytest.mark.parametrize("tile", [8, 100])
def test_best_paths_go_over_borders(spark, monkeypatch, tile):
    """Every pair of a long volume's components without a pivot over all blocks, also where only an edge of no worth links some."""
    from lattica.operators import paths

    rng, edges = np.random.default_rng(9), {}
    for layer in range(30):
        for k in range(2):
            v = 2 * layer + k - 7
            for other in ([v + 1] if k == 0 else []) + ([v + 2] if layer < 29 else []):
                edges[v, other] = float(rng.random())
    edges |= {(100, 101): 0.5, (101, 102): 0.25, (100, 102): 0.0, (52, 100): 0.0, (200, 201): 1e-200, (201, 202): 1e-200}
    seen, whole = [], paths._whole
    monkeypatch.setattr(paths, "_whole", lambda shut, links: seen.append(shut.groupBy("root").count().agg({"count": "max"}).first()[0]) or whole(shut, links))
    df = spark.createDataFrame([(*e, p) for e, p in edges.items()], "v1 long, v2 long, p double")
    got = {(r.v1, r.v2): (r.p, r.original) for r in paths.lifted_pairs(df, tile).collect()}
    names = sorted({v for e in edges for v in e})
    best = np.zeros((len(names),) * 2)
    joined = np.zeros(best.shape, bool)
    for (a, b), p in edges.items():
        i, j = names.index(a), names.index(b)
        best[i, j] = best[j, i] = p
        joined[i, j] = joined[j, i] = p > 0
    for k in range(len(names)):
        best, joined = np.maximum(best, best[:, k, None] * best[k]), joined | joined[:, k, None] & joined[k]
    want = {(a, b): best[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i < j and joined[i, j]}
    assert got.keys() == want.keys() and all(np.isclose(got[k][0], want[k], rtol=1e-12, atol=0) for k in want)
    assert {k for k in got if got[k][1]} == edges.keys() & want.keys()
    assert seen == [1]


def best_of_all(edges):
    """Best products and connection of all pairs, from {(a, b): p} with a < b."""
    names = sorted({v for e in edges for v in e})
    best = np.zeros((len(names),) * 2)
    joined = np.zeros(best.shape, bool)
    for (a, b), p in edges.items():
        i, j = names.index(a), names.index(b)
        best[i, j] = best[j, i] = p or 0.0
        joined[i, j] = joined[j, i] = (p or 0.0) > 0
    for k in range(len(names)):
        best, joined = np.maximum(best, best[:, k, None] * best[k]), joined | joined[:, k, None] & joined[k]
    return {(a, b): best[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i < j and joined[i, j]}


def layered(layers, wide, rng, ahead=1.0):
    edges = {(wide * z + k, wide * z + k + 1): float(rng.random()) for z in range(layers) for k in range(wide - 1)}
    return edges | {(wide * z + k, wide * z + k + wide): float(ahead * rng.random()) for z in range(layers - 1) for k in range(wide)}


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_shuffles_of_best_paths_grow_with_labels_not_with_pairs(spark, monkeypatch):
    """No row or matrix for each two blocks is dealt to tasks; four times the labels are 16 times the pairs."""
    from lattica.operators import paths

    monkeypatch.setattr(paths, "LEAST", 1, raising=False)
    written, rng = [], np.random.default_rng(41)
    for layers in (120, 480):
        df = spark.createDataFrame([(*e, p) for e, p in layered(layers, 2, rng).items()], "v1 long, v2 long, p double").localCheckpoint()
        before = shuffled(spark)
        assert paths.lifted_pairs(df, 16).count() == layers * (2 * layers - 1)
        written.append(sum(n for k, n in shuffled(spark).items() if k not in before))
    assert written[1] < 6 * written[0]


def test_shuffles_of_lifted_weights_grow_with_labels_not_with_pairs(spark, monkeypatch):
    from lattica.operators import partition, paths

    monkeypatch.setattr(paths, "LEAST", 1, raising=False)
    monkeypatch.setattr(partition, "lifted_pairs", lambda own: paths.lifted_pairs(own, 16))
    written, rng = [], np.random.default_rng(42)
    for layers in (100, 400):
        edges = layered(layers, 2, rng)
        df = spark.createDataFrame([(*e, p) for e, p in edges.items()], "v1 long, v2 long, p double").localCheckpoint()
        before = shuffled(spark)
        found = partition.lifted_weights(df).selectExpr("count(*) n", "count_if(original) edges", "count(weight) weighed").first()
        assert tuple(found) == (layers * (2 * layers - 1), len(edges), layers * (2 * layers - 1))
        written.append(sum(n for k, n in shuffled(spark).items() if k not in before))
    assert written[1] < 6 * written[0]


@pytest.mark.parametrize("most", [1, 700])
def test_pairs_of_sides_are_all_pairs(spark, monkeypatch, most):
    """However the leaves of a level are cut into sides, also over several components and with edges of no worth."""
    from lattica.operators import paths

    rng = np.random.default_rng(17)
    edges = layered(40, 3, rng) | {(a + 1000, b + 1000): p for (a, b), p in layered(7, 3, rng, 1e-100).items()} | {(2000, 2001): 0.5}
    edges |= {(0, 100): 0.0, (3, 1001): 0.0, (1000, 1018): None, (50, 90): None}
    monkeypatch.setattr(paths, "LEAST", 1)
    monkeypatch.setattr(paths, "MOST", most)
    got = paths.lifted_pairs(spark.createDataFrame([(*e, p) for e, p in edges.items()], "v1 long, v2 long, p double"), 8).collect()
    want = best_of_all(edges)
    assert len(got) == len(want) == 120 * 119 // 2 + 21 * 20 // 2 + 1
    assert {(r.v1, r.v2): r.original for r in got} == {k: k in edges for k in want}
    assert all(np.isclose(r.p, want[r.v1, r.v2], rtol=1e-12, atol=0) for r in got)


def test_blocks_are_closed_in_tasks_of_their_own(spark):
    """Also after a join by the same keys: their bytes do not put them together."""
    from lattica.operators import paths

    one = spark.range(40).selectExpr("id root", "cast(id as int) b").localCheckpoint()
    two = one.selectExpr("root", "b", "b + 1 n").hint("merge")
    found = paths._each(one.hint("merge").join(two, ["root", "b"]), lambda pdf, r: pdf, "root long, b int, n int", ("root", "b"))
    assert found.selectExpr("spark_partition_id() at").distinct().count() == 4
    assert sorted(map(tuple, found.collect())) == [(k, k, k + 1) for k in range(40)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_closure_over_64_places_at_a_time(n):
    from lattica.operators import kernels

    rng = np.random.default_rng(n)
    m = np.where(rng.random((n, n)) < 4 / max(n, 1), rng.random((n, n)), 0.0)
    want = m.copy()
    for t in range(n):
        want = np.maximum(want, want[:, t, None] * want[t])
    assert np.allclose(kernels.best_products(m), want, rtol=1e-13, atol=0)


def test_rows_that_are_multiples_of_others():
    from lattica.operators import kernels

    rng = np.random.default_rng(3)
    base = rng.random((5, 7)) * (rng.random((5, 7)) < 0.7)
    base[4] = 0
    for most in (1, 3, 32):
        rows = base[[0, 1, 0, 2, 4, 3, 0, 4]] * np.array([1, 0.5, 1e-200, 0.3, 1, 1, 0.7, 1])[:, None]
        scale, kind, units = kernels.multiples(rows, most)
        assert np.allclose(scale[:, None] * units[kind], rows, rtol=1e-12, atol=0)
        assert most < 32 or len(units) == 5
    scale, kind, units = kernels.multiples(np.zeros((0, 3)))
    assert len(scale) == len(kind) == len(units) == 0


def test_lifted_pairs_say_themselves_which_have_an_edge(spark):
    """The rows of all pairs are neither shuffled nor sorted to be joined with the edges."""
    from lattica.operators import partition

    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 1, 0.0), (4, 3, 0.5), (9, 8, 0.0), (3, 2, 0.1)], "v1 long, v2 long, p double")
    found = partition.lifted_weights(edges)
    above = plan_of(found).split("FlatMapGroupsInPandas")[0]
    assert "Exchange" not in above and "SortMergeJoin" not in above and "BroadcastHashJoin" not in above
    got = {(r.v1, r.v2): (r.original, round(r.weight, 6)) for r in found.collect()}
    odds = lambda p: np.log(p / (1 - p)) + np.log(0.05 / 0.95)
    want = {(1, 2): (True, 0.9), (2, 3): (True, 0.8), (1, 4): (True, 0.36), (3, 4): (True, 0.5), (1, 3): (False, 0.72), (2, 4): (False, 0.4)}
    nv, ne = 10, 5
    assert got == {k: (o, round((nv * (nv - 1) / 2 if o else ne) * odds(p), 6)) for k, (o, p) in want.items()}


def test_tasks_of_a_join_through_cells_follow_its_rows(spark, monkeypatch):
    """However well the copies of rows compress, a task has TOGETHER of them."""
    rows = [(i, i % 3, i // 9, i // 3 % 3, i % 3) for i in range(200)]
    own = spark.createDataFrame(rows, "id long, label long, z long, y long, x long").localCheckpoint()
    monkeypatch.setattr(spatial, "TOGETHER", 100)
    want = {(a[0], b[0]) for a in rows for b in rows if all(abs(p - q) <= 1 for p, q in zip(a[2:], b[2:], strict=True))}
    inside = "abs(z - n_z) <= 1 and abs(y - n_y) <= 1 and abs(x - n_x) <= 1"
    for half, by, parts in ((True, [], 28), (False, [], 54), (False, ["label"], 54)):
        found = spatial.binned_join(own, own, (2, 2, 2), by=by, half=half)
        assert found.rdd.getNumPartitions() == parts and "ENSURE_REQUIREMENTS" not in plan_of(found)
        pairs = [(r.id, r.n_id) for r in found.where(inside).collect()]
        assert len(pairs) == len(set(pairs))
        pairs = {p for a, b in pairs for p in ((a, b), (b, a))} if half else set(pairs)
        assert pairs == {(a, b) for a, b in want if not by or a % 3 == b % 3}


def test_the_medial_axis_baseline_matches_in_counted_tasks(spark, sf_dir, monkeypatch):
    """Its largest sort is that of the exploded endpoints."""
    from lattica import queries as q

    monkeypatch.setattr(spatial, "TOGETHER", 100)
    found = q.QUERIES["medial_axis_baseline"](spark, sf_dir)
    ends = fx.endpoints(spark, sf_dir).count()
    tasks = -(-ends * 14 // 100)
    assert tasks > 4 and plan_of(found).count(f"{tasks}), REPARTITION_BY_NUM") == 2
    assert found.count() == 1


def test_tasks_of_bricks_and_boxes_follow_their_rows(spark, sf_dir, monkeypatch):
    """However well places compress, a task has TOGETHER rows of them (or one brick), with the same results."""
    from lattica.operators import neighbors
    from lattica.plans import bricks

    own = fx.labels(spark, sf_dir).where("label <> 0").localCheckpoint()
    n = own.count()
    steps = {"faces": (lambda: neighbors.face_pairs(own), n), "sums": (lambda: neighbors.mean_affinity(own), n), "masks": (lambda: neighbors.neighbour_mask(own), None)}
    want = {k: sorted(map(tuple, step().collect())) for k, (step, _) in steps.items()}
    monkeypatch.setattr(bricks, "TOGETHER", 100, raising=False)
    monkeypatch.setattr(bricks, "BRICK", (1, 8, 8))
    for k, (step, rows) in steps.items():
        found = step()
        below = plan_of(found).split("FlatMapGroupsInArrow")[1]
        tasks = -(-rows // 100) if rows else -(-int(np.ceil(n * np.prod([1 + 2 / s for s in neighbors.BOX]))) // 100)
        assert tasks > 4 and f"{tasks}), REPARTITION_BY_NUM" in below and "ENSURE_REQUIREMENTS" not in below
        assert sorted(map(tuple, found.collect())) == want[k] and want[k]


def test_the_medial_axis_baseline_has_no_brick_step_by_bytes(spark, sf_dir, monkeypatch):
    from lattica import queries as q
    from lattica.plans import bricks

    monkeypatch.setattr(bricks, "TOGETHER", 100, raising=False)
    plan = plan_of(q.QUERIES["medial_axis_baseline"](spark, sf_dir))
    labels = fx.labels(spark, sf_dir).where("label <> 0").count()
    assert f"{-(-labels // 100)}), REPARTITION_BY_NUM" in plan and "hashpartitioning(_bz" in plan
    assert all("REPARTITION_BY_NUM" in line for line in plan.split("\n") if "hashpartitioning(_bz" in line)


def test_tasks_of_endpoints_and_their_matches_follow_rows(spark, sf_dir, monkeypatch):
    """No step from skeleton points to pairs of labels is dealt by shuffled bytes, and results are the same."""
    from lattica.plans import joins

    points = fx.skeleton_points(spark, sf_dir).localCheckpoint()
    n = points.count()

    def steps():
        ends = fx.skeleton.endpoint_vectors(points)
        return ends, spatial.endpoint_pair_match(ends, fx.geometry(spark, sf_dir), fx.REACH)

    want = [sorted(map(tuple, df.collect())) for df in steps()]
    monkeypatch.setattr(joins, "TOGETHER", 20, raising=False)
    for found, same in zip(steps(), want, strict=True):
        plan = plan_of(found)
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
        assert sorted(map(tuple, found.collect())) == same and same
    assert f"{-(-n * 26 // 20)}), REPARTITION_BY_NUM" in plan_of(steps()[0]) and -(-n * 26 // 20) > 4


def test_pairs_are_classified_in_counted_tasks(spark, monkeypatch):
    from lattica.operators import truth
    from lattica.plans import joins

    pairs = spark.createDataFrame([(i, i % 7 + 50) for i in range(60)], "label_one long, label_two long").localCheckpoint()
    mapping = spark.createDataFrame([(i, i % 3) for i in range(55)], "label long, gold long").localCheckpoint()
    want = sorted(map(tuple, truth.classify_pairs(pairs, mapping).collect()))
    monkeypatch.setattr(joins, "TOGETHER", 10)
    found = truth.classify_pairs(pairs, mapping, rows=60)
    assert plan_of(found).count("6), REPARTITION_BY_NUM") == 4 and "ENSURE_REQUIREMENTS" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == want and {t for _, _, t in want} == {"unknown", "positive", "negative"}
