import numpy as np
import pytest

from lattica.geometry import Geometry
from lattica.operators import features, graph, metrics, neighbors, partition, skeleton, voxel
from lattica.plans import components
from lattica.plans.components import connected_components


def frame(spark, box, name="label"):
    box = np.asarray(box)
    nz, ny, nx = box.shape
    rows = [(int(z * ny * nx + y * nx + x), int(z), int(y), int(x), int(box[z, y, x])) for z, y, x in np.ndindex(box.shape)]
    return spark.createDataFrame(rows, f"iv long, z long, y long, x long, {name} long")


@pytest.mark.parametrize("n, extra", [(1, []), (2, [(5, 5)]), (40, [(100, 100), (None, 3)])])
def test_components_of_a_path(spark, n, extra):
    edges = [(i, i + 1) for i in range(n)] + extra
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1) if n > 2 or not extra or i != 5)
    assert got.get(100, 100) == 100


@pytest.mark.parametrize("spread, least_hub", [(False, 1000), (True, 1000), (True, 2)])
def test_components_of_random_graphs(spark, monkeypatch, spread, least_hub):
    """With links in one partition, in several, and with all vertices of two links or more as hubs."""
    monkeypatch.setattr(components, "LEAST_HUB", least_hub)
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 300, (260, 2)).tolist()
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", not spread)
    try:
        got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {v: find(v) for e in edges for v in e}


@pytest.mark.parametrize("in_one, rounds", [(0, True), (150, True), (2**20, False)])
def test_few_links_need_no_round(spark, monkeypatch, in_one, rounds):
    """Rounds go on only while there are more links than a task contracts; all ways have the same roots."""
    told = []
    step = components._with_least
    monkeypatch.setattr(components, "_with_least", lambda *a: told.append(1) or step(*a))
    monkeypatch.setattr(components, "IN_ONE", in_one)
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(9).permutation([(i, i + 1) for i in range(300) if i % 100 != 99])]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {v: min(v // 100 * 100, 300) for v in range(301) if v != 300}
    assert bool(told) == rounds


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_force_connectivity(spark):
    box = [[[7, 0, 7, 0, 3], [0, 0, 0, 0, 0], [3, 3, 0, 7, 0]]]
    df = frame(spark, box)
    out = {r.iv: r.label for r in graph.force_connectivity(df).collect()}
    # 3 at iv 4 stays, the pair at 10 and 11 is new; 7 at 0 stays, those at 2 and 13 are new
    assert [out[i] for i in (4, 10, 11, 0, 2, 13, 1)] == [3, 8, 8, 7, 9, 10, 0]
    again = graph.force_connectivity(graph.force_connectivity(df))
    assert {r.iv: r.label for r in again.collect()} == out


def test_metrics_of_equal_and_renamed_volumes(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.integers(1, 5, (2, 6, 6))).withColumnRenamed("label", "gold")
    same = metrics.variation_of_information(metrics.contingency(df.withColumn("label", df.gold))).first()
    assert tuple(same) == (0.0, 0.0)
    renamed = metrics.rand_error(metrics.contingency(df.withColumn("label", df.gold * 17 % 23))).first()
    assert tuple(renamed) == (0.0, 0.0)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "iv long, z long, y long, x long, label long, gold long")
    assert metrics.rand_error(metrics.contingency(empty)).first().rand_merge is None
    assert metrics.adapted_rand(empty).first().are is None
    none = metrics.confusion_matrix(spark.createDataFrame([(True, False)], "truth boolean, pred boolean")).first()
    assert none.precision is None and none.recall == 0.0


def test_dilation_grows_with_its_radius(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.integers(1, 3, (1, 8, 8)).repeat(1, axis=0))
    zeros = [neighbors.dilate_gold(df, d).where("label = 0").count() for d in (0, 1, 2)]
    assert zeros == sorted(zeros)


def test_a_plane_without_boundary_has_no_distance(spark):
    df = frame(spark, np.ones((1, 3, 3)))
    assert {r.distance for r in skeleton.distance_transform_2d(df, Geometry(1, 3, 3)).collect()} == {None}


def test_reduce_labels_twice_changes_nothing(spark):
    df = frame(spark, [[[0, 9, 4], [4, 1, 9]]])
    once = {r.label: r.mapped for r in voxel.reduce_labels(df).collect()}
    assert once == {0: 0, 1: 1, 4: 2, 9: 3}
    twice = voxel.reduce_labels(voxel.map_labels(df, voxel.reduce_labels(df)))
    assert all(r.label == r.mapped for r in twice.collect())


def test_mask_and_crop_keeps_the_last_plane(spark):
    df = frame(spark, [[[0, 5, 0], [0, 5, 6], [0, 0, 0]]])
    got = {(r.z, r.y, r.x): r.label for r in voxel.mask_and_crop(df, [5]).collect()}
    assert got == {(0, 0, 0): 5, (0, 1, 0): 5}


def test_remove_small_with_threshold_zero_is_a_no_op(spark):
    df = frame(spark, [[[1, 2, 2]]])
    assert voxel.remove_small(df, 0).collect() == df.collect()
    assert [r.label for r in voxel.remove_small(df, 2).orderBy("iv").collect()] == [0, 2, 2]


def test_endpoint_at_index_zero(spark):
    df = frame(spark, [[[1, 1, 1, 1]]])
    ends = skeleton.endpoint_vectors(df.select("label", "iv", "z", "y", "x")).orderBy("iv").collect()
    assert [(r.iv, r.vx) for r in ends] == [(0, -1.0), (3, 1.0)]


def test_isolated_point_has_no_vector(spark):
    df = frame(spark, [[[1, 0, 2]]]).where("label > 0")
    assert all((r.vz, r.vy, r.vx) == (0, 0, 0) for r in skeleton.endpoint_vectors(df.select("label", "iv", "z", "y", "x")).collect())


def test_lifted_paths_are_at_least_as_likely_as_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.5), (3, 1, 0.4), (8, 9, 1.0)], "v1 long, v2 long, p double")
    got = {(r.v1, r.v2): round(r.p, 6) for r in graph.lifted_edges(edges).collect()}
    assert got == {(1, 2): 0.9, (2, 3): 0.9, (1, 3): 0.81, (8, 9): 1.0}


def test_scale_feature_takes_planes_of_the_whole_volume(spark):
    """Each cell against the voxel that it takes, on a volume of ten planes; labels 1 and 2 lie in the first two."""
    from lattica import fixtures as fx
    from lattica import queries as q

    sf_dir = "/root/testdata/sf0.01"
    volume = {(r.z, r.y, r.x): r.seg for r in fx.voxels(spark, sf_dir).select("z", "y", "x", "seg").collect()}
    planes = [0, 1, 2, 3, 5, 6, 7, 8]
    assert len(volume) == 10 * 30 * 50
    want = {(i, j, k): {1: 1, 2: 2}.get(volume[z, 3 * j, 5 * k // 2], 0) for i, z in enumerate(planes) for j in range(10) for k in range(20)}
    assert {c[0] for c, v in want.items() if v} == {0, 1}
    rows = q.QUERIES["scale_feature"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {(r.iz, r.iy, r.ix): r.val for r in rows} == want
    rows = q.QUERIES["example_channels"](spark, sf_dir).collect()
    on = lambda v: 0.5 if v else -0.5
    assert {(r.iz, r.iy, r.ix): (r.c0, r.c1, r.c2) for r in rows} == {c: (on(v > 0), on(v == 1), on(v == 2)) for c, v in want.items()}


def test_lifted_queries_take_all_scored_edges(spark, sf_dir):
    """Against all-pairs relaxation over every scored edge, the weights and the contraction that follow from it."""
    from lattica import fixtures as fx
    from lattica import queries as q
    from lattica.operators.kernels import contract

    edges = {(r.v1, r.v2): r.p for r in fx.scored(spark, sf_dir).collect()}
    names = sorted({v for e in edges for v in e})
    best = np.zeros((len(names), len(names)))
    for (a, b), p in edges.items():
        i, j = names.index(a), names.index(b)
        best[i, j] = best[j, i] = p
    for k in range(len(names)):
        best = np.maximum(best, best[:, k, None] * best[None, k, :])
    want = {(a, b): best[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if i < j and best[i, j] > 0}
    got = {(r.v1, r.v2): r.p for r in q.QUERIES["lifted_edges"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and edges.keys() <= got.keys() and min(edges.values()) < 0.5
    assert all(abs(got[k] - want[k]) <= 5.1e-7 for k in want)

    nv, ne = max(names) + 1, len(edges)
    clamp = {k: min(max(p, 1e-12), 1 - 1e-12) for k, p in want.items()}
    weight = {k: (nv * (nv - 1) / 2 if k in edges else ne) * (np.log(p / (1 - p)) + np.log(0.05 / 0.95)) for k, p in clamp.items()}
    rows = q.QUERIES["lifted_weights"](spark, sf_dir).collect()
    assert {(r.v1, r.v2): r.original for r in rows} == {k: k in edges for k in want}
    assert all(abs(r.weight - weight[r.v1, r.v2]) <= 1e-9 * abs(weight[r.v1, r.v2]) + 5.1e-5 for r in rows)

    roots = contract([(*k, w) for k, w in weight.items() if k in edges], [(*k, w) for k, w in weight.items() if k not in edges])
    cut = {(r.v1, r.v2): r.cut for r in q.QUERIES["lifted_multicut"](spark, sf_dir).collect()}
    assert cut == {(a, b): roots[a] != roots[b] for a, b in edges}


def test_multicut_by_components_equals_whole(spark):
    from lattica.operators.kernels import contract

    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(p)) for (a, b), p in zip(rng.integers(0, 60, (160, 2)), rng.uniform(0.8, 0.999, 160), strict=True) if a != b]
    df = spark.createDataFrame(rows, "v1 long, v2 long, p double")
    weights = [(r.v1, r.v2, r.weight) for r in partition.multicut_weights(df).collect()]
    roots = contract(weights)
    got = {(r.v1, r.v2): r.cut for r in partition.multicut(df).collect()}
    assert got == {(a, b): roots[a] != roots[b] for a, b, _ in weights}


def test_geodesic_equals_dijkstra_by_relaxation(spark):
    rng = np.random.default_rng(9)
    df = frame(spark, rng.integers(0, 3, (2, 5, 5)))
    got = {r.iv: r.distance for r in graph.voxel_geodesic(df).collect()}
    rows = {r.iv: r for r in df.where("label <> 0").collect()}
    for label in (1, 2):
        own = {i: (r.z, r.y, r.x) for i, r in rows.items() if r.label == label}
        d = {i: (0.0 if i == min(own) else float("inf")) for i in own}
        for _ in own:
            for i, p in own.items():
                for j, q in own.items():
                    gap = [abs(a - b) for a, b in zip(p, q, strict=True)]
                    if i != j and max(gap) == 1:
                        d[j] = min(d[j], d[i] + sum(gap) ** 0.5)
        assert all((got[i] is None and d[i] == float("inf")) or abs(got[i] - d[i]) < 1e-9 for i in own)


def test_augment_keeps_values_and_reruns(spark):
    df = spark.createDataFrame([(i, [i % 3] * 12) for i in range(6)], "id long, cube array<int>")
    a, b = (features.augment(df, (3, 2, 2), 4).orderBy("id").collect() for _ in range(2))
    assert a == b and all(set(r.cube) <= {0, 1, 2} for r in a)


def test_upsampled_endpoints(spark):
    df = frame(spark, np.ones((1, 1, 7)))
    points = spark.createDataFrame([(1, i) for i in (0, 2, 4, 6)], "label long, up_iv long")
    got = {r.iv: r.is_endpoint for r in skeleton.upsample_endpoints(points, df, reach=2).collect()}
    assert got == {0: True, 2: False, 4: False, 6: True}


def test_endpoint_scores(spark):
    g = Geometry(1, 9, 9, (1, 1, 1))
    t = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 8, 0, 0, 8)], "label long, iv long, z long, y long, x long")
    p = spark.createDataFrame([(1, 1, 0, 0, 1), (2, 3, 0, 0, 3)], "label long, iv long, z long, y long, x long")
    m = skeleton.endpoint_matching(t, p, g, 4)
    assert [tuple(r) for r in m.collect()] == [(1, 0, 1, 1.0)]
    assert tuple(skeleton.endpoint_scores(m, t, p).first()) == (1, 0, 1, 0.666667)
