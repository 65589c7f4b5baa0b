import zlib

import numpy as np
import pytest

from lattica import queries as q
from lattica.operators import scoring, surface
from lattica.sources import volumes


def network(rng, same):
    conv = scoring.Layer("conv", rng.normal(size=(2, 3, 1, 3, 3)), rng.normal(size=2), same=same)
    pool = scoring.Layer("pool", size=(1, 2, 2))
    n = 2 * 3 * (2 if same else 1) * (2 if same else 1)
    dense = scoring.Layer("dense", rng.normal(size=(n, 1)), rng.normal(size=1), activation="sigmoid")
    return scoring.Network(3, (3, 5, 5), [conv, pool, scoring.Layer("flatten"), dense])


def slow(net, cube):
    x = scoring.channels_of(cube[None], 3)[0].astype(float)
    conv, pool, _, dense = net.layers
    if conv.same:
        x = np.pad(x, [(0, 0), (0, 0), (1, 1), (1, 1)])
    c, z, y, w = x.shape
    out = np.zeros((2, z, y - 2, w - 2))
    for o, a, b, d in np.ndindex(out.shape):
        out[o, a, b, d] = max(0.0, (x[:, a : a + 1, b : b + 3, d : d + 3] * conv.kernel[o]).sum() + conv.bias[o])
    p = np.array([[[[out[o, a, 2 * b : 2 * b + 2, 2 * d : 2 * d + 2].max() for d in range(out.shape[3] // 2)] for b in range(out.shape[2] // 2)] for a in range(z)] for o in range(2)])
    return 1 / (1 + np.exp(-(p.reshape(-1) @ dense.kernel + dense.bias)[0]))


@pytest.mark.parametrize("same", [False, True])
def test_network_equals_slow_form(spark, same):
    rng = np.random.default_rng(1)
    net = network(rng, same)
    cubes = rng.integers(0, 3, (20, 75))
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cubes)], "id long, cube array<int>")
    got = {r.id: r.p for r in scoring.score_examples(df, net, batch=7).collect()}
    assert all(abs(got[i] - slow(net, c.reshape(3, 5, 5))) < 1e-5 for i, c in enumerate(cubes))


def test_training_separates_what_is_separable(spark):
    rows = [(i, [1] * (6 if i % 2 else 1) + [2] * (6 if i % 2 else 11), "positive" if i % 2 else "negative") for i in range(60)] + [(99, [0] * 12, "unknown")]
    df = scoring.cube_features(spark.createDataFrame(rows, "id long, cube array<int>, truth string"))
    scored = scoring.score_trained(df, scoring.train(df))
    assert scored.where("truth = 'positive' and p > 0.9").count() == scored.where("truth = 'negative' and p < 0.1").count() == 30
    record = scoring.edge_forward(scored).first()
    assert (record.tp, record.fp, record.fn, record.tn) == (30, 0, 0, 30)


def test_surfaces_are_closed():
    rng = np.random.default_rng(2)
    for points in (np.array([[0, 0, 0]]), np.argwhere(rng.random((4, 4, 4)) < 0.4)):
        edges = {}
        for t in surface.isosurface(points)[0]:
            t = [tuple(p) for p in t]
            for a, b in ((0, 1), (1, 2), (2, 0)):
                key = tuple(sorted((t[a], t[b])))
                edges[key] = edges.get(key, 0) + 1
        assert edges and all(n % 2 == 0 for n in edges.values())


@pytest.mark.parametrize("box", [(32, 64, 64), (2, 3, 2)])
def test_a_mesh_over_many_boxes_is_closed(spark, monkeypatch, box):
    """Triangles of all boxes are those of the whole label; every edge has two sides and each corner is there once."""
    monkeypatch.setattr(surface, "BOX", box)
    rng = np.random.default_rng(3)
    volume = np.where(rng.random((7, 8, 9)) < 0.5, 0, rng.integers(1, 3, (7, 8, 9)))
    low = (-2, 5, 0)
    df = spark.createDataFrame([(*(int(a + b) for a, b in zip(p, low, strict=True)), int(v)) for p, v in np.ndenumerate(volume)], "z long, y long, x long, label long")
    found = surface.mesh(df)
    rows = found.collect()
    for label in (1, 2):
        got = sorted(tuple(tuple(r[k]) for k in "abc") for r in rows if r.label == label)
        want, _ = surface.isosurface(np.argwhere(volume == label) + low)
        assert got == sorted(tuple(map(tuple, t)) for t in want.tolist())
        edges = {}
        for t in got:
            for i, j in ((0, 1), (1, 2), (2, 0)):
                key = tuple(sorted((t[i], t[j])))
                edges[key] = edges.get(key, 0) + 1
        assert all(n % 2 == 0 for n in edges.values())
    corners = [tuple(r) for r in surface.vertices(found).collect()]
    assert len(corners) == len(set(corners)) == len({(r.label, *r[k]) for r in rows for k in "abc"})
    shown = surface.marching(df).collect()
    for label in (1, 2):
        own = sorted(r.ordinal for r in shown if r.label == label)
        assert own == list(range(len(own))) and len(own) == sum(r.label == label for r in rows)


def test_meshes(spark, sf_dir):
    from lattica import fixtures as fx

    t = surface.marching(fx.labels(spark, sf_dir).where("label in (1, 2)"))
    files = {r.name: bytes(r.content) for r in surface.stl_files(t).collect()}
    assert set(files) == {"1.stl", "2.stl"} and all((len(c) - 84) % 50 == 0 for c in files.values())
    xs = [c for r in t.where("label = 1").collect() for p in r.triangle for c in p]
    assert abs(max(xs) + min(xs)) < 1


def test_images(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = surface.png(a)
    at = data.index(b"IDAT") + 4
    assert zlib.decompressobj().decompress(data[at:]) == b"".join(b"\0" + r.tobytes() for r in a)
    rows = [(z, y, x, int(a[y, x]) + z) for z in (1, 0) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "z long, y long, x long, label long")
    for r in surface.png_slices(df, 3, 4).collect():
        (tmp_path / f"img{r.name}").write_bytes(bytes(r.content))
    back = volumes.read_image_stack(spark, str(tmp_path))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def decode(data, size):
    """Pixels of a GIF image's code stream."""
    bits, at, width, out, last = int.from_bytes(data, "little"), 0, size + 1, [], None
    clear, table = 1 << size, {}
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear + 1:
            return out
        if code == clear:
            table, width, last = {i: [i] for i in range(clear)} | {clear: [], clear + 1: []}, size + 1, None
            continue
        entry = table[code] if code in table else last + last[:1]
        if last is not None:
            table[len(table)] = last + entry[:1]
            width += len(table) == 1 << width and width < 12
        out += entry
        last = entry


def test_gif_decodes():
    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 4, (20, 31)).astype(np.uint8) for _ in range(2)]
    data, got = surface.gif(frames), []
    at = data.index(b"\x2c", 13 + 768)
    while data[at] == 0x2C:
        at, stream = at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        got.append(decode(stream, 8))
        at += 1 + 8 * (data[at + 1] == 0x21)
    assert got == [f.ravel().tolist() for f in frames] and data[at] == 0x3B


def test_edge_forward_query(spark, sf_dir):
    assert q.QUERIES["edge_forward"](spark, sf_dir).count() == 1


def test_architectures():
    rng = np.random.default_rng(0)
    node, edge = scoring.node_network(3, (20, 52, 52), (2, 3, 4), hidden=8), scoring.edge_network(1, (8, 24, 24), (2, 2, 2, 3), hidden=8)
    for net in (node, edge):
        out = scoring.forward(net, rng.random((2, net.channels, *net.width)) - 0.5)
        assert out.shape == (2, 1) and ((out > 0) & (out < 1)).all()
    assert [x.size for x in node.layers if x.kind == "pool"] == [(1, 2, 2), (1, 2, 2), (2, 2, 2)]
    assert [x.size for x in edge.layers if x.kind == "pool"] == [(1, 2, 2)] * 3 + [(2, 2, 2)]
    lines = scoring.network_log(node, {"depth": 3}).split("\n")
    assert lines[0] == "conv_1 (3, 20, 52, 52) -> (2, 18, 50, 50)" and lines[-2] == "depth: 3" and len(lines) == len(node.layers) + 3
    with pytest.raises(ValueError):
        scoring.node_network(1, (4, 8, 8))


def test_finetuning_goes_on_from_a_model(spark):
    rng = np.random.default_rng(1)
    rows = [([float(a), float(b)], "positive" if a > b else "negative") for a, b in rng.random((300, 2))] + [([9.0, 9.0], "unknown")]
    df = spark.createDataFrame(rows, "features array<double>, truth string").repartition(3)
    first = scoring.finetune(df, epochs=30, rate=5.0)
    more = scoring.finetune(df, first, epochs=30, rate=5.0)
    losses = scoring.loss_table(spark, more).orderBy("epoch").collect()
    assert [r.epoch for r in losses] == list(range(1, 61)) and losses[-1].loss < losses[29].loss < losses[0].loss and losses[-1].accuracy > 0.95
    # a step is that of the gradient over all rows
    x, y = np.array([r[0] + [1.0] for r in rows[:-1]]), np.array([r[1] == "positive" for r in rows[:-1]])
    step = -(0.5 - y) @ x / 300
    one = scoring.finetune(df, epochs=1, rate=1.0)
    assert np.allclose([*one.weights, one.bias], step)
    scored = scoring.score_linear(df, more).where("truth <> 'unknown'").collect()
    assert np.mean([(r.p > 0.5) == (r.truth == "positive") for r in scored]) > 0.95
    assert scoring.finetune(df.where("truth = 'unknown'"), more, epochs=2).losses == more.losses


def test_restricted_examples(spark):
    from lattica.operators import features

    made = [("A-one-nodes.h5", "training"), ("A-two-reduced-nodes.h5", "training"), ("A-one-nodes.h5", "validation"), ("B-one.h5", "training")]
    df = spark.createDataFrame(made, "file string, subset string")
    assert features.restricted(df, ("A",), "validation").count() == 2
    assert features.restricted(df, ("A", "one"), "training").count() == 1
    assert features.restricted(df, ("A",), "training", "edges").count() == 1 and features.restricted(df, ("A",), "validation", "edges").count() == 1


def test_a_sweep_equals_its_parts(spark, sf_dir):
    from lattica import fixtures as fx
    from lattica.operators import skeleton, sweep, voxel

    g, labels = fx.geometry(spark, sf_dir), fx.labels(spark, sf_dir)
    truth = skeleton.skeleton_endpoints(fx.skeleton_points(spark, sf_dir))
    scores = sweep.endpoint_sweep(labels, truth, g, (60,), (0, 15), (13,), (2,))
    got = {r.config: r for r in scores.collect()}
    assert set(got) == set(sweep.configurations((60,), (0, 15), (13,), (2,)))
    # thinning without and with A*, put together from the single operators
    out = (60, 60, 60)
    cells = voxel.downsample_topological(labels, g, out).selectExpr("label", "dz z", "dy y", "dx x", "(dz * 1000 + dy) * 1000 + dx iv")
    up = voxel.upsample_representative(labels, g, out)
    thin = skeleton.thinning(cells).join(cells, ["label", "iv"]).selectExpr("label", "z dz", "y dy", "x dx", "is_endpoint").join(up, ["label", "dz", "dy", "dx"])
    places = labels.select("iv", "z", "y", "x")
    for config, ends in (("060-thinning-00", thin.where("is_endpoint").selectExpr("label", "up_iv iv")), ("060-thinning-15", skeleton.upsample_endpoints(thin.select("label", "up_iv"), labels).where("is_endpoint").select("label", "iv"))):
        ends = ends.join(places, "iv").select("label", "iv", "z", "y", "x")
        known = ends.join(truth.select("label").distinct(), "label", "left_semi")
        want = skeleton.endpoint_scores(skeleton.endpoint_matching(truth, ends, g), truth, known).first()
        r = got[config]
        assert (r.tp, r.fp, r.fn, r.fscore) == (want.tp, want.fp, want.fn, want.fscore)
    best = sweep.best_configuration(scores).first()
    assert best.fscore == max(r.fscore for r in got.values() if r.fscore is not None)
    assert sweep.reported(scores).count() == sum((r.precision or 0) > 0.8 and (r.recall or 0) > 0.9 for r in got.values())
    assert len(sweep.configurations()) == 864
