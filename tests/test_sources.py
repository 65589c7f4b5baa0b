import numpy as np
import pandas as pd
import pytest

from lattica.sources import metadata, packed_files, reports, volumes

META = """# resolution in nm
6x7x30
# affinity filename
None
# gold filename
g.h5 main
# world bounding box
(1,2,3)-(4,5,6)
# grid size
10x20x30
"""


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("kind", list(packed_files.LAYOUTS))
def test_packed_round_trip(spark, tmp_path, kind):
    layout = packed_files.LAYOUTS[kind]
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({n: rng.integers(-5, 9, 7) if t == "q" else rng.random(7) for n, t in layout.record})
    rows["ordinal"] = [0, 1, 2, 0, 1, 0, 1] if layout.per_label else range(7)
    if layout.per_label:
        rows["label"] = [0, 0, 0, 2, 2, 3, 3]
    header = {h: 4 for h in layout.header if h != "n"}
    (tmp_path / "f.bin").write_bytes(packed_files.encode(kind, rows, **header))
    got = packed_files.read_packed(spark, str(tmp_path / "*.bin"), kind).toPandas()
    keys = ["label", "ordinal"] if layout.per_label and "label" not in dict(layout.record) else ["ordinal"]
    names = [n for n, _ in layout.record]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True)[names], rows.sort_values(keys, ignore_index=True)[names], check_dtype=False)


def test_short_file_is_refused():
    with pytest.raises(ValueError):
        packed_files.decode("probabilities", "x", np.array([2, 1, 2], "<i8").tobytes())
    assert len(packed_files.decode("mapping", "x", np.array([0], "<i8").tobytes())) == 0


def packed_rows(rng, labels):
    counts = rng.integers(0, 9, labels) * rng.integers(0, 2, labels)
    label = np.repeat(np.arange(labels), counts)
    ordinal = np.concatenate([np.arange(n) for n in counts]) if len(label) else label
    return pd.DataFrame({"label": label, "ordinal": ordinal, "iv": rng.integers(-50, 50, len(label)), **{v: rng.random(len(label)) for v in ("vz", "vy", "vx")}})


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_any_size_are_the_file(seed):
    """Cut at every size from one record on: what the pieces hold, in order, is what was written, and none is longer than said."""
    rows = packed_rows(np.random.default_rng(seed), 12 * (seed > 0))
    content = packed_files.encode("vectors", rows, nz=1, ny=2, nx=3, max_label=12 * (seed > 0))
    for most in range(32, 200, 8):
        found = list(packed_files.pieces("vectors", "f", len(content), lambda at, n: content[at : at + n], most))
        assert sum(n for _, n, *_ in found) == len(content) - 32 and all(n <= most + 8 * 12 for _, n, *_ in found)
        got = [packed_files.decode_piece("vectors", "f", content[at : at + n], *first, head) for at, n, *first, _, head in found]
        for frame, (_, _, first, _, _, last, _) in zip(got, found, strict=True):
            assert frame.label.between(first, last).all()
        whole = pd.concat(got, ignore_index=True) if got else packed_files.decode("vectors", "f", content)
        pd.testing.assert_frame_equal(whole[list(rows)], rows, check_dtype=False)


def test_packed_files_are_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = {f"a b%20{k}.bin": packed_rows(rng, 40) for k in range(3)}
    for name, rows in frames.items():
        (tmp_path / name).write_bytes(packed_files.encode("vectors", rows, nz=1, ny=2, nx=3, max_label=40))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        df = packed_files.read_packed(spark, str(tmp_path), "vectors", piece=64)
        some = packed_files.read_packed(spark, str(tmp_path), "vectors", labels=(7, 20), piece=64)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    size = sum((tmp_path / n).stat().st_size for n in frames)
    assert df.rdd.getNumPartitions() == -(-size // 1024) > 3
    key = lambda r: (r.path.rsplit("/", 1)[1], r.label, r.ordinal, r.iv, r.vx)
    want = sorted((n, *r) for n, rows in frames.items() for r in rows[["label", "ordinal", "iv", "vx"]].itertuples(index=False, name=None))
    assert sorted(map(key, df.collect())) == want
    assert sorted(map(key, some.collect())) == [r for r in want if 7 <= r[1] <= 20]


def test_packed_file_above_two_gigabytes_by_label(spark, tmp_path):
    """A sparse file whose second label has 3 GB of zeros; only the pieces of the third one are read."""
    n = 3 * 2**30 // 8
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(np.array([1, 2, 3, 3, 1, 77, n], "<i8").tobytes())
        f.seek(n * 8, 1)
        f.write(np.array([2, 5, -6], "<i8").tobytes())
    got = packed_files.read_packed(spark, str(tmp_path / "big.bin"), "cells", labels=(2, 2)).orderBy("ordinal").collect()
    assert [(r.label, r.iv, r.max_label) for r in got] == [(2, 5, 3), (2, -6, 3)]


def test_short_packed_files_fail_the_query(spark, tmp_path):
    (tmp_path / "short").write_bytes(np.array([1, 2, 3, 2, 1, 9, 4, 0], "<i8").tobytes())
    (tmp_path / "none").write_bytes(b"1234")
    for name, why in (("short", "do not fit"), ("none", "no room")):
        with pytest.raises(Exception, match=why):
            packed_files.read_packed(spark, str(tmp_path / name), "cells").collect()
    with pytest.raises(ValueError, match="no labels"):
        packed_files.read_packed(spark, str(tmp_path / "none"), "mapping", labels=(0, 1))


def test_packed_sink(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", 0, 5), ("a.bin", 1, 6), ("b.bin", 0, 7)], "file string, ordinal long, mapped long")
    packed_files.save_files(packed_files.packed_files(df, "mapping", "file"), str(tmp_path))
    got = packed_files.read_packed(spark, str(tmp_path / "*.bin"), "mapping").orderBy("path", "ordinal").collect()
    assert [r.mapped for r in got] == [5, 6, 7]
    assert [(r.label, r.mapped) for r in packed_files.read_mapping(spark, str(tmp_path / "a.bin")).collect()] == [(0, 5), (1, 6)]


def test_skeletons(spark, tmp_path):
    pts = pd.DataFrame({"label": [1, 1], "ordinal": [0, 1], "iv": [-7, 8]})
    vec = pd.DataFrame({"label": [1], "ordinal": [0], "iv": [7], "vz": [1.0], "vy": [0.0], "vx": [0.0]})
    head = {"nz": 1, "ny": 2, "nx": 5, "max_label": 2}
    (tmp_path / "p").write_bytes(packed_files.encode("skeleton", pts, **head))
    (tmp_path / "v").write_bytes(packed_files.encode("vectors", vec, **head))
    got = packed_files.read_skeletons(spark, str(tmp_path / "p"), str(tmp_path / "v")).orderBy("iv").collect()
    assert [(r.iv, r.is_endpoint, r.vz) for r in got] == [(7, True, 1.0), (8, False, None)]
    end = packed_files.read_skeleton_endpoints(spark, str(tmp_path / "p"), 2, 5).first()
    assert (end.z, end.y, end.x) == (0, 1, 2)


def test_skeletons_that_do_not_fit_are_refused(spark, tmp_path):
    pts = pd.DataFrame({"label": [1, 1], "ordinal": [0, 1], "iv": [-7, -8]})
    vec = pd.DataFrame({"label": [1], "ordinal": [0], "iv": [7], "vz": [1.0], "vy": [0.0], "vx": [0.0]})
    head = {"nz": 1, "ny": 2, "nx": 5, "max_label": 2}
    (tmp_path / "p").write_bytes(packed_files.encode("skeleton", pts, **head))
    (tmp_path / "q").write_bytes(packed_files.encode("skeleton", pts[:1], **head | {"nx": 6}))
    (tmp_path / "v").write_bytes(packed_files.encode("vectors", vec, **head))
    with pytest.raises(Exception, match="differ in number"):
        packed_files.read_skeletons(spark, str(tmp_path / "p"), str(tmp_path / "v")).collect()
    with pytest.raises(Exception, match="headers"):
        packed_files.read_skeletons(spark, str(tmp_path / "q"), str(tmp_path / "v")).collect()


def test_datasets_by_metadata(spark, tmp_path):
    a = np.arange(24).reshape(4, 2, 3)
    np.save(tmp_path / "seg.npy", a)
    np.save(tmp_path / "aff.npy", np.stack([a + 0.25, a + 0.5, a + 0.75]))
    gold = volumes.read_npy(spark, str(tmp_path / "seg.npy")).drop("path").withColumnRenamed("label", "gold")
    volumes.write_volume(gold, str(tmp_path / "gold.parquet"), slab=2)
    text = "# resolution in nm\n6x7x30\n# affinity filename\naff.npy\n# gold filename\ngold.parquet\n# rhoana filename\nseg.npy main\n# grid size\n3x2x4\n"
    meta = write(tmp_path / "VOL.meta", text)
    read = lambda kind, **more: volumes.read_dataset(spark, meta, kind, str(tmp_path), **more)
    seg = read("segmentation", prefix="VOL")
    assert seg.columns == ["iv", "z", "y", "x", "label"] and {r.iv: r.label for r in seg.collect()} == {i: i for i in range(24)}
    assert {r.iv: r.gold for r in read("gold").collect()} == {i: i for i in range(24)}
    r = read("affinity").where("z = 3 and y = 1 and x = 2").first()
    assert (r.aff_x, r.aff_y, r.aff_z) == (23.25, 23.5, 23.75)
    with pytest.raises(RuntimeError, match="h5py"):
        read("image")  # the default name is an HDF5 file
    with pytest.raises(RuntimeError, match="h5py"):
        volumes.write_h5(seg, str(tmp_path / "o.h5"), "main", (4, 2, 3))
    with pytest.raises(ValueError, match="no gold file"):
        read("gold", prefix="other")


def test_tiff_slices(spark, tmp_path):
    import struct

    a = np.arange(24).reshape(4, 2, 3) * 10**10
    np.save(tmp_path / "v.npy", a)
    files = {r["name"]: bytes(r.content) for r in volumes.tiff_slices(volumes.read_npy(spark, str(tmp_path / "v.npy")), 2, 3, prefix="s").collect()}
    assert sorted(files) == [f"s-{z:05d}.tif" for z in range(4)]
    data = files["s-00002.tif"]
    magic, number, at = struct.unpack("<2sHI", data[:8])
    (n,) = struct.unpack("<H", data[at : at + 2])
    tags = {t: v for t, _, _, v in (struct.unpack("<HHII", data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))}
    assert (magic, number, tags[256], tags[257], tags[258], tags[339]) == (b"II", 42, 3, 2, 64, 2)
    assert (np.frombuffer(data, "<i8", 6, tags[273]) == a[2].ravel()).all() and tags[279] == 48


def test_metadata(spark, tmp_path):
    r = metadata.read_meta(spark, write(tmp_path / "VOL.meta", META)).first()
    assert r.prefix == "VOL" and tuple(r.resolution) == (30.0, 7.0, 6.0) and tuple(r.grid) == (30, 20, 10)
    assert r.crop.z.max == 30 and r.crop.x.min == 0 and r.gold_file == "g.h5 main" and r.image_file == "images/VOL_image.h5 main"
    assert (r.world.zmin, r.world.ymin, r.world.xmin, r.world.zmax) == (3, 2, 1, 6) and not r.is_isotropic


def test_metadata_round_trip(spark, tmp_path):
    once = metadata.read_meta(spark, write(tmp_path / "A.meta", META))
    text = metadata.meta_text(once).first().value
    twice = metadata.read_meta(spark, write(tmp_path / "B.meta", text)).first()
    assert twice.grid == once.first().grid and twice.resolution == once.first().resolution and twice.crop == once.first().crop and twice.world is None
    assert twice.synapse_file is None
    spawned = metadata.spawn_meta(once, "A", "A-reduced", "x.h5 main").where("prefix = 'A-reduced'").first()
    assert spawned.segmentation_file == "x.h5 main" and spawned.gold_file == "g.h5 main"


def test_unknown_metadata_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unknown metadata"):
        metadata.read_meta(spark, write(tmp_path / "x.meta", META + "# colour\nred\n")).collect()


def test_reports(spark, tmp_path):
    records = spark.createDataFrame([(5, 1, 0, 9), (0, 0, 0, 3)], "tp long, fn long, fp long, tn long")
    for i, r in enumerate(reports.inference_text(records).collect()):
        write(tmp_path / f"nodes-P-A-one-inference{i}.txt", r.value)
    got = reports.read_inference(spark, str(tmp_path / "*.txt"))
    assert sorted(tuple(r[1:]) for r in got.collect()) == [(0, 0, 0, 3), (5, 1, 0, 9)]
    assert reports.inference_names(got).first().dataset == "A-one"
    lines = reports.result_text(spark.createDataFrame([(0.1, 0.2, 1.0, 2.0)], "rand_merge double, rand_split double, vi_merge double, vi_split double")).first().value.split("\n")
    assert len(lines) == 6 and lines[3] == "Variation of Information Full: 3.0"


def test_volumes(spark, tmp_path):
    a = np.arange(24).reshape(4, 2, 3)
    np.save(tmp_path / "v.npy", a)
    df = volumes.read_npy(spark, str(tmp_path / "v.npy"))
    assert df.count() == 24 and df.where("z = 2 and y = 1 and x = 0").first().label == a[2, 1, 0]
    volumes.write_volume(df.drop("path"), str(tmp_path / "p"), slab=2)
    part = volumes.read_volume(spark, str(tmp_path / "p"), (2, 3), slab=2)
    assert part.count() == 6 and "slab" not in part.columns
    assert "PartitionFilters: [isnotnull(slab" in part._jdf.queryExecution().executedPlan().toString()
    images = volumes.slice_images(df, 2, 3).orderBy("name").collect()
    assert images[1].name == "-00001.pgm" and bytes(images[1].content).endswith(a[1].astype(np.uint8).tobytes())


def test_affinities(spark):
    r = volumes.affinity_columns(spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "iv long, affinities array<double>")).first()
    assert (r.aff_x, r.aff_y, r.aff_z) == (0.1, 0.2, 0.3)


def test_streaming_counts_equal_batch(spark, tmp_path):
    from lattica import streaming
    from lattica.operators import metrics

    df = spark.range(200).selectExpr("id iv", "id % 5 label", "id % 3 gold")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.start(streaming.running_contingency(stream), "counts", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted(map(tuple, d.select("seg", "gold", "n").collect()))
    assert rows(spark.table("counts")) == rows(metrics.contingency(df))


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module works in a copy without the training-data subpackage and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{root}/jobs", tmp_path / "jobs")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
