"""Volumes: datasets by their metadata, Parquet by slabs of planes, affinity channels, and stacks of images."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLAB = 64


def write_volume(voxels: DataFrame, path: str, slab: int = SLAB, codec: str = "zstd") -> None:
    """Partitioned by slabs of planes, so that a range of z reads only its folders."""
    out = voxels.withColumn("slab", F.floor(F.col("z") / slab).cast("long"))
    out.repartition("slab").sortWithinPartitions("iv").write.option("compression", codec).partitionBy("slab").parquet(path)


def read_volume(spark: SparkSession, path: str, z_range: tuple[int, int] | None = None, slab: int = SLAB) -> DataFrame:
    df = spark.read.parquet(path)
    if z_range and "slab" in df.columns:
        low, high = z_range
        df = df.where(F.col("slab").between(low // slab, (high - 1) // slab))
    if z_range:
        df = df.where((F.col("z") >= z_range[0]) & (F.col("z") < z_range[1]))
    return df.drop("slab")


def affinity_columns(df: DataFrame, channels: str = "affinities") -> DataFrame:
    """An array of channels (0: x, 1: y, 2: z) as aff_x, aff_y and aff_z."""
    return df.withColumns({f"aff_{a}": F.col(channels)[k] for k, a in enumerate("xyz")}).drop(channels)


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py, which isn't installed; convert to Parquet or NumPy first") from e
    return h5py


def read_h5(path: str, dataset: str | None = None) -> np.ndarray:
    """A dataset (the first one if none is named) as float32, uint8 or int64; needs h5py."""
    with _h5py().File(path, "r") as f:
        data = np.array(f[dataset or next(iter(f))])
    return data if data.dtype in (np.float32, np.uint8, np.int64) else data.astype(np.int64)


def read_h5_volume(spark: SparkSession, path: str, dataset: str | None = None, planes: int = SLAB) -> DataFrame:
    """A dataset's voxels (iv, z, y, x, label; or `affinities` of three channels): each task reads its own planes.

    Needs h5py, and a path that all executors can open.
    """
    h5py = _h5py()
    with h5py.File(path, "r") as f:
        shape = f[dataset or next(iter(f))].shape
    first = len(shape) == 4 and shape[0] == 3  # channels stand first
    nz = shape[1] if first else shape[0]

    def run(batches):
        import h5py

        with h5py.File(path, "r") as f:
            data = f[dataset or next(iter(f))]
            for pdf in batches:
                for low in pdf["id"] * planes:
                    for z in range(low, min(low + planes, nz)):
                        yield _plane(np.moveaxis(data[:, z], 0, -1) if first else data[z], z)

    schema = "iv long, z long, y long, x long, " + ("affinities array<float>" if len(shape) == 4 else "label long")
    return spark.range(-(-nz // planes)).repartition(max(1, -(-nz // planes))).mapInPandas(run, schema)


def _plane(plane: np.ndarray, z: int) -> pd.DataFrame:
    y, x = np.indices(plane.shape[:2])
    out = pd.DataFrame({"iv": z * y.size + np.arange(y.size), "z": z, "y": y.ravel(), "x": x.ravel()})
    if plane.ndim == 3:
        return out.assign(affinities=list(plane.reshape(-1, plane.shape[2]).astype(np.float32)))
    return out.assign(label=plane.ravel().astype(np.int64))


def write_h5(voxels: DataFrame, path: str, dataset: str, shape: tuple[int, int, int], value: str = "label", compression: bool = True) -> None:
    """A volume as one HDF5 dataset; planes come to the driver one after another, as the format has one writer.  Needs h5py."""
    h5py = _h5py()
    planes = voxels.select("z", "y", "x", F.col(value).alias("v")).repartitionByRange("z").sortWithinPartitions("z")
    with h5py.File(path, "w") as f:
        data = f.create_dataset(dataset, shape=shape, dtype="int64", chunks=(1, *shape[1:]), **({"compression": "gzip"} if compression else {}))
        plane, at = np.zeros(shape[1:], np.int64), None
        for r in planes.toLocalIterator():
            if at is not None and r.z != at:
                data[at] = plane
                plane[:] = 0
            at = r.z
            plane[r.y, r.x] = r.v
        if at is not None:
            data[at] = plane


#: Kinds of data that metadata names, and the column of their values.
KINDS = {"segmentation": "label", "gold": "gold", "image": "image", "affinity": "affinities"}


def read_dataset(spark: SparkSession, meta_path, kind: str, folder: str = "", prefix: str | None = None) -> DataFrame:
    """The voxels of a dataset's segmentation, gold, image or affinity, from the file that its metadata names.

    The format goes by the file's ending: Parquet, NumPy's, HDF5 (the dataset's name follows the file's), else a folder
    of images.  Segmentation and gold are cast to 64-bit integers; affinities become aff_x, aff_y and aff_z.
    """
    from lattica.sources.metadata import read_meta

    meta = read_meta(spark, meta_path)
    rows = (meta.where(F.col("prefix") == prefix) if prefix else meta).select(f"{kind}_file").limit(2).collect()
    if len(rows) != 1 or not rows[0][0]:
        raise ValueError(f"{meta_path}: no {kind} file, or more than one dataset")
    name, _, dataset = rows[0][0].partition(" ")
    path = f"{folder.rstrip('/')}/{name}" if folder else name
    value = KINDS[kind]
    if name.endswith(".parquet"):
        out = read_volume(spark, path)
    elif name.endswith(".npy"):
        out = read_npy(spark, path, channels=kind == "affinity").drop("path")
    elif name.endswith((".h5", ".hdf5")):
        out = read_h5_volume(spark, path, dataset or None)
    else:
        out = read_image_stack(spark, path)
    if value not in out.columns:
        out = out.withColumnRenamed("label", value)
    if kind == "affinity":
        return affinity_columns(out)
    return out.withColumn(value, F.col(value).cast("long"))


def read_npy(spark: SparkSession, path, channels: bool = False) -> DataFrame:
    """(path, iv, z, y, x, label) of volumes in NumPy's own format, through `binaryFile`; planes are cut up where they are read.

    With `channels` the volume has three of them, first or last, and `affinities` instead of a label.  A file has 2 GB
    at most, as `binaryFile` holds it in one row; larger volumes are folders of files by slab, or Parquet.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content, strict=True):
                data = np.load(io.BytesIO(bytes(c)))
                if channels and data.shape[0] == 3:
                    data = np.moveaxis(data, 0, -1)
                for z, plane in enumerate(data):
                    yield _plane(plane, z).assign(path=p)[names]

    schema = "path string, iv long, z long, y long, x long, " + ("affinities array<float>" if channels else "label long")
    names = [c.split()[0] for c in schema.split(", ")]
    return files.mapInPandas(run, schema)


def read_image_stack(spark: SparkSession, path) -> DataFrame:
    """(z, y, x, label) of a folder of PNG or other images that Spark's image source decodes.

    z is the place of a file in the order of paths; three-channel pixels are 65536 r + 256 g + b.
    """
    images = spark.read.format("image").load(path).select("image.*")
    z = F.row_number().over(Window.orderBy("origin")) - 1  # one row for each plane
    order = images.select("origin").withColumn("z", z)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                a = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, row.nChannels).astype(np.int64)
                v = a[..., 0] if row.nChannels == 1 else 65536 * a[..., 2] + 256 * a[..., 1] + a[..., 0]
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"z": row.z, "y": y.ravel(), "x": x.ravel(), "label": v.ravel()})

    return images.join(order, "origin").select("z", "height", "width", "nChannels", "data").mapInPandas(run, "z long, y long, x long, label long")


def slice_images(voxels: DataFrame, ny: int, nx: int, value: str = "label") -> DataFrame:
    """(name, content): each plane as a binary PGM image `-%05d.pgm`, values cut to a byte."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx), np.uint8)
        a[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.v.to_numpy().astype(np.int64) & 255
        return pd.DataFrame({"name": [f"-{int(pdf.z.iloc[0]):05d}.pgm"], "content": [b"P5 %d %d 255\n" % (nx, ny) + a.tobytes()]})

    return voxels.select("z", "y", "x", F.col(value).alias("v")).groupBy("z").applyInPandas(run, "name string, content binary")


def tiff(image: np.ndarray) -> bytes:
    """An uncompressed grey TIFF of one strip, of any integer or float kind that NumPy has."""
    data = np.ascontiguousarray(image)
    data = data.astype(data.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = [(256, 4, data.shape[1]), (257, 4, data.shape[0]), (258, 3, 8 * data.dtype.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, data.shape[0]), (279, 4, data.nbytes), (339, 3, kind)]
    body = data.tobytes()
    body += bytes(len(body) % 2)
    entries = b"".join(struct.pack("<HHII", tag, form, 1, v) for tag, form, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + bytes(4)


def tiff_slices(voxels: DataFrame, ny: int, nx: int, value: str = "label", prefix: str = "", dtype: str = "int64") -> DataFrame:
    """(name, content): each plane as `<prefix>-%05d.tif` with its values as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx), dtype)
        a[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.v.to_numpy()
        return pd.DataFrame({"name": [f"{prefix}-{int(pdf.z.iloc[0]):05d}.tif"], "content": [tiff(a)]})

    return voxels.select("z", "y", "x", F.col(value).alias("v")).groupBy("z").applyInPandas(run, "name string, content binary")


def write_examples(examples: DataFrame, path: str) -> None:
    """Examples by feature, subset and truth; Spark makes the folders."""
    examples.write.partitionBy(*[c for c in ("feature", "subset", "truth") if c in examples.columns]).parquet(path)
