"""Voxel transforms.  A volume has columns iv, z, y, x and a label column; label 0 is background."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import colorize, dense_ids
from lattica.geometry import Geometry


def label_volume(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def max_label(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.agg(F.max(label).alias("max_label"), (F.max(label) + 1).alias("size"))


def unique_labels(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.select(F.col(label).alias("label")).distinct().orderBy("label")


def topk_labels(voxels: DataFrame, k: int = 500, label: str = "label") -> DataFrame:
    """The k largest labels other than 0, ties to the larger label."""
    return label_volume(voxels.where(F.col(label) != 0), label).orderBy(F.desc("n"), F.desc("label")).limit(k)


def label_bbox(voxels: DataFrame, label: str = "label") -> DataFrame:
    ends = [f(a).alias(f"{a}{n}") for a in "zyx" for f, n in ((F.min, "min"), (F.max, "max"))]
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("label")).agg(*ends)


def small_segments(voxels: DataFrame, threshold: int, label: str = "label") -> DataFrame:
    """Label 0 is judged like any other."""
    return label_volume(voxels, label).withColumn("is_small", F.col("n") < threshold)


def remove_small(voxels: DataFrame, threshold: int = 64, label: str = "label") -> DataFrame:
    """Labels of fewer than `threshold` voxels become 0; 0 changes nothing.

    Counts are aggregated before they shuffle and joined back, so a hot label is never gathered.
    """
    if threshold == 0:
        return voxels
    small = label_volume(voxels, label).where(F.col("n") < threshold).select(F.col("label").alias("_small"))
    joined = voxels.join(small, F.col(label) == F.col("_small"), "left")
    return joined.withColumn(label, F.when(F.col("_small").isNull(), F.col(label)).otherwise(F.lit(0)).cast("long")).drop("_small")


def reduce_labels(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, mapped): 0 to 0, others to 1, 2, ... in rising order."""
    own = voxels.select(F.col(label).alias("label")).distinct()
    return dense_ids(own.where("label <> 0"), "label", "mapped").unionByName(own.where("label = 0").withColumn("mapped", F.lit(0).cast("long")))


def map_labels(voxels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Labels replaced by mapping(label, mapped), others as they are."""
    m = mapping.select(F.col("label").alias("_from"), F.col("mapped").alias("_to"))
    joined = voxels.join(m, F.col(label) == F.col("_from"), "left")
    return joined.withColumn(label, F.coalesce("_to", label)).drop("_from", "_to")


def split_data(voxels: DataFrame, geometry: Geometry, axis: str, threshold: float = 0.5) -> DataFrame:
    """`part` 0 below int(threshold * size) on an axis, else 1."""
    size = {"z": geometry.nz, "y": geometry.ny, "x": geometry.nx}[axis]
    return voxels.withColumn("part", (F.col(axis) >= int(threshold * size)).cast("int"))


def mask_and_crop(voxels: DataFrame, labels: Iterable[int], label: str = "label") -> DataFrame:
    """Only the listed labels, cropped to their box (both ends inside) with its corner at the origin."""
    own = F.col(label).isin(list(labels))
    box = voxels.where(own).agg(*[f(a).alias(f"_{a}{n}") for a in "zyx" for f, n in ((F.min, "0"), (F.max, "1"))])
    inside = voxels.crossJoin(F.broadcast(box))  # one row
    for a in "zyx":
        inside = inside.where(F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1")))
    return inside.select(*[(F.col(a) - F.col(f"_{a}0")).alias(a) for a in "zyx"], F.when(own, F.col(label)).otherwise(0).cast("long").alias("label"))


def downsample_nearest(voxels: DataFrame, geometry: Geometry, ratio=(1, 2, 2), label: str = "label") -> DataFrame:
    """Target voxel i of an axis takes source int(i * ratio); an axis has int(size / ratio) targets."""
    out = voxels
    spark = voxels.sparkSession
    for a, size, r in zip("zyx", (geometry.nz, geometry.ny, geometry.nx), ratio, strict=True):
        # One row for each place on an axis, not for each voxel.
        axis = spark.range(int(size / r)).select(F.col("id").alias(f"_{a}"), F.floor(F.col("id") * F.lit(float(r))).cast("long").alias(f"_s{a}"))
        out = out.join(axis, F.col(a) == F.col(f"_s{a}"))
    return out.select(*[F.col(f"_{a}").alias(a) for a in "zyx"], F.col(label).alias("label"))


def rgb_decode(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long"))


def grey_rgb(df: DataFrame, image: str = "image") -> DataFrame:
    """The grey value of a voxel as its red, green and blue."""
    return df.withColumns({n: F.col(image) for n in "rgb"})


def overlay(df: DataFrame, alpha: float = 0.5, label: str = "label", image: str = "image") -> DataFrame:
    """Label colours over a grey image; black labels show the image; values are cut to whole numbers."""
    colours = colorize(F.col(label))
    black = sum(colours[1:], colours[0]) == 0
    mixed = [F.when(black, F.col(image)).otherwise(F.floor(alpha * c + (1 - alpha) * F.col(image))).cast("long").alias(n) for c, n in zip(colours, "rgb", strict=True)]
    return df.select("iv", *mixed)


def bbox_intersection(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Boxes common to labels a_label and b_label of `pairs`; ends are inside, `empty` where none is."""
    ends = [f"{x}{e}" for x in "zyx" for e in ("min", "max")]
    l = a.select(F.col("label").alias("a_label"), *[F.col(e).alias(f"_a{e}") for e in ends])
    r = b.select(F.col("label").alias("b_label"), *[F.col(e).alias(f"_b{e}") for e in ends])
    joined = pairs.join(l, "a_label").join(r, "b_label")
    both = [(F.greatest if e.endswith("min") else F.least)(f"_a{e}", f"_b{e}").alias(e) for e in ends]
    out = joined.select("a_label", "b_label", *both)
    return out.withColumn("empty", (F.col("zmin") > F.col("zmax")) | (F.col("ymin") > F.col("ymax")) | (F.col("xmin") > F.col("xmax")))


def downsample_topological(voxels: DataFrame, geometry: Geometry, output=(80, 80, 80), label: str = "label") -> DataFrame:
    """(label, dz, dy, dx): cells in which any voxel of a label falls, in exact integer arithmetic."""
    cells = [F.floor(F.col(a) * r / o).cast("long").alias(f"d{a}") for a, r, o in zip("zyx", geometry.resolution, output, strict=True)]
    return voxels.where(F.col(label) != 0).select(F.col(label).alias("label"), *cells).distinct()


def upsample_representative(voxels: DataFrame, geometry: Geometry, output=(80, 80, 80), label: str = "label") -> DataFrame:
    """(label, dz, dy, dx, up_iv): a cell's voxel nearest to its centre by L1, the first in raster order on ties."""
    cells, gaps = [], []
    for a, r, o, n in zip("zyx", geometry.resolution, output, (geometry.nz, geometry.ny, geometry.nx), strict=True):
        cell = F.floor(F.col(a) * r / o).cast("long")
        low = F.ceil(cell * o / r)
        high = F.least(F.ceil((cell + 1) * o / r), F.lit(n))
        cells.append(cell.alias(f"d{a}"))
        gaps.append(F.abs(F.col(a) - F.floor((low + high) / 2)))
    own = voxels.where(F.col(label) != 0).select(F.col(label).alias("label"), *cells, F.struct(sum(gaps[1:], gaps[0]).alias("gap"), "iv").alias("best"))
    return own.groupBy("label", "dz", "dy", "dx").agg(F.min("best").alias("best")).select("label", "dz", "dy", "dx", F.col("best.iv").alias("up_iv"))


def slice_ids(df: DataFrame, path: str = "path") -> DataFrame:
    """`z` of images of a stack: the place of their path in order."""
    return df.withColumn("z", F.row_number().over(Window.orderBy(path)) - 1)
