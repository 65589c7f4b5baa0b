"""Candidates and their feature cubes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.geometry import Geometry
from lattica.operators.neighbors import AXES


def extract_example(voxels: DataFrame, one: int, two: int, label: str = "label") -> DataFrame:
    """Voxels of other labels become 0."""
    return voxels.withColumn(label, F.when(F.col(label).isin(one, two), F.col(label)).otherwise(0).cast("long"))


def _cells(width) -> list[tuple[int, int, int]]:
    return [(z, y, x) for z in range(width[0]) for y in range(width[1]) for x in range(width[2])]


def scale_feature(voxels: DataFrame, size, width, one: int, two: int, label: str = "label") -> DataFrame:
    """(iz, iy, ix, val): cell i of an axis takes voxel int(size / width * i); label one is 1, two is 2, others 0."""
    spark = voxels.sparkSession
    grid = spark.createDataFrame([(*c, *[int(float(n) / float(w) * i) for n, w, i in zip(size, width, c, strict=True)]) for c in _cells(width)], "iz long, iy long, ix long, _z long, _y long, _x long")
    own = voxels.where(F.col(label).isin(one, two)).select(*AXES, label)
    joined = grid.join(own, (F.col("_z") == F.col("z")) & (F.col("_y") == F.col("y")) & (F.col("_x") == F.col("x")), "left")
    value = F.when(F.col(label) == one, 1).when(F.col(label) == two, 2).otherwise(0)
    return joined.select("iz", "iy", "ix", value.cast("int").alias("val"))


def feature_cubes(candidates: DataFrame, voxels: DataFrame, geometry: Geometry, width, radius: int, label: str = "label") -> DataFrame:
    """`candidates(..., z, y, x, label_one, label_two)` with cube array<int>, in raster order.

    The window has int(radius / resolution) voxels to each side and is empty outside of the grid.  Only the
    window's voxels that a cell of the cube takes are looked up, by one equi-join on the place in the grid.
    """
    reach = geometry.radius(radius)
    offsets = [tuple(int(float(2 * h + 1) / float(w) * i) - h for h, w, i in zip(reach, width, c, strict=True)) for c in _cells(width)]
    cells = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for k, o in enumerate(offsets)])
    keys = ["label_one", "label_two", *AXES]
    place = lambda z, y, x: (z * geometry.ny + y) * geometry.nx + x
    inside = F.lit(True)
    for a, n in zip(AXES, (geometry.nz, geometry.ny, geometry.nx), strict=True):
        inside = inside & F.col(f"_{a}").between(0, n - 1)
    asked = candidates.select(*keys).distinct().withColumn("_c", F.explode(cells))
    asked = asked.select(*keys, F.col("_c.k").alias("k"), *[(F.col(a) + F.col(f"_c.d{a}")).alias(f"_{a}") for a in AXES])
    # Cells outside of the grid have a key that no voxel has.
    asked = asked.select(*keys, "k", F.when(inside, place(F.col("_z"), F.col("_y"), F.col("_x"))).otherwise(-1).alias("_at"))
    own = voxels.where(F.col(label) != 0).select(place(F.col("z"), F.col("y"), F.col("x")).alias("_place"), F.col(label).alias("_l"))
    joined = asked.join(own, F.col("_at") == F.col("_place"), "left")
    value = F.when(F.col("_l") == F.col("label_one"), 1).when(F.col("_l") == F.col("label_two"), 2).otherwise(0)
    cubes = joined.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda s: s["v"]).alias("cube"))
    return candidates.join(cubes, keys)


def example_channels(cells: DataFrame, channels: int = 3, swapped: bool = False) -> DataFrame:
    """Cells (val 0, 1 or 2) as channels of -0.5 and 0.5: either label, label one, label two (or the last two swapped)."""
    on = lambda c: F.when(c, 0.5).otherwise(-0.5)
    out = [on(F.col("val") > 0).alias("c0")]
    if channels > 1:
        a, b = (2, 1) if swapped else (1, 2)
        out += [on(F.col("val") == a).alias("c1"), on(F.col("val") == b).alias("c2")]
    return cells.select("iz", "iy", "ix", *out)


def augment(examples: DataFrame, width, seed: int = 0) -> DataFrame:
    """`examples(id, cube)` with random variants: labels swapped or not, z flipped or not, rotated in the plane.

    Random by design; a seed and the id decide, so reruns agree.
    """
    shape = tuple(width)

    def run(batches):
        for pdf in batches:
            out = []
            for i, cube in zip(pdf["id"], pdf["cube"], strict=True):
                rng = np.random.default_rng([seed, abs(hash(int(i)))])
                a = np.asarray(cube, dtype=np.int32).reshape(shape)
                if rng.random() < 0.5:
                    a = np.array([0, 2, 1])[a]
                if rng.random() < 0.5:
                    a = a[::-1]
                angle, (ny, nx) = rng.uniform(0, 2 * np.pi), shape[1:]
                y, x = np.mgrid[:ny, :nx]
                cy, cx = (ny - 1) / 2, (nx - 1) / 2
                sy = np.rint(cy + (y - cy) * np.cos(angle) - (x - cx) * np.sin(angle)).astype(int)
                sx = np.rint(cx + (y - cy) * np.sin(angle) + (x - cx) * np.cos(angle)).astype(int)
                inside = (sy >= 0) & (sy < ny) & (sx >= 0) & (sx < nx)
                turned = np.where(inside[None], a[:, np.clip(sy, 0, ny - 1), np.clip(sx, 0, nx - 1)], 0)
                out.append(turned.reshape(-1).tolist())
            yield pd.DataFrame({"id": pdf["id"], "cube": out})

    return examples.select("id", "cube").mapInPandas(run, "id long, cube array<int>")


BUCKETS = tuple((t, f) for f in (False, True) for t in ("positive", "negative", "unknown"))


#: Labels of a range in which candidates are ordered by one task.
RANGE = 100_000


def examples_union(candidates: DataFrame, forward: bool = True) -> DataFrame:
    """Candidates by bucket: positive, negative and unknown, then (if asked) those of the forward region.

    source_rank is the bucket's place, ordinal the place inside of it.
    """
    parts = []
    for rank, (truth, outside) in enumerate(BUCKETS if forward else BUCKETS[:3]):
        own = candidates.where((F.col("truth") == truth) & (F.col("forward") == outside))
        parts.append(own.withColumn("source_rank", F.lit(rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Two levels: inside of ranges of labels, and over the ranges' counts, so that no task orders a bucket.
    out = out.withColumn("_range", F.floor(F.col("label_one") / RANGE))
    ranges = out.groupBy("source_rank", "_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("source_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source_rank", "_range").orderBy("label_one", "label_two", *AXES)) - 1
    ranked = out.withColumn("_i", place).join(ranges.select("source_rank", "_range", before.alias("_b")), ["source_rank", "_range"])
    return ranked.withColumn("ordinal", F.col("_i") + F.col("_b")).select(*candidates.columns, "source_rank", "ordinal")


def balanced_batches(examples: DataFrame, seed: int = 7) -> DataFrame:
    """As many positives as negatives in random order, side by side: batch position, truth and the example.

    The order is that of the MD5 of seed and example.  Examples are ranked in 256 ranges of it, whose counts give
    each range's first rank, so that no task orders all examples of a kind.
    """
    known = examples.where("truth in ('positive', 'negative')")
    known = known.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "label_one", "label_two", *AXES).cast("binary"))).withColumn("_range", F.substring("_h", 1, 2))
    ranges = known.groupBy("truth", "_range").agg(F.count("*").alias("_c"))
    first = F.coalesce(F.sum("_c").over(Window.partitionBy("truth").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("truth", "_range").orderBy("_h")
    ranked = known.withColumn("_i", F.row_number().over(order) - 1).join(ranges.select("truth", "_range", first.alias("_first")), ["truth", "_range"])
    ranked = ranked.withColumn("_k", F.col("_i") + F.col("_first")).drop("_h", "_range", "_i", "_first")
    sizes = known.groupBy("truth").agg(F.count("*").alias("_n")).agg(F.when(F.count("*") == 2, F.min("_n")).otherwise(0).alias("_least"))
    both = ranked.crossJoin(F.broadcast(sizes)).where("_k < _least")  # one row
    return both.withColumn("position", 2 * F.col("_k") + (F.col("truth") == "negative").cast("int")).drop("_k", "_least")


def restricted(examples: DataFrame, names: tuple[str, ...], subset: str, kind: str = "nodes", file: str = "file") -> DataFrame:
    """Examples of files whose name holds all of `names`, for fine-tuning on a dataset.

    Of nodes, the subset `validation` is read from `training`; of edges, files of `reduced-nodes` are left out.
    """
    held = F.lit(True)
    for n in names:
        held = held & F.col(file).contains(n)
    if kind == "edges":
        held = held & ~F.col(file).contains("reduced-nodes")
    return examples.where(held & (F.col("subset") == ("training" if kind == "nodes" and subset == "validation" else subset)))


def merge_nodes(pairs: DataFrame, small: DataFrame, label_one: str = "label_one", label_two: str = "label_two") -> DataFrame:
    """(label, mapped): each small label goes to its large neighbour of the highest p unless that is below 0.5; others stay."""
    from lattica.operators.neighbors import best_large_neighbour

    best = best_large_neighbour(pairs.select(F.col(label_one).alias("label_one"), F.col(label_two).alias("label_two"), "p"), small, "p")
    chosen = best.where("p >= 0.5").select("label", F.col("best"))
    return small.select("label").join(chosen, "label", "left").select("label", F.coalesce("best", "label").alias("mapped"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(label, mapped) of second after first."""
    then = second.select(F.col("label").alias("_from"), F.col("mapped").alias("_to"))
    return first.join(then, F.col("mapped") == F.col("_from"), "left").select("label", F.coalesce("_to", "mapped").alias("mapped"))
