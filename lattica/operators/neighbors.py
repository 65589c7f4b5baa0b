"""Neighbour joins on a voxel grid and what is counted at label boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.kernels import OFFSETS_26, Box
from lattica.plans.bricks import AXES, face_rows, face_sums, in_boxes
from lattica.plans.joins import dealt_by_rows


def neighbour_pairs(voxels: DataFrame, offsets, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Each voxel with each present neighbour: `columns` of the voxel and `n_<column>` of the neighbour, and `k`, the offset's place.

    One equi-join: offsets are exploded on one side only, so rows grow with the number of offsets and no pair
    of unrelated voxels is formed.  `by` are more columns that must agree (say the label).  The number of its tasks
    follows the exploded rows, so `voxels` are counted.
    """
    by = by or []
    steps = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for k, o in enumerate(offsets)])
    reach = voxels.select(*{c: None for c in [*columns, *AXES, *by]}, F.explode(steps).alias("_o"))
    reach = reach.select(*columns, F.col("_o.k").alias("k"), *[F.col(c).alias(f"_b{c}") for c in by], *[(F.col(a) + F.col(f"_o.d{a}")).alias(f"_{a}") for a in AXES])
    other = voxels.select(*[F.col(c).alias(f"n_{c}") for c in columns], *[F.col(a).alias(f"_n{a}") for a in AXES], *[F.col(c).alias(f"_nb{c}") for c in by])
    rows = voxels.count() * len(offsets)
    reach, other = dealt_by_rows(reach, rows, *[f"_{a}" for a in AXES], *[f"_b{c}" for c in by]), dealt_by_rows(other, rows, *[f"_n{a}" for a in AXES], *[f"_nb{c}" for c in by])
    on = [F.col(f"_{a}") == F.col(f"_n{a}") for a in AXES] + [F.col(f"_b{c}") == F.col(f"_nb{c}") for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return reach.join(other, cond).select(*columns, *[f"n_{c}" for c in columns], "k")


def face_pairs(voxels: DataFrame, label: str = "label", extra: list[str] | None = None) -> DataFrame:
    """Faces between voxels of different labels: axis (z, y or x), the lower voxel and its upper neighbour."""
    return face_rows(voxels, label, list(dict.fromkeys(["iv", *AXES, label, *(extra or [])])))


def adjacency(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct pairs of touching labels, 0 left out."""
    return face_sums(voxels.where(F.col(label) != 0), label).select("label_one", "label_two")


def middle_boundary(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Mean of the face midpoints of each pair, 0 included.  Doubled coordinates keep the sums exact."""
    return face_sums(voxels, label).select("label_one", "label_two", "n", *[(F.col(f"s{a}") / (2.0 * F.col("n"))).alias(f"{a}_mean") for a in AXES])


def mean_affinity(voxels: DataFrame, label: str = "label", scale: float = 1000.0) -> DataFrame:
    """Mean affinity of each pair: the lower voxel's channel of the face's axis, in units of 1 / scale."""
    out = face_sums(voxels, label, ["aff_z", "aff_y", "aff_x"])
    return out.select("label_one", "label_two", "n", "total", (F.col("total") / (F.col("n") * scale)).alias("affinity"))


#: Voxels of a box in which neighbours are looked up, without its halo.
BOX = (32, 64, 128)


def neighbour_mask(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, iv, mask, n): 26 bits, one for each neighbour of the same label, in raster order; one shuffle of the voxels."""
    own = voxels.select(F.col(label).cast("long").alias("label"), "iv", *AXES)

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        masks = _box(table, "label").masks(np.flatnonzero(inside))
        kept = table.select(["label", "iv"]).filter(pa.array(inside))
        return kept.append_column("mask", pa.array(masks)).append_column("n", pa.array(np.bitwise_count(masks).astype(np.int64)))

    return in_boxes(own, BOX, (1, 1, 1), run, "label long, iv long, mask long, n long")


def _box(table: pa.Table, label: str, pad: int = 1) -> Box:
    return Box(np.stack([table.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64), table.column(label).to_numpy(), pad)


def _plane_edges(box: Box) -> np.ndarray:
    """Which points touch another label inside their plane."""
    every, edge = np.arange(len(box.at)), np.zeros(len(box.at), bool)
    for o in ((0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)):
        other = box.place[box.beside(every, o)]
        edge |= (other != 0) & (other != box.codes)
    return edge


def plane_edges(table: pa.Table, label: str) -> np.ndarray:
    """Which voxels of a table touch another label inside their plane."""
    return _plane_edges(_box(table, label))


def plane_boundary(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Voxels that touch another label inside their plane (both sides of the boundary); one shuffle of the voxels."""
    own = voxels.select("iv", *AXES, label)

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        return table.select(["iv", *AXES]).filter(pa.array(inside & plane_edges(table, label)))

    return in_boxes(own, BOX, (0, 1, 1), run, own.drop(label).schema)


def dilate_gold(voxels: DataFrame, distance: int, label: str = "label") -> DataFrame:
    """Labels within `distance` of a boundary in their plane become 0; one shuffle of the voxels.

    A box sees `distance` and one more around it: where the boundary is, and the whole-number offsets of a disc around it.
    """
    disc = [(0, dy, dx) for dy in range(-distance, distance + 1) for dx in range(-distance, distance + 1) if dy * dy + dx * dx <= distance * distance]
    kind = voxels.schema[label].dataType

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        box = _box(table, label, max(1, distance))
        edge, near = np.flatnonzero(_plane_edges(box)), np.zeros(len(box.place), bool)
        for o in disc:
            near[box.beside(edge, o)] = True
        labels = np.where(near[box.at], 0, table.column(label).to_numpy())
        return table.set_column(table.schema.get_field_index(label), label, pa.array(labels)).filter(pa.array(inside))

    own = voxels.withColumn(label, F.col(label).cast("long"))
    return in_boxes(own, BOX, (0, distance + 1, distance + 1), run, own.schema).withColumn(label, F.col(label).cast(kind))


def best_large_neighbour(pairs: DataFrame, small: DataFrame, score: str) -> DataFrame:
    """(label, best): for each small label the large one it touches with the best score, smallest id on ties.

    `pairs(label_one, label_two, <score>)` without label 0; `small(label, is_small)`.
    """
    both = pairs.select(F.col("label_one").alias("label"), F.col("label_two").alias("other"), score).unionByName(pairs.select(F.col("label_two").alias("label"), F.col("label_one").alias("other"), score))
    both = both.join(small.where("is_small").select("label"), "label").join(small.where("not is_small").select(F.col("label").alias("other")), "other")
    best = both.groupBy("label").agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("other")).alias("o"))).alias("b"))
    return best.select("label", (-F.col("b.o")).alias("best"), F.col("b.s").alias(score))


def isolated_small(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """Small labels other than 0 without a large neighbour."""
    own = small.where("is_small and label <> 0").select("label")
    return own.join(best_large_neighbour(pairs.withColumn("_s", F.lit(1)), small, "_s").select("label"), "label", "left_anti")


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; Spark keeps only firsts before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
