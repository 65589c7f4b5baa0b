"""Range and cone joins through cells, and what starts from skeleton endpoints."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.geometry import Geometry
from lattica.operators.neighbors import AXES, BOX, face_pairs
from lattica.operators.kernels import assignment
from lattica.plans import tables
from lattica.plans.bricks import in_boxes
from lattica.plans.components import connected_components
from lattica.plans.joins import dealt_by_rows

CONE = math.cos(0.3216)


#: Exploded rows of a join through cells that one task sorts, about 30 MB of them.
TOGETHER = 1 << 18


def _around(half: bool) -> list[tuple[int, int, int]]:
    """Offsets to the cell itself and its neighbours; with `half` to one of each two that are opposite."""
    cells = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return [o for o in cells if o >= (0, 0, 0)] if half else cells


def _cell(axis: str, size):
    return F.floor(F.col(axis) / F.lit(size)).cast("long")


def binned_join(left: DataFrame, right: DataFrame, sizes, axes=AXES, by: list[str] | None = None, half: bool = False) -> DataFrame:
    """Pairs of rows in the same or neighbouring cells of the given sizes, so all pairs within `sizes` on each axis.

    `left` is exploded into its 27 cells and meets `right` in one equi-join, so a pure range predicate never
    becomes a nested loop; it is a merge join at every size, as a broadcast is chosen by the rows before they
    are exploded, and the driver would hold 27 times that.  Columns of `right` are named n_*.  `by` are columns that must agree as well.  With
    `half` (both sides are the same table) 14 cells do: rows of different cells meet once, in either order, and
    `_same` says that both are in one cell, where they meet in both orders.

    Copies of a row compress well, so tasks put together by shuffled bytes would have 20 times these to sort.  Their
    number follows the rows instead: `left` is counted, so it should be a table.
    """
    by = by or []
    ways = max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() * len(_around(half)) // TOGETHER))
    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)], F.lit(o == (0, 0, 0)).alias("same")) for o in _around(half)])
    l = left.withColumn("_o", F.explode(around))
    for i, (a, s) in enumerate(zip(axes, sizes, strict=True)):
        l = l.withColumn(f"_c{i}", _cell(a, s) + F.col(f"_o.d{i}"))
    l = l.withColumn("_same", F.col("_o.same")).drop("_o") if half else l.drop("_o")
    r = right.select(*[F.col(c).alias(f"n_{c}") for c in right.columns], *[_cell(a, s).alias(f"_r{i}") for i, (a, s) in enumerate(zip(axes, sizes, strict=True))])
    on = (F.col("_c0") == F.col("_r0")) & (F.col("_c1") == F.col("_r1")) & (F.col("_c2") == F.col("_r2"))
    for c in by:
        on = on & (F.col(c) == F.col(f"n_{c}"))
    l, r = l.repartition(ways, *[f"_c{i}" for i in range(3)], *by), r.repartition(ways, *[f"_r{i}" for i in range(3)], *[f"n_{c}" for c in by])
    return l.join(r.hint("merge"), on).drop(*[f"_{k}{i}" for k in "cr" for i in range(3)])


def _gap():
    return sum(((F.col(a) - F.col(f"n_{a}")) ** 2 for a in AXES), F.lit(0))


def points_within(points: DataFrame, radius: int) -> DataFrame:
    """(id, n_id) of all pairs of points at most `radius` apart, id < n_id."""
    own = points.select("id", *AXES)
    pairs = binned_join(own, own, (radius,) * 3, half=True).where((F.col("id") < F.col("n_id")) | ~F.col("_same")).where(_gap() <= radius * radius)
    return pairs.where("id <> n_id").select(F.least("id", "n_id").alias("id"), F.greatest("id", "n_id").alias("n_id"))


def endpoint_pair_match(endpoints: DataFrame, geometry: Geometry, distance: int = 800, angle: float = -1 / math.sqrt(2)) -> DataFrame:
    """Distinct pairs of labels with endpoints at most `distance` nm apart and vectors that point at each other."""
    points = endpoints.select("label", *[(F.col(a) * r).alias(a) for a, r in zip(AXES, geometry.resolution, strict=True)], "vz", "vy", "vx")
    points = tables.written(points, "endpoints")
    pairs = binned_join(points, points, (distance,) * 3, half=True).where(F.col("label") != F.col("n_label"))
    dot = sum((F.col(f"v{a}") * F.col(f"n_v{a}") for a in AXES), F.lit(0.0))
    found = pairs.where((_gap() <= distance * distance) & (dot <= angle)).select(F.least("label", "n_label").alias("label_one"), F.greatest("label", "n_label").alias("label_two"))
    # Dealt by the rows that are looked up: what is found follows these where points lie equally dense.
    return dealt_by_rows(found, points.count() * len(_around(True)), "label_one", "label_two").distinct()


def nearby_matching(truth: DataFrame, proposed: DataFrame, geometry: Geometry, radius: int = 800) -> DataFrame:
    """(label, truth_iv, proposed_iv, distance): one-to-one matches of points of a label less than `radius` nm apart.

    Of all matchings the one with the least sum of distances, where a point of the smaller side that stays alone costs `radius`.
    Partners that are farther cost the same as none, so only pairs within the radius have to be looked at, and what is not
    linked by such pairs is matched on its own: a task gets one connected set of nearby points, not a label.  A pair whose ends have no
    other partner is a match without that.  (`skeleton.endpoint_matching` lets far partners weigh in with their distance and
    drops them then, which can cost a near match.)  Repeated points count once.
    """
    sides = [tables.written(df.select("label", "iv", *[(F.col(a) * r).alias(a) for a, r in zip(AXES, geometry.resolution, strict=True)]).distinct(), "points") for df in (truth, proposed)]
    near = binned_join(*sides, (radius,) * 3, by=["label"]).where(_gap() < radius * radius)
    near = tables.written(near.select("label", F.col("iv").alias("truth_iv"), F.col("n_iv").alias("proposed_iv"), F.sqrt(_gap().cast("double")).alias("distance")), "matching")
    for side in ("truth", "proposed"):
        partners = near.groupBy("label", f"{side}_iv").agg(F.count("*").alias(f"{side}_n"))
        near = near.join(partners, ["label", f"{side}_iv"])
    near = tables.written(near.withColumn("alone", (F.col("truth_n") == 1) & (F.col("proposed_n") == 1)).drop("truth_n", "proposed_n"), "matching")
    linked = near.where(~F.col("alone"))
    roots = connected_components(linked.select((F.col("truth_iv") * 2).alias("a"), (F.col("proposed_iv") * 2 + 1).alias("b")))
    placed = linked.join(roots, F.col("truth_iv") * 2 == F.col("v")).select("label", "truth_iv", "proposed_iv", "distance", "root")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A root's points are of one label unless a voxel is a point of several.
        out = []
        for _, of in pdf.groupby("label"):
            of = of.sort_values(["truth_iv", "proposed_iv"])
            (i, a), (j, b) = (pd.factorize(of[c], sort=True) for c in ("truth_iv", "proposed_iv"))
            cost = np.full((len(a), len(b)), float(radius))
            cost[i, j] = of.distance
            chosen = np.zeros(cost.shape, bool)
            for x, y in assignment(cost):
                chosen[x, y] = True
            out.append(of[chosen[i, j]])
        return pd.concat(out)[["label", "truth_iv", "proposed_iv", "distance"]]

    schema = placed.drop("root").schema
    return near.where("alone").select(*schema.names).unionByName(placed.groupBy("root").applyInPandas(run, schema))


def medial_axis_baseline(pairs: DataFrame, n_positive: int | DataFrame) -> DataFrame:
    """Matched pairs of known truth against the number of all positive pairs (or a table whose one row has it as n_positive)."""
    s = pairs.agg(F.count_if(F.col("truth") == "positive").alias("tp"), F.count_if(F.col("truth") == "negative").alias("fp"))
    if isinstance(n_positive, DataFrame):
        s = s.crossJoin(F.broadcast(n_positive.select("n_positive")))  # one row
    else:
        s = s.withColumn("n_positive", F.lit(n_positive))
    s = s.select("tp", "fp", (F.col("n_positive") - F.col("tp")).alias("fn"))
    return s.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), 6))


def _window(geometry: Geometry, distance: int):
    half = geometry.radius(distance)
    inside = F.lit(True)
    for a, h in zip(AXES, half, strict=True):
        inside = inside & (F.abs(F.col(f"n_{a}") - F.col(a)) <= h)
    return [max(1, h) for h in half], inside


def _aimed(endpoints: DataFrame) -> DataFrame:
    return endpoints.where("vz * vz + vy * vy + vx * vx >= 0.5").select("label", "iv", *AXES, "vz", "vy", "vx")


def _in_cone(aimed: DataFrame, voxels: DataFrame, geometry: Geometry, distance: int) -> DataFrame:
    """(label, iv, neighbour) over boxes with a halo of the window: each offset is looked up for all endpoints of a box at once."""
    half, steps = geometry.radius(distance), geometry.resolution
    whole = [F.col("label").cast("long").alias("label"), "iv", *[F.col(a).cast("long").alias(a) for a in AXES]]
    vectors = [f"v{a}" for a in AXES]
    rows = voxels.select(*whole, *[F.lit(0.0).alias(v) for v in vectors], F.lit(False).alias("point")).unionByName(aimed.select(*whole, *vectors, F.lit(True).alias("point")))

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        point, label, iv = (table.column(c).to_numpy() for c in ("point", "label", "iv"))
        places = np.stack([table.column(a).to_numpy() for a in AXES], axis=1)
        own, near = np.flatnonzero(point & inside), np.flatnonzero(~point)
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(own) and len(near):
            low = np.minimum(places[own].min(axis=0) - half, places[near].min(axis=0))
            shape = np.maximum(places[own].max(axis=0) + half, places[near].max(axis=0)) - low + 1
            grid, strides = np.zeros(int(shape.prod()), np.int64), np.array([shape[1] * shape[2], shape[2], 1])
            grid[(places[near] - low) @ strides] = label[near]
            at = (places[own] - low) @ strides
            v = [table.column(c).to_numpy()[own] for c in vectors]
            for o in itertools.product(*(range(-h, h + 1) for h in half)):
                step = [d * r for d, r in zip(o, steps, strict=True)]
                squared = sum(d * d for d in step)
                if not 0 < squared <= distance * distance:
                    continue
                # dot(v, offset) / |offset| >= cos, without a division
                aims = np.flatnonzero(v[0] * step[0] + v[1] * step[1] + v[2] * step[2] >= CONE * math.sqrt(squared))
                seen = grid[at[aims] + int(np.dot(o, strides))]
                hit = (seen != 0) & (seen != label[own[aims]])
                hits.append((own[aims[hit]], seen[hit]))
        row, seen = map(np.concatenate, zip(*hits, strict=True))
        order = np.lexsort((seen, iv[row], label[row]))
        found = [label[row][order], iv[row][order], seen[order]]
        first = np.ones(len(order), bool)
        first[1:] = np.any([c[1:] != c[:-1] for c in found], axis=0)
        return pa.table([pa.array(c[first]) for c in found], names=["label", "iv", "neighbour"])

    # Endpoints are some of the voxels.
    return in_boxes(rows, BOX, half, run, "label long, iv long, neighbour long", 2 * voxels.count())


def _seen(voxels: DataFrame, label: str) -> DataFrame:
    return voxels.where(F.col(label) != 0).select(F.col(label).alias("label"), "iv", *AXES)


def endpoint_cone(endpoints: DataFrame, voxels: DataFrame, geometry: Geometry, distance: int = 500, label: str = "label") -> DataFrame:
    """(label, iv, neighbour): labels with a voxel at most `distance` nm from an endpoint inside its cone."""
    return _in_cone(_aimed(endpoints), _seen(voxels, label), geometry, distance)


def endpoint_traversal(endpoints: DataFrame, voxels: DataFrame, geometry: Geometry, distance: int = 500, label: str = "label") -> DataFrame:
    """(label, iv, neighbour, z, y, x): neighbours in the cone that touch the endpoint's label inside its window.

    The place is the mean of the midpoints of the faces between both labels whose lower voxel is in the window,
    cut to whole numbers.
    """
    sizes, inside = _window(geometry, distance)
    aimed = tables.written(_aimed(endpoints), "endpoints")
    near = _seen(voxels, label)
    faces = face_pairs(near)
    axis = [(2 * F.col(a) + (F.col("axis") == a).cast("long")).alias(f"m{a}") for a in AXES]
    sides = F.explode(F.array(F.struct(F.col("label").alias("label"), F.col("n_label").alias("other")), F.struct(F.col("n_label").alias("label"), F.col("label").alias("other"))))
    sided = faces.select(sides.alias("_s"), *AXES, *axis).select("_s.label", "_s.other", *AXES, *[f"m{a}" for a in AXES])
    pairs = binned_join(aimed, sided, sizes, by=["label"]).where(inside)
    means = pairs.groupBy("label", "iv", F.col("n_other").alias("neighbour")).agg(*[F.floor(F.sum(f"n_m{a}") / (2 * F.count("*"))).cast("long").alias(a) for a in AXES])
    return means.join(_in_cone(aimed, near, geometry, distance), ["label", "iv", "neighbour"])
