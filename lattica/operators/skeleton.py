"""Skeletons: endpoints, vectors, thinning, TEASER, upsampling and the endpoint benchmark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.geometry import Geometry
from lattica.operators import kernels, neighbors
from lattica.operators.neighbors import AXES, OFFSETS_26, neighbour_mask, neighbour_pairs, plane_edges
from lattica.plans import tables
from lattica.plans.bricks import along_lines, in_boxes
from lattica.plans.joins import dealt_by_rows


def skeleton_endpoints(skeleton: DataFrame) -> DataFrame:
    """Points with at most 2 occupied voxels of their label in the 3x3x3 around, themselves included."""
    mask = neighbour_mask(skeleton)
    ends = mask.where("n <= 1").select(F.col("label").alias("_l"), F.col("iv").alias("_i"))
    rows = skeleton.count()
    points, ends = dealt_by_rows(skeleton, rows, "label", "iv"), dealt_by_rows(ends, rows, "_l", "_i")
    return points.join(ends, (F.col("label") == F.col("_l")) & (F.col("iv") == F.col("_i"))).select("label", "iv", *AXES)


def endpoint_vectors(skeleton: DataFrame) -> DataFrame:
    """Endpoints with unit vectors away from the skeleton.

    From each endpoint a walk of at most 3 steps goes on while there is exactly one neighbour that was not
    walked; the vector is the endpoint minus the last point, zero where there is no neighbour.  The walk is
    three joins with a table of neighbours: a point's list has at most 26 entries.  Tasks follow the number of these.
    """
    rows = skeleton.count() * len(OFFSETS_26)
    pairs = neighbour_pairs(skeleton, OFFSETS_26, ["iv", *AXES], ["label"]).select("iv", F.struct(F.col("n_iv").alias("iv"), *[F.col(f"n_{a}").alias(a) for a in AXES]).alias("to"))
    near = dealt_by_rows(pairs, rows, "iv").groupBy("iv").agg(F.collect_list("to").alias("near")).select(F.col("iv").alias("_at"), "near")
    start = F.struct("iv", *AXES)
    walk = skeleton_endpoints(skeleton).withColumn("path", F.array(start)).withColumn("on", F.lit(True))
    for _ in range(3):
        walk = dealt_by_rows(walk.withColumn("_last", F.element_at("path", -1)["iv"]), rows, "_last").join(near, F.col("_last") == F.col("_at"), "left")
        seen = F.transform("path", lambda p: p["iv"])
        fresh = F.filter(F.coalesce("near", F.array()), lambda t: ~F.array_contains(F.col("_seen"), t["iv"]))
        walk = walk.withColumn("_seen", seen).withColumn("_fresh", fresh).withColumn("on", F.col("on") & (F.size("_fresh") == 1))
        walk = walk.withColumn("path", F.when(F.col("on"), F.concat("path", "_fresh")).otherwise(F.col("path"))).drop("_last", "_at", "near", "_seen", "_fresh")
    last = F.element_at("path", -1)
    steps = {a: (F.col(a) - last[a]).cast("double") for a in AXES}
    norm = F.sqrt(sum((s * s for s in steps.values()), F.lit(0.0)))
    return walk.select("label", "iv", *AXES, *[F.coalesce(F.try_divide(steps[a], norm), F.lit(0.0)).alias(f"v{a}") for a in AXES])


def upsample_skeleton(skeleton_cells: DataFrame, representatives: DataFrame) -> DataFrame:
    """(label, up_iv) of skeleton cells (label, dz, dy, dx)."""
    return skeleton_cells.join(representatives, ["label", "dz", "dy", "dx"]).select("label", "up_iv")


def upsample_endpoints(points: DataFrame, voxels: DataFrame, label: str = "label", reach: int = 3, expansion: float = 1.5) -> DataFrame:
    """(label, iv, is_endpoint) of upsampled points: endpoints have fewer than 2 neighbours that A* reaches inside the label.

    Neighbours are points whose voxels are at most `reach` apart on each axis; a search goes from the smaller index to
    the larger.  It gives up where squared distances say more than `expansion` times the first estimate, so it stays
    within the root of expansion * 3 * reach^2 of its goal: a box sees that and `reach` around it, and no task has a label.
    """
    both = voxels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label"), "iv", *[F.col(a).cast("int").alias(a) for a in AXES])
    marked = both.join(points.select("label", F.col("up_iv").alias("iv")).distinct().withColumn("point", F.lit(True)), ["label", "iv"], "left")
    marked = marked.withColumn("point", F.col("point").isNotNull())
    around = int((expansion * 3 * reach * reach) ** 0.5) + reach

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        pdf = table.to_pandas().assign(own=inside).sort_values("iv")
        out = []
        for _, of in pdf.groupby("label", sort=False):
            at = of[of.point]
            if at.own.any():
                places = set(of[list(AXES)].itertuples(index=False, name=None))
                ends = kernels.lonely(places, list(at[list(AXES)].itertuples(index=False, name=None)), reach, expansion, at.own.to_numpy())
                out.append(at[["label", "iv"]].assign(is_endpoint=ends)[at.own])
        found = pd.concat(out) if out else pd.DataFrame({"label": np.zeros(0, np.int64), "iv": np.zeros(0, np.int64), "is_endpoint": np.zeros(0, bool)})
        return pa.Table.from_pandas(found, preserve_index=False)

    return in_boxes(marked, neighbors.BOX, (around, around, around), run, "label long, iv long, is_endpoint boolean", both.count())


def _per_label(voxels: DataFrame, label: str, run, schema: str) -> DataFrame:
    own = voxels.where(F.col(label) != 0).select(F.col(label).alias("label"), "iv", *AXES)
    return own.groupBy("label").applyInPandas(lambda pdf: run(pdf.sort_values("iv", ignore_index=True)), schema)


#: Voxels of a box that thins as one task, without its halo.
BOX = (64, 128, 256)


def _thinned(voxels: DataFrame, label: str, curve: bool) -> DataFrame:
    """(label, iv, is_endpoint) of what thinning leaves of each label, in rounds over boxes of the volume.

    A label may lie in any number of boxes: a round sees `kernels.REACH` around a voxel, which is the halo, so
    that boxes agree, and the result is that of one box for all.  What is left is written between rounds;
    the rounds end when one takes nothing out.
    """
    state = voxels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label"), "iv", *[F.col(a).cast("int").alias(a) for a in AXES], F.lit(False).alias("frozen"))
    schema = state.schema

    def run(table: pa.Table, inside: np.ndarray) -> pa.Table:
        box = kernels.Box(np.stack([table.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64), table.column("label").to_numpy())
        frozen = np.array(table.column("frozen").to_numpy(zero_copy_only=False)) if curve else None
        kernels.thin_round(box, frozen)
        out = table.set_column(table.schema.get_field_index("frozen"), "frozen", pa.array(frozen)) if curve else table
        return out.filter(pa.array(inside & box.live()))

    state = tables.written(state, "thinning")
    left = state.count()
    while left:
        after = tables.written(in_boxes(state, BOX, kernels.REACH, run, schema, left), "thinning")
        now = after.count()
        tables.discard(state)
        state = after
        if now == left:
            break
        left = now
    return neighbour_mask(state.drop("frozen")).select("label", "iv", (F.col("n") <= 1).alias("is_endpoint"))


def thinning(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, iv, is_endpoint) of each label's curve skeleton by topological thinning that keeps isthmuses."""
    return _thinned(voxels, label, True)


def medial_axis(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, iv, is_endpoint) of each label's medial axis: directional thinning that keeps line ends."""
    return _thinned(voxels, label, False)


def skeleton_pairs(skeleton: DataFrame) -> DataFrame:
    """(label, iv, n_iv): points of a skeleton that touch, each pair once, the smaller index first."""
    pairs = neighbour_pairs(skeleton, OFFSETS_26[13:], ["iv", "label"], ["label"])
    return pairs.select("label", F.least("iv", "n_iv").alias("iv"), F.greatest("iv", "n_iv").alias("n_iv"))


def teaser(voxels: DataFrame, label: str = "label", scale: float = 1.3, buffer: float = 2.0) -> DataFrame:
    """(label, iv, is_endpoint) of each label's TEASER skeleton, component by component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf[list(AXES)].to_numpy()
        part = kernels.parts_of(points)
        stays = np.zeros(len(points), dtype=bool)
        for p in np.unique(part):
            stays[part == p] = kernels.teaser(points[part == p], scale, buffer)
        left = pdf[stays]
        return pd.DataFrame({"label": left.label, "iv": left.iv, "is_endpoint": kernels.few_neighbours(points[stays])})

    return _per_label(voxels, label, run, "label long, iv long, is_endpoint boolean")


def _lengths(voxels: DataFrame) -> dict[str, int]:
    """Places on each axis of the box that holds all voxels."""
    ends = voxels.agg(*[f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    return {a: (ends[f"high{a}"] or 0) - (ends[f"low{a}"] or 0) + 1 for a in AXES}


def dbf_3d(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, iv, dbf): distance-from-boundary field of each label; a boundary voxel has 1.

    Voxels with a face to another label or to nothing have squared value 1, others the least squared distance to one of these
    plus 1.  That is a lower envelope of parabolas along x, y and z in turn.  Between a voxel and its nearest boundary voxel all
    places are of the label (the ball that touches the boundary there holds nothing else), so each axis has only to look
    along runs of a label's voxels.  A task has a bundle of lines, never a label.
    """
    own = voxels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label"), "iv", *[F.col(a).cast("int").alias(a) for a in AXES])
    lengths = _lengths(own)
    columns = [*own.columns, "square"]

    def edges(table: pa.Table, inside: np.ndarray) -> pa.Table:
        box = kernels.Box(np.stack([table.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64), table.column("label").to_numpy())
        faces = box.masks(np.flatnonzero(inside)) & kernels.BITS_6
        return table.filter(pa.array(inside)).append_column("square", pa.array(np.where(faces == kernels.BITS_6, kernels.FAR, 1)))

    def pass_along(axis: str):
        others = [a for a in AXES if a != axis]

        def run(table: pa.Table) -> pa.Table:
            keys = [table.column(c).to_numpy() for c in (axis, *others, "label")]
            order = np.lexsort(keys)
            sorted_ = [k[order] for k in keys]
            ends = np.zeros(len(order), bool)
            ends[1:] = sorted_[0][1:] != sorted_[0][:-1] + 1
            for k in sorted_[1:]:
                ends[1:] |= k[1:] != k[:-1]
            found = np.empty(len(order), np.int64)
            found[order] = kernels.envelopes_of_runs(np.cumsum(ends), table.column("square").to_numpy()[order])
            return table.set_column(columns.index("square"), "square", pa.array(found))

        return run

    schema = ", ".join(f"{c} {t}" for c, t in own.dtypes) + ", square long"
    field = in_boxes(own, BOX, (1, 1, 1), edges, schema)
    for axis in reversed(AXES):
        field = along_lines(field, axis, lengths[axis], pass_along(axis), schema)
    return field.select("label", "iv", F.round(F.sqrt(F.col("square").cast("double")), 6).alias("dbf"))


def pdrf_penalty(field: DataFrame) -> DataFrame:
    """(label, iv, penalty): 5000 * (1 - dbf / max dbf of the label)^16."""
    most = field.groupBy("label").agg(F.max("dbf").alias("_m"))
    return field.join(most, "label").select("label", "iv", F.round(5000.0 * F.pow(1.0 - F.col("dbf") / F.col("_m"), F.lit(16.0)), 6).alias("penalty"))


def distance_transform_2d(voxels: DataFrame, geometry: Geometry, label: str = "label") -> DataFrame:
    """(iv, distance) inside each plane to the nearest boundary voxel; null where a plane has no boundary.

    One shuffle finds the boundary, one looks along x and one along y, on bundles of whole lines; places without a voxel
    pass distances on like all others.
    """
    own = voxels.select("iv", *[F.col(a).cast("int").alias(a) for a in AXES], label)
    schema = "iv long, z int, y int, x int, square long"

    def edges(table: pa.Table, inside: np.ndarray) -> pa.Table:
        square = np.where(plane_edges(table, label), 0, kernels.FAR)
        return table.select(["iv", *AXES]).append_column("square", pa.array(square)).filter(pa.array(inside))

    def pass_along(axis: str, other: str, length: int):
        def run(table: pa.Table) -> pa.Table:
            z, at, line = (table.column(c).to_numpy() for c in ("z", axis, other))
            lines, row = np.unique(np.stack([z, line], axis=1), axis=0, return_inverse=True)
            row = row.reshape(-1)
            costs = np.full((len(lines), length), kernels.FAR, np.int64)
            costs[row, at] = table.column("square").to_numpy()
            ivs, known = np.zeros(costs.shape, np.int64), np.zeros(costs.shape, bool)
            there = table.column("iv").is_valid().to_numpy()
            ivs[row[there], at[there]], known[row[there], at[there]] = table.column("iv").drop_null().to_numpy(), True
            found = kernels.envelopes(costs)
            r, p = np.nonzero(known | (found < kernels.FAR))
            out = {"z": lines[r, 0], axis: p, other: lines[r, 1]}
            return pa.table({"iv": pa.array(ivs[r, p], mask=~known[r, p]), **{a: pa.array(out[a].astype(np.int32)) for a in AXES}, "square": pa.array(found[r, p])})

        return run

    field = in_boxes(own, neighbors.BOX, (0, 1, 1), edges, schema)
    field = along_lines(field, "x", geometry.nx, pass_along("x", "y", geometry.nx), schema)
    field = along_lines(field, "y", geometry.ny, pass_along("y", "x", geometry.ny), schema)
    near = F.when(F.col("square") < kernels.FAR, F.round(F.sqrt(F.col("square").cast("double")), 6))
    return field.where("iv is not null").select("iv", near.alias("distance"))


def endpoint_matching(truth: DataFrame, proposed: DataFrame, geometry: Geometry, radius: int = 800) -> DataFrame:
    """(label, truth_iv, proposed_iv, distance): optimal one-to-one matches by distance; those beyond `radius` nm are then dropped."""
    rows = truth.select("label", "iv", *AXES, F.lit(True).alias("own")).unionByName(proposed.select("label", "iv", *AXES, F.lit(False).alias("own")))
    resolution = np.array(geometry.resolution, dtype=float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("iv")
        a, b = pdf[pdf.own], pdf[~pdf.own]
        out = []
        if len(a) and len(b):
            gap = (a[list(AXES)].to_numpy()[:, None] - b[list(AXES)].to_numpy()[None]) * resolution
            cost = np.sqrt((gap**2).sum(axis=2))
            out = [(int(a.label.iloc[0]), int(a.iv.iloc[i]), int(b.iv.iloc[j]), float(cost[i, j])) for i, j in kernels.assignment(cost) if cost[i, j] <= radius]
        return pd.DataFrame(out, columns=["label", "truth_iv", "proposed_iv", "distance"])

    return rows.groupBy("label").applyInPandas(run, "label long, truth_iv long, proposed_iv long, distance double")


def endpoint_scores(matches: DataFrame, truth: DataFrame, proposed: DataFrame) -> DataFrame:
    """tp, fp and fn over labels that have ground truth, and the F-score (null without any endpoint)."""
    known = truth.select("label").distinct()
    sizes = [matches.agg(F.count("*").alias("tp")), truth.agg(F.count("*").alias("_t")), proposed.join(known, "label", "left_semi").agg(F.count("*").alias("_p"))]
    one = sizes[0].crossJoin(F.broadcast(sizes[1])).crossJoin(F.broadcast(sizes[2]))  # one row each
    one = one.select("tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"))
    return one.withColumn("fscore", F.round(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), 6))
