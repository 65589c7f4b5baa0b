"""Graph operators on scored edges and label volumes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import kernels
from lattica.operators.paths import lifted_edges  # noqa: F401  one of the graph's operators
from lattica.operators.voxel import map_labels
from lattica.plans import tables
from lattica.plans.bricks import AXES, KEYS, local_components, own_box
from lattica.plans.components import connected_components
from lattica.plans.joins import join_counted

def union_edges(edges: DataFrame, keep, one: str = "v1", two: str = "v2") -> DataFrame:
    """(label, mapped): each vertex and the smallest one that it reaches over kept edges."""
    own = edges.select(F.col(one).alias("a"), F.col(two).alias("b"), keep.alias("k"))
    merged = own.where("k").select("a", "b")
    alone = own.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"))
    return connected_components(merged.unionByName(alone)).select(F.col("v").alias("label"), F.col("root").alias("mapped"))


def graph_baseline(edges: DataFrame, beta: float = 0.95) -> DataFrame:
    """Edges of p >= beta merge."""
    return union_edges(edges, F.col("p") >= beta)


def agglomerate(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges of p > threshold merge."""
    return union_edges(edges, F.col("p") > threshold)


def merge_ground_truth(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges whose ends have the same gold id other than 0 merge (so ends that are both -1 merge)."""
    a = mapping.select(F.col("label").alias("v1"), F.col("gold").alias("_a"))
    b = mapping.select(F.col("label").alias("v2"), F.col("gold").alias("_b"))
    joined = edges.join(a, "v1", "left").join(b, "v2", "left")
    return union_edges(joined, F.coalesce((F.col("_a") == F.col("_b")) & (F.col("_a") != 0), F.lit(False)))


def collapse_graph(voxels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """The volume with each label replaced by its root."""
    return map_labels(voxels, mapping, label)


def _with_components(voxels: DataFrame, label: str) -> DataFrame:
    """Voxels of labels other than 0, all columns, with _component: the first voxel of their 26-connected component.

    Components are found inside of bricks; only voxels at the bricks' faces are links of the graph over bricks.
    """
    local = tables.written(local_components(voxels, label), "components")
    links = local.where("_halo or _near").select(F.col("iv").alias("a"), F.col("_root").alias("b"))
    found = connected_components(links).select(F.col("v").alias("_root"), F.col("root").alias("_first"))
    own = local.where("not _halo").drop("_halo", "_near")
    # One component may hold a good part of all voxels.
    sizes = own.groupBy("_root").agg(F.count("*").alias("_n")).join(found, "_root", "left").select("_root", "_n", F.coalesce("_first", "_root").alias("_component"))
    sizes = tables.written(sizes, "components")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    return join_counted(own, sizes, ["_root"], "_n", total).drop("_root", "_n")


def voxel_components(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(iv, label, component): 26-connected components of equal labels other than 0, named by their first voxel."""
    own = _with_components(voxels.select("iv", "z", "y", "x", label), label)
    return own.select("iv", F.col(label).alias("label"), F.col("_component").alias("component"))


def components_per_label(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxel_components(voxels, label).select("label", "component").distinct().groupBy("label").agg(F.count("*").alias("n_components"))


def force_connectivity(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Each label keeps its first component; others get new labels from max + 1 by label and first voxel; 0 stays.

    Numbers are a rank inside the label plus the number of extra components of smaller labels.
    """
    own = _with_components(voxels, label)
    parts = tables.written(own.groupBy(F.col(label).alias("label"), F.col("_component").alias("component")).agg(F.count("*").alias("_n")), "parts")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("component")) - 1
    ranked = parts.withColumn("rank", rank)
    extra = ranked.groupBy("label").agg((F.count("*") - 1).alias("extra")).withColumn("_range", F.floor(F.col("label") / 1_000_000))
    inside = F.sum("extra").over(Window.partitionBy("_range").orderBy("label")) - F.col("extra")
    ranges = extra.groupBy("_range").agg(F.sum("extra").alias("_n"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    offsets = extra.withColumn("_in", inside).join(ranges, "_range").select("label", (F.col("_in") + F.col("_o")).alias("offset"))
    top = voxels.agg(F.max(label).alias("top"))
    names = ranked.join(offsets, "label").crossJoin(F.broadcast(top))  # one row
    names = names.select(F.col("component").alias("_component"), F.col("_n"), F.when(F.col("rank") == 0, F.col("label")).otherwise(F.col("top") + F.col("offset") + F.col("rank")).alias("_new"))
    names = tables.written(names, "parts")
    total = names.agg(F.sum("_n")).first()[0] or 0
    renamed = join_counted(own, names, ["_component"], "_n", total).withColumn(label, F.col("_new").cast(voxels.schema[label].dataType))
    return renamed.select(*voxels.columns).unionByName(voxels.where(F.col(label) == 0))


#: Voxels of a box whose distances one task settles.
BOX = (32, 64, 64)


def voxel_geodesic(voxels: DataFrame, label: str = "label", penalty: str | None = None) -> DataFrame:
    """(label, iv, distance) from each label's first voxel through its 26-neighbours; null where it isn't reached.

    A step costs its length plus the penalty of the voxel that is entered.  Distances are settled inside of boxes;
    what became nearer at a box's faces goes to the boxes around, and only boxes that get something are settled again,
    until none does.  So rounds grow with the boxes on a shortest path, and a label may lie in any number of boxes.
    """
    own = voxels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label"), "iv", *[F.col(a).cast("int").alias(a) for a in AXES],
                                                 (F.col(penalty).cast("double") if penalty else F.lit(0.0)).alias("penalty"))
    own = tables.written(own.select("*", *own_box(BOX)), "geodesic")
    firsts = own.groupBy("label").agg(F.min(F.struct("iv", *AXES)).alias("f")).select("label", "f.*", F.lit(0.0).alias("distance"))
    fresh = tables.written(firsts, "nearer")
    found, names = [fresh], ["label", "iv", *AXES, "distance"]

    def run(key, rows: pa.Table, brought: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        both = {c: np.concatenate([column(rows, c), column(brought, c)]) for c in ("label", *AXES)}
        n = rows.num_rows
        old = pc.fill_null(rows.column("distance"), np.inf).to_numpy()
        points = np.stack([both[a] for a in AXES], axis=1).astype(np.int64)
        cost = np.concatenate([column(rows, "penalty"), np.full(brought.num_rows, np.inf)])  # copies are not entered
        new = kernels.settle(points, both["label"], cost, np.concatenate([old, column(brought, "distance")]), np.arange(n, len(points)))[:n]
        nearer = np.flatnonzero(new < old)
        return pa.table({**{c: rows.column(c).take(pa.array(nearer)) for c in names[:-1]}, "distance": pa.array(new[nearer])})

    while not fresh.isEmpty():
        # a box gets the nearer voxels around it, and at first its own sources
        brought = fresh
        for a, size, k in zip(AXES, BOX, KEYS, strict=True):
            brought = brought.withColumn(k, F.explode(F.array_distinct(F.array(*(F.floor((F.col(a) + d) / size).cast("int") for d in (-1, 0, 1))))))
        if len(found) > 1:
            own_z, own_y, own_x = (F.col(k) == F.floor(F.col(a) / size) for a, size, k in zip(AXES, BOX, KEYS, strict=True))
            brought = brought.where(~(own_z & own_y & own_x))
        brought = tables.written(brought, "brought")
        active = brought.select(*KEYS).distinct()
        known = reduce(DataFrame.unionByName, found).select("iv", "distance", *own_box(BOX)).join(active, KEYS, "left_semi").groupBy("iv").agg(F.min("distance").alias("distance"))
        rows = own.join(active, KEYS, "left_semi").join(known, "iv", "left").select(*own.columns, "distance")
        others = brought.select(*names, *[F.col(k).alias(f"{k}_") for k in KEYS])
        settled = rows.groupBy(*KEYS).cogroup(others.groupBy(*[f"{k}_" for k in KEYS])).applyInArrow(run, "label long, iv long, z int, y int, x int, distance double")
        fresh = tables.written(settled, "nearer")
        tables.discard(brought)
        found.append(fresh)
    known = reduce(DataFrame.unionByName, found).groupBy("iv").agg(F.min("distance").alias("distance"))
    return own.join(known, "iv", "left").select("label", "iv", "distance")
