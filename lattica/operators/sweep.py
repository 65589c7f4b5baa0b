"""The endpoint benchmark as one plan: all resolutions, methods and parameters against human endpoints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.geometry import Geometry
from lattica.operators import kernels
from lattica.operators.neighbors import AXES

RESOLUTIONS = tuple(range(30, 210, 10))
EXPANSIONS = (0, 11, 13, 15, 17, 19, 21, 23, 25)
SCALES, BUFFERS = (7, 9, 11, 13, 15, 17), (1, 2, 3, 4, 5)


def configurations(resolutions=RESOLUTIONS, expansions=EXPANSIONS, scales=SCALES, buffers=BUFFERS) -> list[str]:
    """Names of all configurations: thinning and medial-axis by A* expansion, TEASER by scale and buffer (tenths)."""
    curves = [f"{m}-{e:02d}" for m in ("thinning", "medial-axis") for e in expansions]
    return [f"{r:03d}-{m}" for r in resolutions for m in [*curves, *(f"teaser-{s:02d}-{b:02d}" for s in scales for b in buffers)]]


def cells_of(voxels: DataFrame, geometry: Geometry, resolutions=RESOLUTIONS, label: str = "label") -> DataFrame:
    """(resolution, label, dz, dy, dx, up_iv, z, y, x): each label's cells at each resolution with their voxel nearest to the centre."""
    own = voxels.where(F.col(label) != 0).select(F.col(label).alias("label"), "iv", *AXES, F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"))
    gaps = []
    for a, r, n in zip(AXES, geometry.resolution, (geometry.nz, geometry.ny, geometry.nx), strict=True):
        own = own.withColumn(f"d{a}", F.floor(F.col(a) * r / F.col("resolution")).cast("long"))
        low, high = F.ceil(F.col(f"d{a}") * F.col("resolution") / r), F.least(F.ceil((F.col(f"d{a}") + 1) * F.col("resolution") / r), F.lit(n))
        gaps.append(F.abs(F.col(a) - F.floor((low + high) / 2)))
    best = F.min(F.struct(sum(gaps[1:], gaps[0]).alias("gap"), "iv", *AXES)).alias("b")
    return own.groupBy("resolution", "label", "dz", "dy", "dx").agg(best).select("resolution", "label", "dz", "dy", "dx", F.col("b.iv").alias("up_iv"), *[F.col(f"b.{a}").alias(a) for a in AXES])


#: Voxels of the labels that one task takes together.
TOGETHER = 1 << 15


def _dealt(df: DataFrame, bundles: int) -> DataFrame:
    return df.withColumn("bundle", F.pmod(F.xxhash64("label"), F.lit(bundles)))


def _of_each(*labels: np.ndarray):
    """(label, rows of it in each array) of labels that any of the arrays has; rows of a label stay in order."""
    orders = [np.argsort(x, kind="stable") for x in labels]
    ordered = [x[o] for x, o in zip(labels, orders, strict=True)]
    names = np.unique(np.concatenate(labels))
    ends = [(np.searchsorted(x, names), np.searchsorted(x, names, "right")) for x in ordered]
    for i, name in enumerate(names.tolist()):
        yield name, *(o[first[i] : last[i]] for o, (first, last) in zip(orders, ends, strict=True))


def _ends(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """`kernels.few_neighbours` of each label."""
    return np.bitwise_count(kernels.Box(points, labels).masks(np.arange(len(points)))) <= 1 if len(points) else np.zeros(0, bool)


def proposed_endpoints(voxels: DataFrame, geometry: Geometry, resolutions=RESOLUTIONS, expansions=EXPANSIONS, scales=SCALES, buffers=BUFFERS, label: str = "label", bundles: int | None = None) -> DataFrame:
    """(config, label, iv, z, y, x): endpoints that each configuration proposes.

    A task has a bundle of labels at one resolution: about TOGETHER voxels, or one label that has more.  Thinning takes all labels of
    a bundle at once.  Skeletons are made once for all expansions; expansion 0 keeps the ends of the coarse skeleton, others
    (in tenths) tell ends by paths inside of the label's voxels.
    """
    own = voxels.where(F.col(label) != 0)
    bundles = bundles or 1 + own.count() // TOGETHER
    cells = _dealt(cells_of(voxels, geometry, resolutions, label), bundles)
    inside = _dealt(own.select(F.col(label).alias("label"), *AXES, F.explode(F.array(*map(F.lit, resolutions))).alias("resolution")), bundles)

    def run(key, cell: pd.DataFrame, voxel: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["label", "dz", "dy", "dx"], ignore_index=True)
        points, labels, up = cell[["dz", "dy", "dx"]].to_numpy(), cell.label.to_numpy(), cell.up_iv.to_numpy()
        places, voxels_at, voxel_labels = cell[list(AXES)].to_numpy(), voxel[list(AXES)].to_numpy(), voxel.label.to_numpy()
        ends: dict[str, list] = {}

        def put(name: str, rows: np.ndarray):
            ends.setdefault(name, []).append(rows)

        if len(points):
            for method, kernel in (("thinning", kernels.thin), ("medial-axis", kernels.medial)):
                stays = np.flatnonzero(kernel(points, labels))
                stays = stays[np.lexsort((up[stays], labels[stays]))]  # searches go from the smaller index
                if 0 in expansions:
                    put(f"{method}-00", stays[_ends(points[stays], labels[stays])])
                if any(expansions):
                    for _, at, of in _of_each(labels[stays], voxel_labels):
                        rows = stays[at]
                        within, goals = set(map(tuple, voxels_at[of].tolist())), list(map(tuple, places[rows].tolist()))
                        for e in filter(None, expansions):
                            put(f"{method}-{e:02d}", rows[kernels.lonely(within, goals, expansion=e / 10)])
            skeletons = {(s, b): np.zeros(len(points), bool) for s in scales for b in buffers}
            for _, rows in _of_each(labels):
                part = kernels.parts_of(points[rows])
                for p in np.unique(part):
                    for (s, b), stays in skeletons.items():
                        stays[rows[part == p]] = kernels.teaser(points[rows[part == p]], s / 10, float(b))
            for (s, b), stays in skeletons.items():
                rows = np.flatnonzero(stays)
                put(f"teaser-{s:02d}-{b:02d}", rows[_ends(points[rows], labels[rows])])
        names = ["config", "label", "iv", *AXES]
        out = [cell.loc[np.concatenate(rows), ["label", "up_iv", *AXES]].drop_duplicates().rename(columns={"up_iv": "iv"}).assign(config=f"{int(key[0]):03d}-{name}") for name, rows in ends.items()]
        return pd.concat(out)[names] if out else pd.DataFrame({n: [] for n in names})

    pairs = cells.groupBy("resolution", "bundle").cogroup(inside.groupBy("resolution", "bundle"))
    return pairs.applyInPandas(run, "config string, label long, iv long, z long, y long, x long")


def endpoint_sweep(voxels: DataFrame, truth: DataFrame, geometry: Geometry, resolutions=RESOLUTIONS, expansions=EXPANSIONS, scales=SCALES, buffers=BUFFERS, radius: int = 800,
                   label: str = "label") -> DataFrame:
    """(config, tp, fp, fn, precision, recall, fscore) of every configuration, over labels that `truth` has endpoints of.

    Matches are optimal one to one; those beyond `radius` nm are then dropped.
    """
    names = configurations(resolutions, expansions, scales, buffers)
    known = truth.select("label", *AXES)
    mine = voxels.join(known.select("label").distinct().withColumnRenamed("label", "_l"), F.col(label) == F.col("_l"), "left_semi")
    bundles = 1 + mine.where(F.col(label) != 0).count() // TOGETHER
    asked = _dealt(known.withColumn("config", F.explode(F.array(*map(F.lit, names)))), bundles)
    found = _dealt(proposed_endpoints(mine, geometry, resolutions, expansions, scales, buffers, label, bundles), bundles)
    steps = np.array(geometry.resolution, dtype=float)

    def match(key, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b, hits = own[list(AXES)].to_numpy(), other[list(AXES)].to_numpy(), 0
        for _, i, j in _of_each(own.label.to_numpy(), other.label.to_numpy()):
            if len(i) and len(j):
                cost = np.sqrt((((a[i][:, None] - b[j][None]) * steps) ** 2).sum(axis=2))
                hits += sum(cost[x, y] <= radius for x, y in kernels.assignment(cost))
        return pd.DataFrame({"config": [key[0]], "tp": [hits], "fp": [len(other) - hits], "fn": [len(own) - hits]})

    counts = asked.groupBy("config", "bundle").cogroup(found.groupBy("config", "bundle")).applyInPandas(match, "config string, tp long, fp long, fn long")
    sums = counts.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.select("config", "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("fscore"))


def best_configuration(scores: DataFrame) -> DataFrame:
    """The configuration of the highest F-score, the first by name on ties."""
    return scores.orderBy(F.desc_nulls_last("fscore"), "config").limit(1)


def reported(scores: DataFrame, precision: float = 0.8, recall: float = 0.9) -> DataFrame:
    """Configurations above both bars."""
    return scores.where((F.col("precision") > precision) & (F.col("recall") > recall))
