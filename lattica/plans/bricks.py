"""Voxels dealt to bricks of the grid, with a halo, so that neighbours meet in one shuffle of the voxels.

A brick is a box of BRICK voxels; each voxel goes to its own brick and, where it lies at a face, to the bricks
that have it as a neighbour (3 % to 15 % more rows).  A brick is looked at with numpy through an array of its
places, and what it counts is summed before it shuffles again.  Coordinates are unique in a volume.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

AXES = ("z", "y", "x")
BRICK = (32, 64, 64)
FORWARD = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
KEYS = [f"_b{a}" for a in AXES]
#: Rows of bricks or boxes that one task sorts, about 50 MB of them; a single brick or box may have more.
TOGETHER = 1 << 18


def dealt(voxels: DataFrame, below: bool) -> DataFrame:
    """`voxels` with its brick (_bz, _by, _bx) and _halo: copies for the bricks before it at each axis, and with
    `below` for all bricks around."""
    # Arrays of places with nulls, exploded and then filtered: generated code throughout, which a lambda over the array is not.
    cells = []
    for a, size in zip(AXES, BRICK, strict=True):
        own = F.floor(F.col(a) / size).cast("int")
        at = F.col(a) - own * size
        sides = [F.struct(own.alias("b"), F.lit(False).alias("h")), F.when(at == 0, F.struct((own - 1).alias("b"), F.lit(True).alias("h")))]
        if below:
            sides.append(F.when(at == size - 1, F.struct((own + 1).alias("b"), F.lit(True).alias("h"))))
        cells.append(sides)
    if below:
        out = voxels
        for a, sides in zip(AXES, cells, strict=True):
            out = out.withColumn(f"_c{a}", F.explode(F.array(*sides))).where(F.col(f"_c{a}").isNotNull())
        own = [F.col(f"_c{a}.b").alias(k) for a, k in zip(AXES, KEYS, strict=True)]
        return out.select(*voxels.columns, *own, (F.col("_cz.h") | F.col("_cy.h") | F.col("_cx.h")).alias("_halo"))
    # Faces only: one axis at a time is in the halo.
    own = [F.floor(F.col(a) / size).cast("int") for a, size in zip(AXES, BRICK, strict=True)]
    places = [F.struct(*[o.alias(k) for o, k in zip(own, KEYS, strict=True)], F.lit(False).alias("_halo"))]
    for i, (a, size) in enumerate(zip(AXES, BRICK, strict=True)):
        moved = [x - 1 if j == i else x for j, x in enumerate(own)]
        places.append(F.when(F.col(a) - own[i] * size == 0, F.struct(*[o.alias(k) for o, k in zip(moved, KEYS, strict=True)], F.lit(True).alias("_halo"))))
    exploded = voxels.select(*voxels.columns, F.explode(F.array(*places)).alias("_p")).where("_p is not null")
    return exploded.select(*voxels.columns, *[f"_p.{k}" for k in KEYS], "_p._halo")


class Places:
    """Which row stands at each place of a brick and its halo."""

    def __init__(self, table: pa.Table, brick: tuple[int, int, int]):
        self.halo = table.column("_halo").to_numpy()
        # One more place on both sides of the halo, so that no offset leads around to another row of the box.
        shape = [s + 4 for s in brick]
        at = [table.column(a).to_numpy() - table.column(k)[0].as_py() * size + 2 for a, k, size in zip(AXES, KEYS, brick, strict=True)]
        self.strides = (shape[1] * shape[2], shape[2], 1)
        self.index = sum(x * s for x, s in zip(at, self.strides, strict=True))
        self.rows = np.full(int(np.prod(shape)), -1, np.int32)
        self.rows[self.index] = np.arange(len(self.index), dtype=np.int32)

    def pairs(self, offset: tuple[int, int, int], halo: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a neighbour at `offset` and these; of rows in the halo only with `halo`."""
        own = np.arange(len(self.index)) if halo else np.flatnonzero(~self.halo)
        other = self.rows[self.index[own] + sum(d * s for d, s in zip(offset, self.strides, strict=True))]
        return own[other >= 0], other[other >= 0]


def _met(placed: DataFrame, rows: int, run: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """`run` on each brick or box of `placed`, which has about `rows` rows.

    Places compress well, so tasks put together by shuffled bytes would have 20 times these to sort.  Their number follows
    the rows instead.
    """
    ways = max(placed.sparkSession.sparkContext.defaultParallelism, -(-rows // TOGETHER))
    return placed.repartition(ways, *KEYS).groupBy(*KEYS).applyInArrow(run, schema)


def per_brick(voxels: DataFrame, run: Callable[[pa.Table], pa.Table], schema: T.StructType | str, below: bool = False) -> DataFrame:
    """`run(table)` for each brick; `voxels` are counted."""
    return _met(dealt(voxels, below), voxels.count(), run, schema)


def _faces(table: pa.Table, label: str, brick: tuple[int, int, int]):
    """(rows, neighbours, place of the axis) of all faces between different labels."""
    places, labels = Places(table, brick), table.column(label).to_numpy()
    found = []
    for k, offset in enumerate(FORWARD):
        own, other = places.pairs(offset, False)
        differ = labels[own] != labels[other]
        found.append((own[differ], other[differ], np.full(int(differ.sum()), k)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def face_rows(voxels: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """`columns` of the lower voxel, n_<column> of the upper one, and axis, for each face between different labels."""
    own = voxels.select(*dict.fromkeys([*columns, *AXES, label]))
    schema = T.StructType([*(T.StructField(c, own.schema[c].dataType) for c in columns), *(T.StructField(f"n_{c}", own.schema[c].dataType) for c in columns), T.StructField("axis", T.StringType())])

    brick = BRICK

    def run(table: pa.Table) -> pa.Table:
        a, b, k = _faces(table, label, brick)
        values = [table.column(c).take(pa.array(a)) for c in columns] + [table.column(c).take(pa.array(b)) for c in columns]
        return pa.table([*values, pa.array(np.array(AXES)[k], pa.string())], names=schema.names)

    return per_brick(own, run, schema)


def face_sums(voxels: DataFrame, label: str, channels: list[str] | None = None) -> DataFrame:
    """(label_one, label_two, n, sz, sy, sx, total) of each pair of touching labels.

    Sums of the doubled midpoints of their faces, and of the lower voxel's channel of the face's axis (`channels`
    by z, y and x).  A brick sums its own faces, so that a row for each pair and brick is shuffled.
    """
    own = voxels.select(*dict.fromkeys([*AXES, label, *(channels or [])]))
    names = ["label_one", "label_two", "n", "sz", "sy", "sx", "total"]

    brick = BRICK

    def run(table: pa.Table) -> pa.Table:
        a, b, k = _faces(table, label, brick)
        labels = table.column(label).to_numpy()
        one, two = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        order = np.lexsort((two, one))
        one, two, a, k = one[order], two[order], a[order], k[order]
        first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)])
        sums = [np.ones(len(a), np.int64), *(2 * table.column(c).to_numpy()[a] + (k == i) for i, c in enumerate(AXES))]
        sums.append(np.choose(k, [table.column(c).to_numpy()[a] for c in channels]) if channels else np.zeros(len(a), np.int64))
        added = [np.add.reduceat(x.astype(np.int64), first) if len(a) else np.zeros(0, np.int64) for x in sums]
        return pa.table([pa.array(x.astype(np.int64)) for x in (one[first], two[first], *added)], names=names)

    found = per_brick(own, run, ", ".join(f"{c} long" for c in names))
    return found.groupBy("label_one", "label_two").agg(*[F.sum(c).alias(c) for c in names[2:]])


def local_components(voxels: DataFrame, label: str, name: str = "iv") -> DataFrame:
    """`voxels` (labels other than 0) with _root, _halo and _near: 26-connected components inside of each brick.

    _root is the least `name` of the component in the brick and its halo.  Rows of the halo are copies; with the
    rows that are _near a face they link the bricks' components: two that have a voxel in common are one.
    """
    from lattica.plans.components import least_labels

    own = voxels.where(F.col(label) != 0)
    schema = T.StructType([*own.schema.fields, T.StructField("_root", T.LongType()), T.StructField("_halo", T.BooleanType()), T.StructField("_near", T.BooleanType())])
    half = [(dz, dy, dx) for dz in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) > (0, 0, 0)]
    kinds, brick = to_arrow_schema(schema), BRICK

    def run(table: pa.Table) -> pa.Table:
        places, labels, names = Places(table, brick), table.column(label).to_numpy(), table.column(name).to_numpy()
        found = []
        for offset in half:
            a, b = places.pairs(offset, True)
            same = labels[a] == labels[b]
            found.append((a[same], b[same]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        v, root = least_labels(names[a], names[b])
        roots = names.copy()
        if len(v):
            at = np.minimum(np.searchsorted(v, names), len(v) - 1)
            hit = v[at] == names
            roots[hit] = root[at[hit]]
        near = np.zeros(len(names), bool)
        for c, k, size in zip(AXES, KEYS, brick, strict=True):
            at = table.column(c).to_numpy() - table.column(k)[0].as_py() * size
            near |= (at <= 0) | (at >= size - 1)
        out = table.drop_columns([*KEYS, "_halo"]).append_column("_root", pa.array(roots)).append_column("_halo", table.column("_halo")).append_column("_near", pa.array(near))
        return out.select(schema.names).cast(kinds)

    return per_brick(own, run, schema, below=True)


def in_boxes(voxels: DataFrame, box: tuple[int, int, int], halo: tuple[int, int, int], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str, rows: int | None = None) -> DataFrame:
    """`run(table, inside)` for each box of `box` voxels with all voxels that are at most `halo` away on each axis.

    `inside` marks rows that lie in the box itself; others are copies.  A halo may be wider than a box.  Only
    columns of `voxels` are in the table.  Boxes that have nothing but copies are left out.  `voxels` are counted
    where `rows`, their number or a bound of it, isn't given.
    """
    names, nothing = voxels.columns, to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    out, copies = voxels, 1.0
    for a, size, wide, key in zip(AXES, box, halo, KEYS, strict=True):
        copies *= 1 + 2 * wide / size
        first, last = F.floor((F.col(a) - wide) / size).cast("int"), F.floor((F.col(a) + wide) / size).cast("int")
        out = out.withColumn(key, F.explode(F.sequence(first, last)) if wide else first)

    def whole(table: pa.Table) -> pa.Table:
        inside = np.ones(table.num_rows, bool)
        for a, k, size in zip(AXES, KEYS, box, strict=True):
            inside &= table.column(a).to_numpy() // size == table.column(k)[0].as_py()
        return run(table.select(names), inside) if inside.any() else nothing.empty_table()

    return _met(out, math.ceil((voxels.count() if rows is None else rows) * copies), whole, schema)


def own_box(box: tuple[int, int, int]) -> list:
    """Columns of the box that a voxel lies in."""
    return [F.floor(F.col(a) / size).cast("int").alias(k) for a, size, k in zip(AXES, box, KEYS, strict=True)]


#: Voxels of the lines that one task has at once.
LINES = 1 << 21


def along_lines(voxels: DataFrame, axis: str, length: int, run: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """`run(table)` on bundles of whole lines along an axis of `length` places; a table has LINES voxels or one line."""
    side = max(1, int((LINES // max(1, length)) ** 0.5))
    others = [a for a in AXES if a != axis]
    keyed, names = voxels.select("*", *[F.floor(F.col(a) / side).cast("int").alias(f"_b{a}") for a in others]), voxels.columns
    return keyed.groupBy(*[f"_b{a}" for a in others]).applyInArrow(lambda table: run(table.select(names)), schema)
