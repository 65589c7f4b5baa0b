"""Surfaces of labels as triangles, and images: STL, PNG and GIF."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.kernels import grid_of
from lattica.operators.neighbors import AXES
from lattica.plans import tables
from lattica.plans.joins import join_counted


def tetrahedra() -> list[tuple[tuple[int, int, int], ...]]:
    """The six tetrahedra of a cube around its diagonal: one for each order of the three axes."""
    out = []
    for order in itertools.permutations(range(3)):
        corner, path = [0, 0, 0], [(0, 0, 0)]
        for axis in order:
            corner[axis] = 1
            path.append(tuple(corner))
        out.append(tuple(path))
    return out


def isosurface(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n x 3 x 3, in half voxels) around a set of voxels by marching tetrahedra at the half level, and the lowest corner of the cube of each.

    A tetrahedron with one corner apart gives one triangle over the midpoints of its three cut edges, one with two and
    two gives two.  All cubes are taken at once for each tetrahedron and each choice of its inner corners.
    """
    box, low = grid_of(points)
    cubes = tuple(s - 1 for s in box.shape)
    corner = {c: box[tuple(slice(o, o + n) for o, n in zip(c, cubes, strict=True))] for c in itertools.product((0, 1), repeat=3)}
    out, of = [np.zeros((0, 3, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    for t in tetrahedra():
        code = sum(corner[c].astype(np.uint8) << i for i, c in enumerate(t))
        for mask in range(1, 15):
            inside, outside = [c for i, c in enumerate(t) if mask >> i & 1], [c for i, c in enumerate(t) if not mask >> i & 1]
            middle = np.array([[np.add(i, o) for o in outside] for i in inside])
            if len(inside) == 2:
                (a, b), (c, d) = middle
                shapes = np.array([[a, b, c], [b, d, c]])
            else:
                shapes = middle.reshape(1, 3, 3)
            at = np.argwhere(code == mask) + low
            out += [2 * at[:, None, :] + s for s in shapes]
            of += [at] * len(shapes)
    return np.concatenate(out), np.concatenate(of)


#: Cubes of a box whose triangles one task finds.
BOX = (32, 64, 64)
_CORNER = "struct<z:int,y:int,x:int>"
_CORNERS = tuple(itertools.product((0, 1), repeat=3))


def cut_cubes(points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, cubes, masks): each label and each cube that has it at some corners, by label and cube; a bit of the mask for each of `_CORNERS`."""
    names, code = np.unique(labels, return_inverse=True)
    low = points.min(axis=0) - 1
    shape = points.max(axis=0) - low + 1
    at = code * shape.prod() + (points - low) @ np.array([shape[1] * shape[2], shape[2], 1])
    keys = np.concatenate([at - (c[0] * shape[1] + c[1]) * shape[2] - c[2] for c in _CORNERS])
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], (np.uint8(1) << (order // len(points)).astype(np.uint8))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    masks, keys = np.bitwise_or.reduceat(bits, first), keys[first]
    place = np.stack(np.unravel_index(keys % shape.prod(), shape), axis=1) + low
    return names[keys // shape.prod()], place, masks


def _codes(t) -> np.ndarray:
    """Of each of the 256 masks of a cube, the bits of a tetrahedron's corners."""
    return np.array([sum((m >> _CORNERS.index(c) & 1) << i for i, c in enumerate(t)) for m in range(256)], np.uint8)


#: Triangles of a cube by its mask.
TRIANGLES = np.array([0, 1, 1, 2, 1, 2, 2, 1, 1, 2, 2, 1, 2, 1, 1, 0])[np.stack([_codes(t) for t in tetrahedra()])].sum(axis=0)


def triangles_of(labels: np.ndarray, cubes: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, triangles): those of `isosurface` for every label, label after label and in its order."""
    shapes, step = [np.zeros((0, 3, 3), np.int32)], 0
    rows, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    for t in tetrahedra():
        code = _codes(t)[masks]
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(17))
        for mask in range(1, 15):
            inside, outside = [c for i, c in enumerate(t) if mask >> i & 1], [c for i, c in enumerate(t) if not mask >> i & 1]
            middle = np.array([[np.add(i, o) for o in outside] for i in inside], np.int32)
            if len(inside) == 2:
                (a, b), (c, d) = middle
                own = [[a, b, c], [b, d, c]]
            else:
                own = middle.reshape(1, 3, 3)
            for shape in own:
                shapes.append(np.array(shape, np.int32)[None])
                rows.append(order[ends[mask] : ends[mask + 1]])
                steps.append(np.full(len(rows[-1]), step, np.int16))
                step += 1
    rows, steps = np.concatenate(rows), np.concatenate(steps)
    of = labels[rows]
    order = np.argsort(of, kind="stable")  # steps rise inside of a label, and cubes inside of a step
    rows, steps = rows[order], steps[order]
    return of[order], 2 * cubes[rows].astype(np.int32)[:, None, :] + np.concatenate(shapes)[steps]


def _cubes_of_boxes(voxels: DataFrame, rate: int, label: str, run, schema: str) -> DataFrame:
    """`run(box, labels, cubes, masks)` for each box: its cubes and the labels at their corners, of every `rate`-th voxel on each axis.

    A cube belongs to the box of its lowest corner, which sees one voxel further.  A task has a box with all its labels, never a label.
    """
    keyed = voxels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label"), *AXES)
    for a in AXES:
        keyed = keyed.where(F.col(a) % rate == 0).withColumn(a, F.expr(f"{a} div {int(rate)}").cast("int"))
    size = BOX
    for a, n in zip(AXES, size, strict=True):
        keyed = keyed.withColumn(f"_b{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(a) - 1) / n).cast("int"), F.floor(F.col(a) / n).cast("int")))))

    def whole(table: pa.Table) -> pa.Table:
        box = np.array([table.column(f"_b{a}")[0].as_py() for a in AXES])
        points = np.stack([table.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64)
        labels, cubes, masks = cut_cubes(points, table.column("label").to_numpy())
        own = (cubes // np.array(size) == box).all(axis=1)
        return run(box, labels[own], cubes[own], masks[own])

    return keyed.groupBy(*[f"_b{a}" for a in AXES]).applyInArrow(whole, schema)


def mesh(voxels: DataFrame, rate: int = 1, label: str = "label") -> DataFrame:
    """(label, box, place, a, b, c): the triangles of each label's surface, of every `rate`-th voxel on each axis.

    Corners are named by where they cut the grid, in half voxels: a cut edge has one such place, so triangles of different
    boxes that meet name the same corners, and nothing has to be compared.
    """

    def run(box, labels, cubes, masks) -> pa.Table:
        of, triangles = triangles_of(labels, cubes, masks)
        triangles *= rate
        corner = lambda k: pa.StructArray.from_arrays([pa.array(triangles[:, k, j]) for j in range(3)], names=list(AXES))
        name = pa.array(["/".join(map(str, box.tolist()))], pa.string()).take(pa.array(np.zeros(len(of), np.int8)))
        return pa.table({"label": pa.array(of), "box": name, "place": pa.array(np.arange(len(of))), "a": corner(0), "b": corner(1), "c": corner(2)})

    return _cubes_of_boxes(voxels, rate, label, run, f"label long, box string, place long, a {_CORNER}, b {_CORNER}, c {_CORNER}")


def mesh_sizes(voxels: DataFrame, rate: int = 1, label: str = "label") -> DataFrame:
    """(label, n): the number of triangles of each label in `mesh`, counted by the masks of its cubes."""

    def run(box, labels, cubes, masks) -> pa.Table:
        names, place = np.unique(labels, return_inverse=True)
        n = np.bincount(place, TRIANGLES[masks], len(names)).astype(np.int64)
        return pa.table({"label": pa.array(names[n > 0]), "n": pa.array(n[n > 0])})

    return _cubes_of_boxes(voxels, rate, label, run, "label long, n long").groupBy("label").agg(F.sum("n").alias("n"))


def mesh_vertices(voxels: DataFrame, rate: int = 1, label: str = "label") -> DataFrame:
    """(label, z, y, x): each corner of the triangles of `mesh` once, in half voxels.

    A corner is the middle of a cut edge, and an edge begins at the lowest corner of one cube, so boxes have no corner in common.
    """
    edges = [(c, _CORNERS.index(c)) for c in _CORNERS[1:]]

    def run(box, labels, cubes, masks) -> pa.Table:
        of, found = [], []
        for offset, bit in edges:
            cut = np.flatnonzero((masks & 1) != (masks >> bit & 1))
            of.append(labels[cut])
            found.append((2 * cubes[cut] + offset).astype(np.int32) * rate)
        places = np.concatenate(found)
        return pa.table({"label": pa.array(np.concatenate(of)), **{a: pa.array(places[:, i]) for i, a in enumerate(AXES)}})

    return _cubes_of_boxes(voxels, rate, label, run, "label long, z int, y int, x int")


def vertices(triangles: DataFrame) -> DataFrame:
    """(label, z, y, x): each corner of the triangles of `mesh` once, in half voxels."""
    return triangles.select("label", F.explode(F.array("a", "b", "c")).alias("v")).select("label", "v.*").distinct()


def marching(voxels: DataFrame, resolution=(30, 15, 15), rate: int = 1, scale: float = 500.0, label: str = "label") -> DataFrame:
    """(label, ordinal, triangle array<array<double>>) per label, centred on the surface's box and in units of `scale` nm.

    Triangles of `mesh`, numbered inside of each box and over the boxes of a label; only the sizes of boxes are sorted.
    """
    found = tables.written(mesh(voxels, rate, label), "mesh")
    least = lambda f, a: f(*(F.col(f"{k}.{a}") for k in "abc"))
    sizes = found.groupBy("label", "box").agg(F.count("*").alias("_n"), F.min("place").alias("_first"), *[F.min(least(F.least, a)).alias(f"_l{a}") for a in AXES], *[F.max(least(F.greatest, a)).alias(f"_h{a}") for a in AXES])
    whole = Window.partitionBy("label")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("box").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a box numbers its triangles label after label
    sizes = sizes.select("label", "box", "_n", (before - F.col("_first")).alias("_from"), *[((F.min(f"_l{a}").over(whole) + F.max(f"_h{a}").over(whole)) / 2).alias(f"_m{a}") for a in AXES])
    placed = join_counted(found, sizes, ["label", "box"], "_n", found.count())
    corner = lambda k: F.array(*[(F.col(f"{k}.{a}") - F.col(f"_m{a}")) / 2 * r / scale for a, r in zip(AXES, resolution, strict=True)])
    return placed.select("label", (F.col("_from") + F.col("place")).alias("ordinal"), F.array(*map(corner, "abc")).alias("triangle"))


def stl_files(triangles: DataFrame) -> DataFrame:
    """(name, content): one binary STL file a label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body = b"".join(struct.pack("<12fH", 0, 0, 0, *[c for p in t for c in list(p)[::-1]], 0) for t in pdf.sort_values("ordinal").triangle)
        return pd.DataFrame({"name": [f"{pdf.label.iloc[0]}.stl"], "content": [bytes(80) + struct.pack("<I", len(pdf)) + body]})

    return triangles.groupBy("label").applyInPandas(run, "name string, content binary")


def png(image: np.ndarray) -> bytes:
    """A grey (h x w) or RGB (h x w x 3) image of bytes as PNG."""
    colour = 2 if image.ndim == 3 else 0

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(image, dtype=np.uint8))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_slices(voxels: DataFrame, ny: int, nx: int, columns: tuple[str, ...] = ("label",), prefix: str = "") -> DataFrame:
    """(name, content): one image a plane, `<prefix>-%05d.png`, of one grey or three colour columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx, len(columns)), np.uint8)
        a[pdf.y.to_numpy(), pdf.x.to_numpy()] = (pdf[list(columns)].to_numpy().astype(np.int64) & 255).astype(np.uint8)
        return pd.DataFrame({"name": [f"{prefix}-{int(pdf.z.iloc[0]):05d}.png"], "content": [png(a if len(columns) == 3 else a[..., 0])]})

    return voxels.select("z", "y", "x", *columns).groupBy("z").applyInPandas(run, "name string, content binary")


def gif(frames: list[np.ndarray], hundredths: int = 10) -> bytes:
    """An endless animation of grey frames (h x w bytes); codes stay at nine bits by clearing the table in time."""
    h, w = frames[0].shape
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + bytes(v for g in range(256) for v in (g, g, g))
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    for f in frames:
        codes = []
        flat = np.ascontiguousarray(f, dtype=np.uint8).ravel().tolist()
        for at in range(0, len(flat), 250):
            codes += [256, *flat[at : at + 250]]
        bits = sum(c << (9 * i) for i, c in enumerate([*codes, 257]))
        data = bits.to_bytes((9 * (len(codes) + 1) + 7) // 8, "little")
        blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
        out += b"\x21\xf9\x04\x00" + struct.pack("<H", hundredths) + b"\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\x00"
    return out + b"\x3b"


def animations(voxels: DataFrame, shape: dict[str, int], axis: str = "z", value: str = "label", by: str = "name") -> DataFrame:
    """(name, content): for each value of `by` a GIF of the slices along an axis; a volume of one name is one group."""
    rows, columns = (a for a in AXES if a != axis)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((shape[axis], shape[rows], shape[columns]), np.uint8)
        a[pdf[axis].to_numpy(), pdf[rows].to_numpy(), pdf[columns].to_numpy()] = (pdf["v"].to_numpy() & 255).astype(np.uint8)
        return pd.DataFrame({"name": [str(pdf["name"].iloc[0])], "content": [gif(list(a))]})

    return voxels.select(F.col(by).cast("string").alias("name"), *AXES, F.col(value).alias("v")).groupBy("name").applyInPandas(run, "name string, content binary")
