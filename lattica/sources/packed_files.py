"""Struct-packed binary files (little-endian) as DataFrames and back.

Spark's `binaryFile` source lists a folder or glob of files without their contents.  A first step finds the places where a
file may be cut: records are of fixed size, so only counts of labels are looked at.  Pieces of some megabytes are then dealt over
tasks of `spark.sql.files.maxPartitionBytes`, so a file of any size is read by many tasks and is never a row.  A layout is a
header, then either records or, for each label in order, a count and that label's records.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    header: tuple[str, ...]  # names of 8-byte header fields; the one named n counts records
    record: tuple[tuple[str, str], ...]  # (name, q or d)
    per_label: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, "<i8" if t == "q" else "<f8") for n, t in self.record])

    @property
    def schema(self) -> str:
        own = [f"{n} {'long' if t == 'q' else 'double'}" for n, t in self.record]
        return ", ".join(["path string", *[f"{h} long" for h in self.header if h != "n"], *(["label long"] if self.per_label else []), "ordinal long", *own])


_GRID = ("nz", "ny", "nx", "max_label")
#: The layouts of the file formats.
LAYOUTS = {
    "mapping": Layout(("n",), (("mapped", "q"),)),
    "cells": Layout(_GRID, (("iv", "q"),), True),
    "skeleton": Layout(_GRID, (("iv", "q"),), True),
    "vectors": Layout(_GRID, (("iv", "q"), ("vz", "d"), ("vy", "d"), ("vx", "d")), True),
    "node_examples": Layout(("n",), (("label_one", "q"), ("label_two", "q"))),
    "edge_examples": Layout(("n",), (("z", "q"), ("y", "q"), ("x", "q"), ("label_one", "q"), ("label_two", "q"), ("endpoint", "q"))),
    "probabilities": Layout(("n",), (("v1", "q"), ("v2", "q"), ("p", "d"))),
    "graph": Layout(("n_vertices", "n"), (("l1", "q"), ("l2", "q"), ("r1", "q"), ("r2", "q"), ("weight", "d"))),
    "benchmark_labels": Layout(("n",), (("label", "q"),)),
    "human_endpoints": Layout(("n",), (("z", "q"), ("y", "q"), ("x", "q"))),
    "matching": Layout(("max_label",), (("truth", "q"), ("proposed", "q")), True),
    "running_times": Layout(("n",), (("seconds", "d"),)),
}


#: Bytes of a file that are decoded at once.
PIECE = 8 << 20


def pieces(kind: str, path: str, length: int, read: Callable[[int, int], bytes], most: int = PIECE) -> Iterator[tuple]:
    """(offset, bytes, label, ordinal, left, last label, header): where a file's records may be cut, about `most` bytes each.

    A piece starts with `left` records of its label, from `ordinal` on, or with a count where `left` is -1.  A file
    that is too short raises ValueError.
    """
    layout = LAYOUTS[kind]
    size, at = layout.dtype.itemsize, 8 * len(layout.header)
    most = max(most, size)
    if length < at:
        raise ValueError(f"{path}: no room for the header of {kind}")
    head = np.frombuffer(read(0, at), "<i8").tolist()
    header = dict(zip(layout.header, head, strict=True))
    start, first = at, (0, 0, -1 if layout.per_label else header["n"])
    for label in range(header["max_label"] if layout.per_label else 1):
        n = header.get("n", -1)
        if layout.per_label:
            n = int(np.frombuffer(read(at, 8), "<i8")[0]) if length >= at + 8 else -1
            at += 8
        if n < 0 or length < at + n * size:
            raise ValueError(f"{path}: {n} records of {kind} do not fit")
        done = 0
        while at + (n - done) * size - start > most:
            take = max(0, (start + most - at) // size)
            at, done = at + take * size, done + take
            yield start, at - start, *first, label, head
            start, first = at, (label, done, n - done)
        at += (n - done) * size
    if at > start:
        yield start, at - start, *first, label, head


def decode_piece(kind: str, path: str, content: bytes, label: int, ordinal: int, left: int, head: list[int]) -> pd.DataFrame:
    """Rows of one piece."""
    layout = LAYOUTS[kind]
    size, at, found = layout.dtype.itemsize, 0, []
    if left < 0:
        label, left = label - 1, 0
    while True:
        take = min(left, (len(content) - at) // size)
        if take:
            found.append((np.frombuffer(content, layout.dtype, take, at), label, ordinal))
            at += take * size
        if at >= len(content):
            break
        label, ordinal, left = label + 1, 0, int(np.frombuffer(content, "<i8", 1, at)[0])
        at += 8
    counts = [len(r) for r, _, _ in found]
    rows = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, layout.dtype)
    own = {"ordinal": np.concatenate([np.arange(o, o + n) for (_, _, o), n in zip(found, counts, strict=True)]) if found else np.zeros(0, np.int64)}
    if layout.per_label:
        own["label"] = np.repeat(np.array([k for _, k, _ in found], np.int64), counts)
    header = {h: v for h, v in zip(layout.header, head, strict=True) if h != "n"}
    names = [c.split()[0] for c in layout.schema.split(", ")]
    return pd.DataFrame(rows).assign(**own, **header, path=path)[names]


def decode(kind: str, path: str, content: bytes) -> pd.DataFrame:
    """Rows of one file; a file that is too short raises ValueError."""
    found = [decode_piece(kind, path, content[at : at + n], *first, head) for at, n, *first, _, head in pieces(kind, path, len(content), lambda at, n: content[at : at + n])]
    return pd.concat(found, ignore_index=True) if found else decode_piece(kind, path, b"", 0, 0, 0, [0] * len(LAYOUTS[kind].header))


def encode(kind: str, rows: pd.DataFrame, **header: int) -> bytes:
    """One file's bytes; rows are in order of label and ordinal."""
    layout = LAYOUTS[kind]
    order = [c for c in ("label", "ordinal") if c in rows and c not in dict(layout.record)]
    rows = rows.sort_values(order, kind="stable") if order else rows
    values = np.zeros(len(rows), layout.dtype)
    for n, _ in layout.record:
        values[n] = rows[n].to_numpy()
    head = np.array([len(rows) if h == "n" else header[h] for h in layout.header], "<i8").tobytes()
    if not layout.per_label:
        return head + values.tobytes()
    label = rows["label"].to_numpy()
    parts = [values[label == k] for k in range(header["max_label"])]
    return head + b"".join(np.array([len(p)], "<i8").tobytes() + p.tobytes() for p in parts)


def _opened(path: str):
    """Arrow's random-access file of a path as Spark lists it; ValueError for schemes that only Hadoop's file systems know."""
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    where, own = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return where.open_input_file(own)


def _looked_up(file, block: int = 1 << 16) -> Callable[[int, int], bytes]:
    """A reader of few bytes at growing places that asks for a block at a time."""
    held, content = 0, b""

    def read(at: int, n: int) -> bytes:
        nonlocal held, content
        if at < held or at + n > held + len(content):
            file.seek(at)
            held, content = at, file.read(max(n, block))
        return content[at - held : at - held + n]

    return read


def read_packed(spark: SparkSession, path, kind: str, ignore_missing: bool = False, labels: tuple[int, int] | None = None, piece: int = PIECE) -> DataFrame:
    """Rows of all files of a path, by pieces of about `piece` bytes; empty files of no records give no row.

    `labels` (first, last) of a layout with labels keeps these; pieces outside of them are not read.  A file that is too short
    fails the query.  With `ignore_missing` files that are gone since the listing are left out.  Schemes that
    only Hadoop's file systems know are read a whole file at a time, each below 2 GB.
    """
    layout, schema = LAYOUTS[kind], LAYOUTS[kind].schema
    if labels is not None and not layout.per_label:
        raise ValueError(f"{kind} has no labels")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", str(ignore_missing).lower()).load(path)
    listed = files.select("path", "length")
    total, example = listed.agg(F.sum("length"), F.min("path")).first()
    try:
        if example is not None:
            _opened(example).close()
    except FileNotFoundError:
        pass
    except Exception:  # noqa: BLE001  no file system of Arrow's
        return _kept(_read_whole(files, kind), labels)

    def cut(batches):
        for pdf in batches:
            for p, length in zip(pdf.path, pdf.length, strict=True):
                try:
                    with _opened(p) as file:
                        found = list(pieces(kind, p, length, _looked_up(file), piece))
                except FileNotFoundError:
                    if not ignore_missing:
                        raise
                    continue
                rows = [(p, *row) for row in found if labels is None or (row[2] <= labels[1] and row[5] >= labels[0])]
                yield pd.DataFrame(rows, columns=["path", "offset", "bytes", "label", "ordinal", "left", "last", "head"])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    with _opened(r.path) as file:
                        file.seek(r.offset)
                        content = file.read(r.bytes)
                except FileNotFoundError:
                    if not ignore_missing:
                        raise
                    continue
                if len(content) < r.bytes:
                    raise ValueError(f"{r.path}: shorter than when it was listed")
                yield decode_piece(kind, r.path, content, r.label, r.ordinal, r.left, list(r.head))

    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    tasks = max(1, -(-(total or 0) // (int(number) << 10 * " kmgtp".index(unit or " "))))
    found = listed.mapInPandas(cut, "path string, offset long, bytes long, label long, ordinal long, left long, last long, head array<long>")
    return _kept(found.repartition(tasks).mapInPandas(run, schema), labels)


def _kept(rows: DataFrame, labels: tuple[int, int] | None) -> DataFrame:
    return rows if labels is None else rows.where(F.col("label").between(*labels))


def _read_whole(files: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content, strict=True):
                yield decode(kind, p, bytes(c))

    return files.select("path", "content").mapInPandas(run, LAYOUTS[kind].schema)


def packed_files(df: DataFrame, kind: str, name: str, **header: int) -> DataFrame:
    """(name, content): one file for each value of column `name`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "content": [encode(kind, pdf, **header)]})

    return df.withColumn("name", F.col(name).cast("string")).groupBy("name").applyInPandas(run, "name string, content binary")


def save_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files of a folder.

    Executors write what they hold where Arrow has a file system for the folder's scheme (the folder must be one
    that all of them share); for other schemes the rows come to the driver one at a time and go through Hadoop's.
    """
    from pyarrow import fs

    uri = folder if "://" in folder else "file://" + (folder if folder.startswith("/") else "/" + folder)
    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001  a scheme that only Hadoop's file systems know
        _save_by_driver(files, folder)
        return

    def run(batches):
        where, root = fs.FileSystem.from_uri(uri)
        where.create_dir(root, recursive=True)
        done = 0
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                # A task that is run again replaces its files.
                with where.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
                done += 1
        yield pd.DataFrame({"n": [done]})

    files.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _save_by_driver(files: DataFrame, folder: str) -> None:
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in files.select("name", "content").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row.name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row.content))
        out.close()


def read_mapping(spark: SparkSession, path) -> DataFrame:
    """(label, mapped): the record's place is the label."""
    return read_packed(spark, path, "mapping").select(F.col("ordinal").alias("label"), "mapped")


def read_skeletons(spark: SparkSession, points_path, vectors_path) -> DataFrame:
    """(label, iv, is_endpoint, vz, vy, vx): negative or zero indices are endpoints; vectors join by label and index.

    The query fails where the headers of both files differ, or a label's endpoints are not as many as its vectors.
    """
    points, vectors = read_packed(spark, points_path, "skeleton"), read_packed(spark, vectors_path, "vectors")
    p = points.select("label", F.abs("iv").alias("iv"), (F.col("iv") <= 0).alias("is_endpoint"))
    v = vectors.select("label", "iv", "vz", "vy", "vx")
    heads = points.select(*_GRID).unionByName(vectors.select(*_GRID)).agg(*[F.countDistinct(c).alias(c) for c in _GRID])
    ends = p.where("is_endpoint").groupBy("label").agg(F.count("*").alias("a")).join(v.groupBy("label").agg(F.count("*").alias("b")), "label", "full")
    odd = ends.agg(F.count_if(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))).alias("odd"))
    one = heads.crossJoin(odd)  # one row each
    same = [F.col(c) <= 1 for c in _GRID]
    fine = F.when(same[0] & same[1] & same[2] & same[3], F.when(F.col("odd") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("skeleton endpoints and vectors differ in number"))))
    one = one.select(fine.otherwise(F.raise_error(F.lit("headers of skeleton and vectors differ"))).cast("boolean").alias("fine"))
    return p.join(v, ["label", "iv"], "left").crossJoin(F.broadcast(one)).where("fine").drop("fine")


def read_skeleton_endpoints(spark: SparkSession, path, ny: int, nx: int) -> DataFrame:
    from lattica.functions import coordinates

    ends = read_packed(spark, path, "skeleton").where("iv <= 0").select("label", (-F.col("iv")).alias("iv"))
    return ends.select("label", "iv", *coordinates("iv", ny, nx))
