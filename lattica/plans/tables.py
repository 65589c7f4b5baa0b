"""Tables between the rounds of a loop: written to the shared folder, and deleted when nothing reads them any more."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame

from lattica.plans.components import ensure_checkpoint_dir

_paths: dict[str, object] = {}


def _delete(path: str) -> None:
    spark = _paths.pop(path, None)
    with contextlib.suppress(Exception):  # the session has ended; the folder's owner clears it
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written`; results that still depend on one must have been written before."""
    for df in tables:
        if getattr(df, "_table_path", None) in _paths:
            _delete(df._table_path)


@atexit.register
def _delete_all() -> None:
    for path in list(_paths):
        _delete(path)
