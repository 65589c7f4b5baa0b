"""Shared helpers of the training-data operators.

Conventions of every operator here: a null text counts as empty.  Operators that return the rows of their
input (2, 3, 4, 5, 6, and `keep_one` of 9) pass its columns through, and an input column that has the name of
a result column is replaced by it; those that return a table of their own (1, 7, 8, 9, 10) read the named
columns and pass none through.  Helper columns get names that the input doesn't have.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.components import ensure_checkpoint_dir

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (see `components.ensure_checkpoint_dir`)."""
    return ensure_checkpoint_dir(spark)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it needs to differ from all columns of `taken`."""
    low, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its plain name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        return


#: Paths of tables that `written` made and nothing deleted yet; the last list is that of the open `scratch`.
_paths: list[list[tuple[SparkSession, str]]] = [[]]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is put there is deleted with the open `scratch`, or when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again (results that still depend on one must be written)."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        for paths in _paths:
            for entry in [x for x in paths if x[1] == path]:
                paths.remove(entry)
                _delete(*entry)


@contextlib.contextmanager
def scratch():
    """Tables written inside are deleted at its end; what leaves it must have been written elsewhere."""
    _paths.append([])
    try:
        yield
    finally:
        for entry in _paths.pop():
            _delete(*entry)


@atexit.register
def _delete_all() -> None:
    for paths in _paths:
        for entry in paths:
            _delete(*entry)
        paths.clear()


def task_bytes(spark: SparkSession, share: int = 32) -> int:
    """Bytes of records that a task may hold at once: a part of the memory that an executor has for each core."""
    units = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    conf = spark.sparkContext.getConf()
    memory = (conf.get("spark.executor.memory", None) or conf.get("spark.driver.memory", None) or "1g").lower().removesuffix("b")
    total = int(memory[:-1]) * units[memory[-1]] if memory[-1] in units else int(memory)
    cores = int(conf.get("spark.executor.cores", None) or 0)
    master = spark.sparkContext.master
    if not cores and master.startswith("local-cluster"):
        cores = int(master.split(",")[1])
    if not cores:
        cores = spark.sparkContext.defaultParallelism if master.startswith("local") else 1
    return max(16_000_000, total // cores // share)


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with column `name`: 0, 1, 2... among rows of equal `keys` (none of them null).

    No task sees all rows of a key: rows are numbered inside the partition that they lie in, and one row for
    each key and partition gives the numbers before it.  The rows are written first, so that numbers agree
    whenever they are read.  Only DataFrame functions.
    """
    part, place, before = fresh([*df.columns, name], "part", "place", "before")
    rows = written(df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "numbered")
    own = Window.partitionBy(*map(col, keys), part).orderBy(place)
    counts = rows.groupBy(*map(col, keys), part).agg(F.count("*").alias(name))
    sums = F.sum(name).over(Window.partitionBy(*map(col, keys)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*map(col, keys), part, F.coalesce(sums, F.lit(0)).alias(before))
    out = rows.withColumn(name, F.row_number().over(own) - 1).join(counts, [*keys, part])
    return out.withColumn(name, (col(name) + col(before)).cast("long")).drop(part, place, before).select(*map(col, [*df.columns, name]))


def lower_ascii(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def crc32_mod(col, n: int):
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    low = {x.lower() for x in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in low])


def as_bytes(column) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def release(collect: bool = True) -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and with them what they hold."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of one column, so a task's memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= limit:
                yield batch.slice(begin, i + 1 - begin)
                begin, total = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], limit: int = 2_000_000) -> DataFrame:
    """Map-only: `make()` gives, once a task, a function from texts (bytes or None) to one list per field."""
    kept = drop_columns(df, [f.name for f in fields])
    source = kept if text_col in kept.columns else kept.withColumn(text_col, F.lit(None).cast("string"))
    schema = T.StructType([*source.schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        fn = make()
        for part in pieces_of(batches, text_col, limit):
            texts = as_bytes(part.column(part.schema.get_field_index(text_col)))
            new = [pa.array(values, type=kind) for values, kind in zip(fn(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)
        del fn
        release()

    return source.mapInArrow(run, schema)
