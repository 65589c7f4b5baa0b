"""Two-pass external shuffle into shards.

Pass 1 scatters whole records over buckets that fit in a task's memory by a seeded hash of all their columns.
Records that repeat so often that they would fill a bucket are numbered (`common.numbered`), and the number
goes into the hash.  The buckets are counted before they are filled, and there are more of them if one is too
large.  Pass 2 holds one bucket at a time in memory, puts it in a canonical order (shuffle blocks arrive in
any order), applies a seeded Fisher-Yates shuffle and deals the records out.  A record's place in the whole
permutation is its bucket's offset plus its place in the bucket; place p goes to shard p mod n, slot p div n,
so that counts of shards differ by one at most (law `rows`) and slots have no gaps.

Defined cases: null texts are records of size 1; repeated rows are separate records and may swap places
without a visible difference; an empty table gives no rows; extra columns travel along, whatever their names
(columns that hold maps aren't hashed); a text that is larger than a bucket is held whole by its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FIELDS = [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: each place from the last swaps with a place not after it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    values = order.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        values[i], values[j] = values[j], values[i]
    return np.array(values, dtype=np.int64)


def _keyed(base: DataFrame, text_col: str, seed: int, bucket_bytes: int, order: str, nth: str) -> DataFrame:
    """`base` with `order` (a hash of the whole record) and `nth` (a number among very many equal ones, else 0)."""
    plain = [c for c, f in zip(base.columns, base.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    keyed = base.withColumn(order, F.xxhash64(F.lit(seed), *map(common.col, plain)))
    (size,) = common.fresh([*keyed.columns, nth], "size")
    sized = keyed.select(order, _size(text_col).alias(size)).groupBy(order).agg(F.sum(size).alias(size), F.count("*").alias("n"))
    many = common.written(sized.where((F.col("n") > 1) & (F.col(size) > bucket_bytes // 8)).select(F.col(order).alias(nth)), "repeated")
    if many.isEmpty():
        return keyed.withColumn(nth, F.lit(0).cast("long"))
    often = keyed.join(many, F.col(order) == F.col(nth), "left")
    numbered = common.numbered(often.where(F.col(nth).isNotNull()).drop(nth), [order], nth)
    return often.where(F.col(nth).isNull()).withColumn(nth, F.lit(0).cast("long")).unionByName(numbered)


def _size(text_col: str):
    return F.coalesce(F.octet_length(common.col(text_col)), F.lit(0)) + 64


def external_shuffle(df: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, bucket_bytes: int | None = None, most_partitions: int = 20_000) -> DataFrame:
    """All rows and columns of `df` with shard and slot.

    A bucket has about `bucket_bytes` (by default what an executor's memory allows, `common.task_bytes`); more
    than `most_partitions` buckets share partitions, sorted, so that a task still holds one at a time.  The order
    depends on rows, seed and `bucket_bytes`, not on how the rows are partitioned.
    """
    spark = df.sparkSession
    limit = bucket_bytes or common.task_bytes(spark)
    base = common.drop_columns(df, ["shard", "slot"])
    order, nth, bucket = common.fresh([*base.columns, "shard", "slot"], "order", "nth", "bucket")
    sized = df.agg(F.sum(_size(text_col)), F.max(_size(text_col))).first()
    count, largest = max(1, -(-(sized[0] or 0) // limit)), sized[1] or 0
    keyed = _keyed(base, text_col, seed, limit, order, nth)
    while True:
        dealt = keyed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), order, nth), F.lit(count)).cast("int"))
        # One row for each bucket comes to the driver.
        sizes = {r[0]: (r[1], r[2]) for r in dealt.groupBy(bucket).agg(F.count("*"), F.sum(_size(text_col))).collect()}
        if max((n for _, n in sizes.values()), default=0) <= 4 * limit + largest or count > 64 * max(1, (sized[0] or 0) // limit):
            break
        count *= 2
    offsets = np.zeros(count + 1, dtype=np.int64)
    offsets[1:] = np.cumsum([sizes.get(b, (0, 0))[0] for b in range(count)])
    sent = spark.sparkContext.broadcast(offsets)
    schema = T.StructType([*base.schema.fields, *FIELDS])
    names = [f.name for f in schema.fields]

    def deal(batches):
        def out(b, parts):
            held = pa.Table.from_batches(parts).combine_chunks()
            ids = held.column(id_col).to_pylist()
            by, n = held.column(order).to_numpy(), held.column(nth).to_numpy()
            canonical = np.array(sorted(range(len(ids)), key=lambda i: (by[i], n[i], str(ids[i]))), dtype=np.int64)
            shuffled = canonical[fisher_yates(len(ids), np.random.default_rng([seed, b]))]
            own = held.drop_columns([order, nth, bucket])
            for at in range(0, len(ids), 2000):
                part = own.take(pa.array(shuffled[at : at + 2000]))
                place = sent.value[b] + np.arange(at, at + part.num_rows)
                part = part.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))
                yield from part.select(names).combine_chunks().to_batches()

        buckets: dict[int, list] = {}
        for batch in batches:
            which = batch.column(batch.schema.get_field_index(bucket)).to_numpy(zero_copy_only=False)
            for b in np.unique(which).tolist():
                if sorted_ and buckets and b not in buckets:
                    yield from out(*buckets.popitem())
                buckets.setdefault(b, []).append(batch.filter(pa.array(which == b)) if which[0] != b or which[-1] != b else batch)
        for b in sorted(buckets):
            yield from out(b, buckets.pop(b))

    sorted_ = count > most_partitions
    parts = dealt.repartitionById(min(count, most_partitions), (F.col(bucket) % most_partitions).cast("int"))
    return (parts.sortWithinPartitions(bucket) if sorted_ else parts).mapInArrow(deal, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within files that hold ranges of slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return external_shuffle(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
