"""Grace hash deduplication: records are partitioned to files, again and again where a part is too large,
until each fits an open-addressing table in memory that compares complete content.

Level 0 combines equal texts inside a task, as long as its table has room, so that a group of copies that
holds a third of all rows becomes one record for each full table: the content once, the largest id and the
number of its rows.  The members (id and record) are narrow rows beside it.  Both are written (the spill
files).  Hashes that still have very many records go through one more combination, dealt by hash and record.
Level 1 takes the hash modulo the number of buckets that the bytes ask for; a bucket that is still too large
is split by the next bits of the hash, until it fits or no split makes it smaller (then its bytes are copies
of few contents, of which the table holds one each).  Buckets are Spark partitions, or runs of sorted rows in
one where there are more buckets than partitions are good for; shuffle files are the partition files, and a
lost executor costs only its own.  The members then meet their record's group in a join by record, where no
key has more rows than a table of level 0.

Defined cases: a null text equals an empty one; texts are equal when identical after lower-casing A-Z;
null ids never stay unless all ids of the group are null, where none is kept; of rows with the same largest
id one stays; an empty table gives no rows; ids are of any type that Spark and Python order alike (integers,
strings); a text longer than a bucket has a bucket of its own; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from . import common


class ContentTable:
    """Open addressing with linear probing; equal hashes are settled by comparing the bytes."""

    def __init__(self, room: int = 1024):
        self.slots = [-1] * room
        self.hashes: list[int] = []
        self.content: list[bytes] = []

    def place(self, h: int, content: bytes) -> int:
        """The number of this content, new or known."""
        if 2 * (len(self.content) + 1) > len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.content[k] == content:
                return k
            at = (at + 1) & mask
        self.slots[at] = k = len(self.content)
        self.hashes.append(h)
        self.content.append(content)
        return k

    def _grow(self) -> None:
        room = 2 * len(self.slots)
        self.slots = slots = [-1] * room
        for k, h in enumerate(self.hashes):
            at = h & (room - 1)
            while slots[at] >= 0:
                at = (at + 1) & (room - 1)
            slots[at] = k


class Groups:
    """Groups of records of equal content: the largest id, the number of rows, and the records with their largest ids."""

    def __init__(self):
        self.table, self.best, self.size, self.records = ContentTable(), [], [], []

    def add(self, h: int, content: bytes, best, size: int, records: list) -> None:
        k = self.table.place(h, content)
        if k == len(self.best):
            self.best.append(None)
            self.size.append(0)
            self.records.append([])
        if best is not None and (self.best[k] is None or best > self.best[k]):
            self.best[k] = best
        self.size[k] += size
        self.records[k] += records

    def settled(self, limit: int = 10_000):
        """Rows (record, keep_id, group_size, chosen, sha256); the first record with the group's largest id is chosen."""
        rows = []
        for k, content in enumerate(self.table.content):
            sha, open_ = hashlib.sha256(content).hexdigest(), self.best[k] is not None
            for own in self.records[k]:
                won = open_ and own["best"] == self.best[k]
                open_ = open_ and not won
                rows.append((own["record"], self.best[k], self.size[k], won, sha))
                if len(rows) == limit:
                    yield rows
                    rows = []
        if rows:
            yield rows


def combined(docs: DataFrame, id_col: str, text_col: str, room: int) -> DataFrame:
    """Members (record, id, top) of all rows; the first of a record has h, n_bytes, content, best and size too.

    A record is one content of one table of a task, which holds at most about `room` bytes of content.  `top`
    marks one member whose id is the record's `best`.
    """
    id_type = docs.schema[id_col].dataType
    source = docs.select(common.col(id_col).alias("id"), common.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    schema = T.StructType([T.StructField("record", T.LongType()), T.StructField("id", id_type), T.StructField("top", T.BooleanType()), T.StructField("h", T.LongType()),
                           T.StructField("n_bytes", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("best", id_type), T.StructField("size", T.LongType())])
    kind = to_arrow_type(id_type)

    def run(batches):
        table, groups, held, seq = ContentTable(), [], 0, 0

        def flush():
            for at in range(0, len(groups), 2000):
                out = []
                for k in range(at, min(at + 2000, len(groups))):
                    ids = groups[k]
                    best = max((i for i in ids if i is not None), default=None)
                    top = None if best is None else ids.index(best)
                    name, content = seq + k, table.content[k]
                    out += [(name, i, j == top, *((table.hashes[k], len(content), content, best, len(ids)) if j == 0 else (None,) * 5)) for j, i in enumerate(ids)]
                kinds = [pa.int64(), kind, pa.bool_(), pa.int64(), pa.int64(), pa.binary(), kind, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        for part in common.pieces_of(batches, "text", 8_000_000):
            if not seq:
                seq = part.column(2)[0].as_py() * 2**40
            for i, t in zip(part.column(0).to_pylist(), common.as_bytes(part.column(1)), strict=True):
                content = (t or b"").lower()
                k = table.place(xxhash.xxh3_64_intdigest(content) >> 1, content)
                if k == len(groups):
                    groups.append([])
                    held += len(content) + 200
                groups[k].append(i)
                held += 16
            if held >= room:
                yield from flush()
                seq += len(groups)
                table, groups, held = ContentTable(), [], 0
        yield from flush()
        del table, groups
        common.release()

    return source.mapInArrow(run, schema)


def merged(records: DataFrame, most: int) -> DataFrame:
    """`records` (h, n_bytes, content, best, size, records) where those of hashes with more than `most` of them are
    combined by (h, part of them), so that a hash has about 1 / `most` as many."""
    many = records.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most)
    many = common.written(many.select(F.col("h").alias("_h"), F.ceil(F.col("n") / most).alias("ways")), "popular")
    if many.isEmpty():
        return records
    own = records.join(many, F.col("h") == F.col("_h"), "left")
    dealt = own.where("ways is not null").repartition("h", F.pmod(F.xxhash64(F.col("records")[0]["record"]), "ways")).select(*records.columns)

    kinds, names = to_arrow_schema(records.schema), records.columns

    def run(batches):
        state = Groups()
        for batch in batches:
            for h, _, content, best, size, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.add(h, content, best, size, of)
        table = state.table
        values = (table.hashes, list(map(len, table.content)), table.content, state.best, state.size, state.records)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, kinds, strict=True)], names=names)

    return common.written(own.where("ways is null").select(*records.columns).unionByName(dealt.mapInArrow(run, records.schema)), "merged")


def bucket_plan(records: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """`records` with its bucket, and the number of buckets.

    Reads (h, n_bytes) only.  To the driver comes the total; oversized buckets stay in small written tables, a
    level each, until none is left that a split made smaller.
    """
    total = records.agg(F.sum("n_bytes")).first()[0] or 0
    count = max(1, -(-total // bucket_bytes))
    placed, depth, large = records.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(count))).withColumn("_from", F.lit(None).cast("long")), 0, None
    while True:
        depth += 1
        # _from: the bytes of the bucket that this one was split from.
        sized = placed.groupBy("bucket").agg(F.sum("n_bytes").alias("n"), F.max("_from").alias("before"), F.countDistinct("h").alias("k"))
        large = common.written(sized.where((F.col("n") > 2 * bucket_bytes) & (F.col("k") > 1) & (F.coalesce("before", F.col("n") + 1) > F.col("n"))).select(F.col("bucket").alias("_b"), "n", F.ceil(F.col("n") / bucket_bytes).alias("ways")), "large")
        more = large.agg(F.sum("ways")).first()[0]
        if not more:
            return placed.drop("_from"), count
        # New buckets are numbered after all that there are; the window sees the oversized ones only.
        split = large.select("_b", "n", "ways", (F.lit(count) + F.sum("ways").over(Window.orderBy("_b")) - F.col("ways")).alias("at"))
        placed = placed.join(split, F.col("bucket") == F.col("_b"), "left")
        placed = placed.withColumn("bucket", F.when(F.col("_b").isNull(), F.col("bucket")).otherwise(F.col("at") + F.pmod(F.xxhash64(F.lit(depth), "h"), "ways")))
        placed = placed.withColumn("_from", F.when(F.col("_b").isNull(), F.col("_from")).otherwise(F.col("n"))).drop("_b", "n", "ways", "at")
        count += more


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int | None = None, most_records: int = 64, most_partitions: int = 20_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`.

    A bucket holds `bucket_bytes` of content (by default what an executor's memory allows, `common.task_bytes`).
    """
    limit = bucket_bytes or common.task_bytes(docs.sparkSession)
    spilled = common.written(combined(docs, id_col, text_col, limit), "grace")
    records = spilled.where("h is not null").select("h", "n_bytes", "content", "best", "size", F.array(F.struct("record", "best")).alias("records"))
    records = merged(records, most_records)
    placed, count = bucket_plan(records, limit)
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("_r", T.LongType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()), T.StructField("chosen", T.BooleanType()), T.StructField("text_sha256", T.StringType())])

    def dedupe(batches):
        now, state = None, Groups()

        def results():
            for rows in state.settled():
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), kind, pa.int64(), pa.bool_(), pa.string()), strict=True)], names=schema.names)

        for batch in batches:
            for bucket, h, content, best, size, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sorted_ and bucket != now:
                    yield from results()
                    now, state = bucket, Groups()
                state.add(h, content, best, size, of)
        yield from results()
        del state
        common.release()

    sorted_ = count > most_partitions
    parts = placed.select("bucket", "h", "content", "best", "size", "records").repartitionById(min(count, most_partitions), (F.col("bucket") % most_partitions).cast("int"))
    if sorted_:
        parts = parts.sortWithinPartitions("bucket")
    groups = parts.mapInArrow(dedupe, schema)
    # All records of a group with its best id may hold a row of it: the least record and, in it, the top member stays.
    members = spilled.select("record", "id", "top").join(groups, F.col("record") == F.col("_r"))
    return members.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("chosen") & F.col("top")).alias("kept"), "text_sha256")


def op8_grace_hash(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d
"""
