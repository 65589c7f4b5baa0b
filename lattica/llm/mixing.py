"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every row has a 60-bit hash of its id and text.  Words are summed by source and by the top bits of the hash;
the running sum over these buckets shows in which bucket a source's budget ends.  Only rows of that boundary
bucket are summed again by their next bits, until the bits are used up.  The result is one threshold a
source, and taking rows is a filter on `hash < threshold`: rows are never sorted.  Of the rows that have the
boundary hash itself, as many are taken as bring the sum nearest to the budget (fewer if two numbers are
equally near): rows that repeat id and text have equal hashes, and where such a row is on the boundary, its
repeats are numbered (`common.numbered`) and the first ones taken.  So each source's words are within half of
one row's size of its target.

Defined cases: a null text has size 0; null is a source of its own, last in order; null and repeated ids are
told apart by their texts; an empty table gives an empty result; reruns agree, as the hash depends on id,
text and seed alone and rows that repeat both are alike; extra columns pass through, whatever their names;
a very long text counts as a whole, so a source can miss its target by half of its longest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def hash60(id_, text, seed: int):
    """The first 60 bits of the MD5 of `seed:id:text`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over sources by code point, null last.  A target stops at `cap` sizes and the excess is
    shared again by weight until none is above: targets are min(cap * size, level * weight) for the one level
    at which they sum to the budget.  Sources in rising order of cap / weight are full up to the first whose
    level (budget left / weight left) doesn't pass its own cap.  These windows see one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_r", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_r", "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("_level", left / rest)
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_k", "_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(level["_level"] * F.col("_w"), F.col("_cap")))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, left): rows of `rows(source, h, size)` with h < threshold are the longest run of whole
    hash values whose sizes sum to at most `budgets(source, budget)`; left is what they leave of it.

    Level by level: `found` has the prefix of the boundary bucket and the budget left inside of it.
    """
    found = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for done in range(0, BITS, LEVEL_BITS):
        shift = BITS - done - LEVEL_BITS
        inside = rows.join(found.select(F.col("source").alias("_s"), "prefix"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", BITS - done) == F.col("prefix")))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        marked = histogram.withColumn("run", run).join(found.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s")))
        edge = marked.groupBy("source").agg(
            F.min(F.when(F.col("run") > F.col("left"), F.struct("b", (F.col("left") - F.col("run") + F.col("n")).alias("left")))).alias("e"))
        edge = edge.select(F.col("source").alias("_s"), "e", F.lit(True).alias("_seen"))
        # Without a boundary bucket every row fits: the threshold is past the last value of this prefix.
        end = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        found = found.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", F.coalesce(F.col("e.b"), end).alias("prefix"), F.coalesce(F.col("e.left"), F.lit(0.0)).alias("left"))
        last, found = found, common.written(found, "level")
        common.discard(last)
    return found.select("source", F.col("prefix").alias("threshold"), "left")


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of `df` with size, source_size, target (its source's), copies and taken (= copies * size).

    A source takes each row floor(target / source_size) times, and rows under its hash threshold once more, with
    so many of those on it that the sum is nearest to the target.
    Texts are read once for sizes; a narrow table of (source, hash, size) sums serves the levels.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    base = common.drop_columns(df, made)
    kept = base.columns
    h, src, whole, cut, more, tied, nth = common.fresh([*kept, *made], "h", "of_source", "whole", "threshold", "more", "tied", "nth")
    text = common.col(text_col)
    base = base.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    base = base.withColumn(h, hash60(common.col(id_col), text, seed))
    narrow = base.groupBy(common.col(source_col).alias("source"), F.col(h).alias("h")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    narrow = common.written(narrow, "mix")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = common.written(targets.withColumn("whole", times), "targets")
    found = thresholds(narrow.drop("rows"), plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    found = found.select(F.col("source").alias("_c"), "threshold", "left")
    edge = narrow.select(F.col("source").alias("_e"), "h", "rows", (F.col("size") / F.col("rows")).alias("each"))
    plan = plan.join(found, F.col("source").eqNullSafe(F.col("_c")), "left")
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_e")) & (F.col("h") == F.col("threshold")), "left")
    # Rows of the boundary hash that are taken: the number nearest to what is left, the smaller of two.
    plan = plan.withColumn("more", F.coalesce(F.ceil(F.col("left") / F.col("each") - 0.5), F.lit(0)).cast("long")).withColumn("rows", F.coalesce("rows", F.lit(0)))
    # Written, so that its size is known: Spark broadcasts it below its threshold, else the join shuffles.
    plan = common.written(plan.select(F.col("source").alias(src), "source_size", "target", F.col("whole").alias(whole), F.col("threshold").alias(cut), F.col("more").alias(more), F.col("rows").alias(tied)), "plan")
    common.discard(narrow, targets)
    out = base.join(plan, common.col(source_col).eqNullSafe(F.col(src)), "left")
    on_edge, some = F.col(h) == F.col(cut), (F.col(more) > 0) & (F.col(more) < F.col(tied))
    first = F.when(on_edge, F.col(more) > 0).otherwise(F.col(h) < F.col(cut))
    if plan.where(some).isEmpty():
        out = out.withColumn(nth, first)
    else:
        split = on_edge & some
        edges = common.numbered(out.where(split).withColumn(src, F.xxhash64(src)), [src], nth)
        out = out.where(~split).withColumn(nth, first).unionByName(edges.withColumn(src, F.lit(None).cast(plan.schema[src].dataType)).withColumn(nth, F.col(nth) < F.col(more)))
    # Copies stop at the cap also where a budget is rounded to a full source.
    copies = F.least(F.col(whole) + F.col(nth).cast("long"), F.lit(int(cap)).cast("long"))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*map(common.col, [*kept, *made]))


def op6_hash_thresholds(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
  ('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15))::bigint h from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by encode(source) nulls last) - 1 k from d group by source),
w as (select *, cast(case k % 3 when 0 then 3 when 1 then 1 else 2 end as double) w, source_size * 2.0::double cap from s),
r as (select *, cap / w r, sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) lft,
  sum(w) over () - coalesce(sum(w) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) rest from w),
l as (select lft / rest lv from r where lft / rest <= r order by r.r, k limit 1),
t as (select source, source_size, least(cap, coalesce((select lv from l) * w, cap)) target from r),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end whole from t),
q as (select d.doc_id, d.source, d.size, source_size, target, whole, target - whole * source_size budget,
  sum(d.size) over (partition by d.source order by h range between unbounded preceding and current row) run,
  sum(d.size) over (partition by d.source, h) tied, row_number() over (partition by d.source, h) nth
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(size * least(2, whole + case when run <= budget or run - tied <= budget and nth <= ceil((budget - (run - tied)) / size - 0.5) then 1 else 0 end) as bigint) taken from q
"""
