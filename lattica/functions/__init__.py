"""Column expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_of(z, y, x, ny: int, nx: int) -> Column:
    """Linear index of (z, y, x)."""
    return z * F.lit(ny * nx) + y * F.lit(nx) + x


def coordinates(iv, ny: int, nx: int) -> list[Column]:
    """z, y and x of a linear index that is not negative."""
    c = F.col(iv) if isinstance(iv, str) else iv
    div = lambda a, n: F.floor(a / F.lit(n)).cast("long")  # noqa: E731  exact below 2**53
    return [div(c, ny * nx).alias("z"), (div(c, nx) % ny).alias("y"), (c % nx).alias("x")]


def pairs(n: Column) -> Column:
    """n choose 2, as a decimal that does not overflow."""
    d = n.cast("decimal(19,0)")
    return (d * (d - F.lit(1).cast("decimal(1,0)")) / F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")


def log_odds(p: Column, beta: float = 0.95) -> Column:
    """ln(p / (1 - p)) + ln((1 - beta) / beta), p kept inside [1e-12, 1 - 1e-12]."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.ln(q / (1 - q)) + F.ln(F.lit((1 - beta) / beta))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def colorize(v: Column) -> list[Column]:
    # The colour of a label.
    return [((v * 107) % 700 % 255).alias("r"), ((v * 509) % 900 % 255).alias("g"), ((v * 200) % 777 % 255).alias("b")]


def dense_ids(df: DataFrame, col: str, name: str, width: int = 1_000_000) -> DataFrame:
    """`df` (distinct longs in `col`, none negative) with `name`: their rank from 1.

    Two levels, so no task ranks all of them: inside ranges of `width` values, plus the number in lower
    ranges; the second window sees one row a range.
    """
    cut = df.withColumn("_range", F.floor(F.col(col) / width))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(col))
    return cut.withColumn("_rank", inside).join(offsets, "_range").withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_range", "_rank", "_before")
