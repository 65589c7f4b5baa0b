"""Ground truth of segments and of pairs of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.geometry import Geometry
from lattica.plans.joins import dealt_by_rows


def seg2gold(voxels: DataFrame, match: float = 0.80, nonzero: float = 0.40, label: str = "label", gold: str = "gold") -> DataFrame:
    """(label, gold): the gold id of most voxels; 0 where too few have one, -1 where no id has enough of them.

    Ties go to the smallest id.  Voxels are counted by (label, gold) before anything else; shares are compared
    as products of whole numbers of thousandths.
    """
    counts = voxels.groupBy(F.col(label).alias("label"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    own = F.when(F.col("g") != 0, F.struct(F.col("n").alias("n"), (-F.col("g")).alias("g")))
    out = counts.groupBy("label").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("g") != 0, F.col("n"))), F.lit(0)).alias("some"), F.max(own).alias("top"))
    few = F.col("some") * 1000 < F.col("all") * round(nonzero * 1000)
    split = F.col("top.n") * 1000 < F.col("some") * round(match * 1000)
    return out.select("label", F.when(few | (F.col("some") == 0), 0).when(split, -1).otherwise(-F.col("top.g")).cast("long").alias("gold"))


def classify_pairs(pairs: DataFrame, mapping: DataFrame, one: str = "label_one", two: str = "label_two", rows: int | None = None) -> DataFrame:
    """`pairs` with truth: unknown if a gold id is below 1, positive if both are equal, else negative.

    With `rows`, about the number of pairs, tasks of both joins follow it and not the shuffled bytes.
    """
    deal = (lambda df, key: dealt_by_rows(df, rows, key)) if rows else lambda df, key: df
    a = mapping.select(F.col("label").alias("_a"), F.col("gold").alias("_ga"))
    b = mapping.select(F.col("label").alias("_b"), F.col("gold").alias("_gb"))
    joined = deal(pairs, one).join(deal(a, "_a"), F.col(one) == F.col("_a"), "left")
    joined = deal(joined, two).join(deal(b, "_b"), F.col(two) == F.col("_b"), "left")
    unknown = F.coalesce((F.col("_ga") < 1) | (F.col("_gb") < 1), F.lit(True))
    truth = F.when(unknown, "unknown").when(F.col("_ga") == F.col("_gb"), "positive").otherwise("negative")
    return joined.withColumn("truth", truth).drop("_a", "_ga", "_b", "_gb")


def crop_forward(df: DataFrame, geometry: Geometry) -> DataFrame:
    """`forward`: outside the half-open cropping box on any axis."""
    out = F.lit(False)
    for a, (low, high) in zip("zyx", geometry.box, strict=True):
        out = out | (F.col(a) < low) | (F.col(a) >= high)
    return df.withColumn("forward", out)


def baseline_graph(pairs: DataFrame) -> DataFrame:
    """Numbers of pairs by truth."""
    return pairs.agg(*[F.count_if(F.col("truth") == t).alias(f"n_{t}") for t in ("positive", "negative", "unknown")])


def baseline_nodes(best: DataFrame, mapping: DataFrame) -> DataFrame:
    """Small segments whose best neighbour is right or wrong by gold; unknown ones are skipped."""
    judged = classify_pairs(best, mapping, "label", "best")
    return judged.agg(F.count_if(F.col("truth") == "positive").alias("n_correct"), F.count_if(F.col("truth") == "negative").alias("n_incorrect"))
