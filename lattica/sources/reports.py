"""Report texts: inference confusion matrices and partition results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_inference(spark: SparkSession, path) -> DataFrame:
    """(path, tp, fn, fp, tn) of fixed-layout confusion texts: the two rows that hold two numbers."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    cell = lambda row, k: F.regexp_extract("value", rf"\|\s*{row}\s*\|\s*(\d+)\s+(\d+)\s*\|", k).cast("long")
    return text.select("path", cell("Merge", 1).alias("tp"), cell("Merge", 2).alias("fn"), cell("Split", 1).alias("fp"), cell("Split", 2).alias("tn"))


def inference_text(records: DataFrame) -> DataFrame:
    """`records(tp, fn, fp, tn, ...)` with value: the text that `read_inference` reads."""
    # The layout of the report.
    form = ("Positive Examples: %d\nNegative Examples: %d\n\n+--------------+----------------+\n|                 |   Prediction   |\n+--------------+----------------+\n"
            "|              |  Merge  Split  |\n|        Merge |%7d%7d  |\n| Truth        |                |\n|        Split |%7d%7d  |\n+--------------+----------------+\n"
            "Precision: %s\nRecall: %s\nAccuracy: %s")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")).cast("string"), F.lit("NaN"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return records.withColumn("value", F.format_string(form, tp + fn, fp + tn, tp, fn, fp, tn, rate(tp, tp + fp), rate(tp, tp + fn), rate(tp + tn, tp + fn + fp + tn)))


def result_text(scores: DataFrame) -> DataFrame:
    """`scores(rand_merge, rand_split, vi_merge, vi_split, ...)` with value: six `key: value` lines."""
    lines = []
    for title, kind in (("Rand Error", "rand"), ("Variation of Information", "vi")):
        merge, split = F.col(f"{kind}_merge"), F.col(f"{kind}_split")
        lines += [F.concat(F.lit(f"{title} {n}: "), v.cast("string")) for n, v in (("Full", merge + split), ("Merge", merge), ("Split", split))]
    return scores.withColumn("value", F.concat_ws("\n", *lines))


def inference_names(reports: DataFrame) -> DataFrame:
    """`reports(path, ...)` with prefix, dataset and network, taken from the path's parts."""
    file = F.element_at(F.split("path", "/"), -1)
    parts = F.split(file, "-")
    return reports.withColumn("network", F.element_at(F.split("path", "/"), -2)).withColumn("prefix", F.concat_ws("-", F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)))).withColumn(
        "dataset", F.concat_ws("-", F.slice(parts, 3, 2)))
