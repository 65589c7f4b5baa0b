"""Which scorer tells good documents from bad ones best, in each subset of a growing corpus?

The evaluation of classifiers (confusion records, F1, ROC area, the leaderboard of a subset) for scorers of texts:

    python -m jobs.text_scorers --documents PATH --labels PATH --out PATH [--config jobs/text_scorers.json]

1. New document files are read as a file stream (available now, checkpoint in OUT/checkpoint), and each text is read once in
   its life: its scores go to OUT/scores/batch=N.  A batch that is repeated after a failure overwrites its own partition.
2. The scores of all documents that were ever read, by the labels as they are now, give OUT/report/subset=S: for each scorer
   the threshold with the best F1.  This reads narrow rows only, and so labels may come later than their documents.

A document that comes again in a later batch replaces its earlier scores.  A run without new files changes nothing but the
report of changed labels; so a rerun gives the same result.  Null text counts as empty and has score 0; rows without an id
and labels without a value are left out of the report; a null subset is the empty one; of labels that repeat an id, the
largest value counts.  Scores are whole thousandths, so a subset has 1001 thresholds at most, whatever its size.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.metrics import with_rates

log = logging.getLogger("jobs.text_scorers")
WORD = r"[^\x20\x09-\x0D]+"
SCORES = "doc_id long, subset string, scores map<string, int>, batch long"
REPORT = "network string, threshold int, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, auc double, place int, subset string"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("int")


def scorers(text: Column) -> dict[str, Column]:
    """Scores of a text from 0 to 1000; all of them see the whole text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda s: s != "")
    return {
        "words": F.least(F.size(words), F.lit(1000)),
        "letters": _share(F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(text)),
        "distinct_words": _share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


def score(documents: DataFrame, names: list[str], subset: str) -> DataFrame:
    """(doc_id, subset, scores) of each document."""
    found = scorers(F.coalesce(F.col("text"), F.lit("")))
    unknown = [n for n in names if n not in found]
    if unknown:
        raise ValueError(f"no such scorer: {', '.join(unknown)}")
    scores = F.create_map(*(x for n in names for x in (F.lit(n), found[n])))
    return documents.select("doc_id", F.coalesce(F.col(subset).cast("string"), F.lit("")).alias("subset"), scores.alias("scores"))


def current(scores: DataFrame) -> DataFrame:
    """(doc_id, subset, network, score): what the last batch says of each document."""
    last = scores.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("subset", F.map_entries("scores").alias("s")), F.struct("batch", "subset", F.map_entries("scores"))).alias("d"))
    return last.select("doc_id", "d.subset", F.explode("d.s").alias("s")).select("doc_id", "subset", F.col("s.key").alias("network"), F.col("s.value").alias("score"))


def report(scores: DataFrame, labels: DataFrame, truth: str) -> DataFrame:
    """The best threshold of each scorer (the highest on ties) with its rates, ROC area, and place in the subset.

    Documents are counted by score first; what is ordered after that has 1001 rows a scorer and subset.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(truth).isNotNull()).groupBy("doc_id").agg((F.max(truth) > 0).alias("truth"))
    by = ["subset", "network"]
    counts = current(scores).join(known, "doc_id").groupBy(*by, "score").agg(F.count_if("truth").alias("t"), F.count_if(~F.col("truth")).alias("f"))
    down, every = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
    sums = counts.select("*", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"), F.sum("t").over(every).alias("pos"), F.sum("f").over(every).alias("neg"))
    sums = sums.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp"))
    sums = sums.withColumn("exact", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    best = sums.groupBy(*by).agg(
        F.max_by(F.struct("exact", "score", "tp", "fp", "fn", "tn"), F.struct("exact", "score")).alias("b"),
        F.round(F.try_divide(F.sum(F.col("f") * (2 * F.col("tp") - F.col("t"))).cast("double"), 2.0 * F.max("pos") * F.max("neg")), 6).alias("auc"))
    rates = with_rates(best.select(*by, "b.*", "auc"))
    place = F.row_number().over(Window.partitionBy("subset").orderBy(F.desc("exact"), "network"))
    return rates.select("network", F.col("score").alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall", "f1", "auc", place.alias("place"), "subset")


def keep(rows: DataFrame, batch: int, out: str, config: dict) -> None:
    """Writes the scores of one batch in place of what an earlier try of it wrote."""
    made = score(rows, config["scorers"], config["subset"]).withColumn("batch", F.lit(batch).cast("long"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/scores")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> dict:
    """One run: takes the document files that no earlier run took, then writes the report.  Returns what it counted."""
    columns = ["doc_id", "text", config["subset"]]
    schema = spark.read.parquet(documents).select(*columns).schema
    # a file stream takes a folder, or what a pattern matches; as a pattern the path may also be a single file
    path = documents.rstrip("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")

    query = stream.writeStream.foreachBatch(lambda rows, batch: keep(rows, batch, out, config)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    counted = {"batches": sum(p["numInputRows"] > 0 for p in progress), "documents": sum(p["numInputRows"] for p in progress)}
    log.info("read %d new documents in %d batches from %s", counted["documents"], counted["batches"], documents)
    scores = spark.read.schema(SCORES).parquet(f"{out}/scores")
    made = report(scores, spark.read.parquet(labels), config["truth"])
    made.write.mode("overwrite").partitionBy("subset").parquet(f"{out}/report")
    counted["report"] = spark.read.schema(REPORT).parquet(f"{out}/report").count()
    log.info("wrote the scores of %d documents and %d rows of the report to %s", scores.count(), counted["report"], out)
    return counted


def output(spark: SparkSession, out: str) -> DataFrame:
    """Everything that the runs have written: part `score`, a row a document and scorer, and part `report`."""
    scores = current(spark.read.schema(SCORES).parquet(f"{out}/scores")).withColumn("part", F.lit("score"))
    made = spark.read.schema(REPORT).parquet(f"{out}/report")
    # the writer gives the empty subset the name of a missing one
    return scores.unionByName(made.withColumn("subset", F.coalesce("subset", F.lit(""))).withColumn("part", F.lit("report")), allowMissingColumns=True)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", required=True, help="a path that Spark reads")
    parser.add_argument("--config", default="jobs/text_scorers.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_scorers").getOrCreate()
    try:
        run(spark, args.documents, args.labels, args.out, read_config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
