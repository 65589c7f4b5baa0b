"""From an over-segmented volume to an agglomerated one, with every decision and the quality before and after.

    python -m jobs.agglomerate_volume --tables PATH --out PATH [--config jobs/agglomerate_volume.json]

1. Pairs of touching segments with the mean affinity of their faces, where they lie, and their truth by the gold labels.
2. Pairs of at least `least_faces` faces and an affinity above `threshold` merge; a segment's new name is the smallest that
   it reaches over merged pairs.
3. Written: OUT/edges/decision=D (merged, kept), OUT/volume/slab=S (planes in slabs of `slab`), OUT/quality/stage=S (before,
   after; variation of information and Rand error against gold).

Each table is overwritten as a whole, from the input alone: a rerun, also after a run that failed half way, gives the same
result.  Label 0 is background: it never merges and keeps its name.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.text_scorers import read_config
from lattica import fixtures
from lattica.operators import graph, metrics, truth
from lattica.plans.bricks import face_sums

log = logging.getLogger("jobs.agglomerate_volume")
VOLUME = "iv long, label long, mapped long, slab int"
EDGES = "label_one long, label_two long, n long, affinity double, z long, y long, x long, truth string, decision string"
QUALITY = "vi_merge double, vi_split double, rand_merge double, rand_split double, stage string"


def decided(voxels: DataFrame, threshold: float, least_faces: int) -> DataFrame:
    """Each pair of touching segments with affinity, place, truth and decision; one shuffle of the voxels for all sums."""
    sums = face_sums(voxels, "label", ["aff_z", "aff_y", "aff_x"]).where("label_one <> 0")
    places = [F.floor(F.col(f"s{a}") / (2 * F.col("n"))).cast("long").alias(a) for a in "zyx"]
    pairs = sums.select("label_one", "label_two", "n", (F.col("total") / (F.col("n") * 1000.0)).alias("affinity"), *places)
    found = truth.classify_pairs(pairs, truth.seg2gold(voxels))
    merge = (F.col("n") >= least_faces) & (F.col("affinity") > threshold)
    return found.withColumn("decision", F.when(merge, "merged").otherwise("kept"))


def quality(table: DataFrame, stage: str) -> DataFrame:
    """One row of figures from one contingency table."""
    both = metrics.variation_of_information(table).crossJoin(F.broadcast(metrics.rand_error(table)))  # one row each
    return both.withColumn("stage", F.lit(stage))


def run(spark: SparkSession, tables: str, out: str, config: dict) -> dict:
    """One run over the whole volume.  Returns what it counted."""
    voxels = fixtures.labels(spark, tables).select("iv", "z", "y", "x", "label", "gold", "aff_z", "aff_y", "aff_x")
    edges = decided(voxels, config["threshold"], config["least_faces"])
    edges.write.mode("overwrite").partitionBy("decision").parquet(f"{out}/edges")
    edges = spark.read.schema(EDGES).parquet(f"{out}/edges")
    merged = edges.select(F.col("label_one").alias("v1"), F.col("label_two").alias("v2"), (F.col("decision") == "merged").alias("merged"))
    roots = graph.union_edges(merged, F.col("merged"))
    slab = F.expr(f"z div {int(config['slab'])}").cast("int")
    named = graph.collapse_graph(voxels.select("iv", "label", F.col("label").alias("mapped"), slab.alias("slab")), roots, "mapped")
    named.write.mode("overwrite").partitionBy("slab").parquet(f"{out}/volume")
    # Gold labels are counted by the old names once; new names only add these counts up.
    before = metrics.contingency(voxels)
    renamed = before.join(roots.withColumnRenamed("label", "seg"), "seg", "left").withColumn("seg", F.coalesce("mapped", "seg"))
    after = renamed.groupBy("seg", "gold").agg(F.sum("n").alias("n"))
    figures = quality(before, "before").unionByName(quality(after, "after"))
    figures.write.mode("overwrite").partitionBy("stage").parquet(f"{out}/quality")
    counted = {r.decision: r["count"] for r in edges.groupBy("decision").count().collect()}
    counted["voxels"] = spark.read.schema(VOLUME).parquet(f"{out}/volume").count()
    log.info("read %d voxels from %s", counted["voxels"], tables)
    log.info("wrote %d merged and %d kept pairs, slabs and quality to %s", counted.get("merged", 0), counted.get("kept", 0), out)
    return counted


def output(spark: SparkSession, out: str) -> DataFrame:
    """Everything that a run has written, told apart by `part`."""
    parts = {"volume": VOLUME, "edges": EDGES, "quality": QUALITY}
    first, *rest = [spark.read.schema(schema).parquet(f"{out}/{name}").withColumn("part", F.lit(name)) for name, schema in parts.items()]
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "out"):
        parser.add_argument(f"--{name}", required=True, help="a path that Spark reads")
    parser.add_argument("--config", default="jobs/agglomerate_volume.json")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("agglomerate_volume").getOrCreate()
    try:
        run(spark, args.tables, args.out, read_config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
