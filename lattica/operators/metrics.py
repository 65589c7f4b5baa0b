"""Evaluation: contingency tables, Rand error, variation of information, curves and confusion records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import pairs, ratio


def contingency(voxels: DataFrame, masks: tuple[int, ...] = (0,), seg: str = "label", gold: str = "gold") -> DataFrame:
    """(seg, gold, n) without voxels of masked gold labels."""
    own = voxels.where(~F.col(gold).isin(list(masks))) if masks else voxels
    return own.groupBy(F.col(seg).alias("seg"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> DataFrame:
    """Rows of three kinds from one contingency table: cells (c), segments (s), gold labels (t)."""
    sums = table.groupingSets([[F.col("seg"), F.col("gold")], [F.col("seg")], [F.col("gold")]], F.col("seg"), F.col("gold")).agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    return sums.withColumn("kind", F.when(F.col("g") == 0, "c").when(F.col("g") == 1, "s").otherwise("t"))


def rand_error(table: DataFrame) -> DataFrame:
    m = _marginals(table)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, pairs(F.col("n")))), F.lit(0))
    s = m.agg(of("c").alias("tp"), of("s").alias("tp_fp"), of("t").alias("tp_fn"), F.sum(F.when(F.col("kind") == "c", F.col("n"))).alias("n"))
    every = pairs(F.col("n"))
    return s.select(F.round(ratio(F.col("tp_fp") - F.col("tp"), every), 6).alias("rand_merge"), F.round(ratio(F.col("tp_fn") - F.col("tp"), every), 6).alias("rand_split"))


def variation_of_information(table: DataFrame) -> DataFrame:
    """merge = -sum p log2(p / s) and split = -sum p log2(p / t), as entropies of the table and its marginals."""
    m = _marginals(table)
    h = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n") * F.log2(F.col("n").cast("double")))), F.lit(0.0))
    s = m.agg(h("c").alias("c"), h("s").alias("s"), h("t").alias("t"), F.sum(F.when(F.col("kind") == "c", F.col("n"))).alias("n"))
    return s.select(F.round(ratio(F.col("s") - F.col("c"), F.col("n")), 6).alias("vi_merge"), F.round(ratio(F.col("t") - F.col("c"), F.col("n")), 6).alias("vi_split"))


def prepared(voxels: DataFrame, dilate: int = 0, least: int = 0, seg: str = "label", gold: str = "gold") -> DataFrame:
    """Voxels for an evaluation: labels of both kinds with fewer than `least` voxels become 0, then gold within
    `dilate` of a boundary in its plane."""
    from lattica.operators.neighbors import dilate_gold
    from lattica.operators.voxel import remove_small

    out = remove_small(remove_small(voxels, least, seg), least, gold)
    return dilate_gold(out, dilate, gold) if dilate else out


def adapted_rand(voxels: DataFrame, seg: str = "label", gold: str = "gold", dilate: int = 0, least: int = 0) -> DataFrame:
    """Adapted Rand error, precision and recall; gold 0 is left out, seg 0 counts as single voxels.

    `dilate` and `least` are those of `prepared`.
    """
    voxels = prepared(voxels, dilate, least, seg, gold)
    table = contingency(voxels, (), seg, gold)
    n = table.agg(F.sum("n").alias("n"))
    own = table.where("gold > 0")
    sq = lambda c: F.coalesce(F.sum(F.col(c).cast("double") * F.col(c)), F.lit(0.0))
    a = own.groupBy("gold").agg(F.sum("n").alias("a")).agg(sq("a").alias("sum_a"))
    b = own.where("seg > 0").groupBy("seg").agg(F.sum("n").alias("b")).agg(sq("b").alias("sum_b"))
    ab = own.agg(F.coalesce(F.sum(F.when(F.col("seg") > 0, F.col("n").cast("double") * F.col("n"))), F.lit(0.0)).alias("sum_ab"),
                 F.coalesce(F.sum(F.when(F.col("seg") == 0, F.col("n"))), F.lit(0)).alias("c"))
    one = n.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(ab))  # one row each
    extra = ratio(F.col("c"), F.col("n"))
    one = one.withColumn("p", ratio(F.col("sum_ab") + extra, F.col("sum_b") + extra)).withColumn("r", ratio(F.col("sum_ab") + extra, F.col("sum_a")))
    return one.select(F.round(1 - ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("are"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"))


def prob2pred(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    return df.withColumn("pred", F.col(prob) > threshold)


def confusion_counts(truth, pred):
    return [F.count_if(t & p).alias(n) for n, t, p in (("tp", truth, pred), ("fp", ~truth, pred), ("fn", truth, ~pred), ("tn", ~truth, ~pred))]


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, accuracy and f1 of confusion records; null where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.withColumn("precision", F.round(ratio(tp, tp + fp), 6)).withColumn("recall", F.round(ratio(tp, tp + fn), 6))
            .withColumn("accuracy", F.round(ratio(tp + tn, tp + fp + fn + tn), 6)).withColumn("f1", F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return with_rates(df.agg(*confusion_counts(F.col(truth), F.col(pred))))


def edge_confusion(edges: DataFrame) -> DataFrame:
    """One row for the classifier and one for the partition, over edges(truth, p, cut) of known truth."""
    known = edges.where("truth <> 'unknown'")
    truth = F.col("truth") == "positive"
    both = F.explode(F.array(F.struct(F.lit("cnn").alias("method"), (F.col("p") > 0.5).alias("pred")), F.struct(F.lit("partition").alias("method"), (~F.col("cut")).alias("pred"))))
    rows = known.select(truth.alias("truth"), both.alias("m")).select("truth", "m.*")
    return with_rates(rows.groupBy("method").agg(*confusion_counts(F.col("truth"), F.col("pred"))))


def network_leaderboard(records: DataFrame) -> DataFrame:
    """The best network of each subset by F1, the first by name on ties, from (network, subset, tp, fp, fn, tn)."""
    sums = with_rates(records.groupBy("network", "subset").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))
    order = Window.partitionBy("subset").orderBy(F.desc_nulls_last("f1"), "network")
    return sums.withColumn("place", F.row_number().over(order)).where("place = 1").select("subset", "network", "tp", "fp", "fn", "tn", "f1")


def running_counts(df: DataFrame, truth: str, prob: str, ranges: int = 1024) -> DataFrame:
    """(threshold, tp, fp, pos, neg) for each distinct score from the highest.

    Scores are counted first.  Running sums have two levels: inside ranges of the score, and over ranges, so
    that no task orders all scores; scores lie between 0 and 1.
    """
    by = df.groupBy(F.col(prob).alias("threshold")).agg(F.count_if(F.col(truth)).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    by = by.withColumn("_r", F.floor(F.col("threshold") * ranges))
    inside = Window.partitionBy("_r").orderBy(F.desc("threshold"))
    sums = by.groupBy("_r").agg(F.sum("t").alias("_t"), F.sum("f").alias("_f"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select("_r", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_o{c}") for c in "tf"], F.sum("_t").over(everything).alias("pos"), F.sum("_f").over(everything).alias("neg"))
    out = by.withColumn("_st", F.sum("t").over(inside)).withColumn("_sf", F.sum("f").over(inside)).join(offsets, "_r")
    return out.select("threshold", (F.col("_st") + F.col("_ot")).alias("tp"), (F.col("_sf") + F.col("_of")).alias("fp"), "t", "f", "pos", "neg")


def pr_curve(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    r = running_counts(df, truth, prob)
    return r.select("threshold", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("pos")), 6).alias("recall"))


def average_precision(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    """Sum of precision times the gain in recall."""
    r = running_counts(df, truth, prob)
    return r.agg(F.round(F.sum(ratio(F.col("t"), F.col("pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), 6).alias("average_precision"))


def roc_curve(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    r = running_counts(df, truth, prob)
    return r.select("threshold", F.round(ratio(F.col("fp"), F.col("neg")), 6).alias("fpr"), F.round(ratio(F.col("tp"), F.col("pos")), 6).alias("tpr"))


def roc_auc(df: DataFrame, truth: str = "truth", prob: str = "prob") -> DataFrame:
    """Trapezoids between neighbouring scores: each score adds its negatives times the mean number of positives."""
    r = running_counts(df, truth, prob)
    area = F.sum(F.col("f").cast("double") * (2 * F.col("tp") - F.col("t")))
    return r.agg(area.alias("a"), F.max("pos").alias("p"), F.max("neg").alias("n")).select(F.round(ratio(F.col("a"), 2.0 * F.col("p") * F.col("n")), 6).alias("auc"))


def endpoint_grid_best(scores: DataFrame) -> DataFrame:
    """The configuration with the best F-score, the first on ties, from (config, tp, fp, fn)."""
    f = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return scores.withColumn("fscore", F.round(f, 6)).orderBy(F.desc("fscore"), "config").limit(1)
