"""Multicut and lifted multicut by edge contraction in rounds: no group of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import log_odds
from lattica.operators.partition import contractible_weights
from lattica.plans import tables
from lattica.plans.components import connected_components
from lattica.plans.joins import join_counted

#: Weights are whole millionths, so that sums don't depend on their order and ties are ties on every run.
UNIT = 1_000_000


def whole_weights(edges: DataFrame, beta: float = 0.95) -> DataFrame:
    """(v1, v2, weight, original) for each pair of edges (v1, v2, p): log-odds in millionths, parallel edges summed."""
    edges = edges.where("p is not null")
    own = edges.select(F.least("v1", "v2").cast("long").alias("v1"), F.greatest("v1", "v2").cast("long").alias("v2"),
                       F.round(log_odds(F.col("p"), beta) * UNIT).cast("long").alias("w"))
    return own.where("v1 <> v2").groupBy("v1", "v2").agg(F.sum("w").alias("weight")).withColumn("original", F.lit(True))


def _ends(edges: DataFrame) -> DataFrame:
    """(v, o, weight, original): each edge from both of its ends."""
    return edges.select(F.col("v1").alias("v"), F.col("v2").alias("o"), "weight", "original").unionByName(
        edges.select(F.col("v2").alias("v"), F.col("v1").alias("o"), "weight", "original"))


def _at_both(edges: DataFrame, place: DataFrame, total: int) -> DataFrame:
    """`edges` with the columns of place(v, n, ...) at both ends, as structs _1 and _2; n is the number of v's edges."""
    rest = [c for c in place.columns if c not in ("v", "n")]
    for k in (1, 2):
        table = place.select(F.col("v").alias(f"v{k}"), "n", F.struct(*rest).alias(f"_{k}"))
        edges = join_counted(edges, table, [f"v{k}"], "n", total).drop("n")
    return edges


def _members(best: DataFrame, total: int) -> DataFrame:
    """(v, star, fixed, gain, n): pairs that are each other's best, and who has one of such a pair as its best."""
    wants = best.where("best is not null").select("v", "n", (-F.col("best.o")).alias("to"), F.col("best.weight").alias("gain"))
    back = wants.select(F.col("v").alias("to"), F.col("to").alias("back"), F.col("n").alias("_n"))
    wants = join_counted(wants, back, ["to"], "_n", total).drop("_n")
    pairs = wants.where("back = v").select("v", F.least("v", "to").alias("star"), F.lit(True).alias("fixed"), "gain", "n")
    centres = pairs.select(F.col("v").alias("to"), "star", F.col("n").alias("_n"))
    joiners = join_counted(wants.where("back <> v"), centres, ["to"], "_n", total)
    return pairs.unionByName(joiners.select("v", "star", F.lit(False).alias("fixed"), "gain", "n"))


def contract_in_rounds(weights: DataFrame) -> DataFrame:
    """(v, root) of contracted vertices from (v1, v2, weight, original), each pair once: root is the smallest vertex of the part.

    In each round every vertex looks at its heaviest positive original edge, ties going to the smaller neighbour.  Two
    vertices that choose each other become one, and vertices that choose one of the two go with them, in any number, so that
    a hub takes all of its neighbours at once.  One waits for the next round where it has a negative edge to the pair, or to another
    that goes along and has more to gain (then the smaller vertex); without such edges these contractions
    don't change each other's weights.  Then parallel edges are summed.  The rounds end when no original edge is positive; the
    heaviest edge's ends always choose each other, so each round contracts.

    Contraction one by one takes the heaviest edge of all, so it can differ where a sum that is made on the way outweighs
    an edge that was contracted here in the same round; the result is a partition without a positive original edge between
    parts in both cases.  Pairs with only `original` false weigh in and are not contracted alone.

    Edges of a vertex without any positive edge stay cut and leave the state.  Hubs meet their edges by a join that
    broadcasts a bounded number of hot keys.
    """
    state = tables.written(weights.where("v1 <> v2").select("v1", "v2", "weight", "original"), "contraction")
    steps = []
    while True:
        n, positive = state.agg(F.count("*"), F.count_if(F.col("original") & (F.col("weight") > 0))).first()
        if not positive:
            break
        total = 2 * n
        chosen = F.when(F.col("original") & (F.col("weight") > 0), F.struct("weight", (-F.col("o")).alias("o")))
        best = _ends(state).groupBy("v").agg(F.max(chosen).alias("best"), (F.max("weight") > 0).alias("alive"), F.count("*").alias("n"))
        best = tables.written(best, "contraction")
        members = tables.written(_members(best, total), "contraction")
        # The one that gains less waits; the two of a pair never do.
        rank = members.select("v", "n", "star", F.struct("fixed", "gain", (-F.col("v")).alias("o")).alias("rank"))
        apart = _at_both(state.where("weight < 0"), rank, total).where("_1.star = _2.star")
        waits = apart.select(F.when(F.col("_1.rank") < F.col("_2.rank"), F.col("v1")).otherwise(F.col("v2")).alias("v")).distinct()
        step = tables.written(members.join(waits, "v", "left_anti").where("v <> star").select("v", "star"), "contraction")
        steps.append(step)
        place = best.join(step, "v", "left").where("alive").select("v", "n", F.coalesce("star", "v").alias("to"))
        moved = _at_both(state.select("v1", "v2", "weight", "original"), place, total).where("_1.to <> _2.to")
        moved = moved.select(F.least("_1.to", "_2.to").alias("v1"), F.greatest("_1.to", "_2.to").alias("v2"), "weight", "original")
        after = tables.written(moved.groupBy("v1", "v2").agg(F.sum("weight").alias("weight"), F.bool_or("original").alias("original")), "contraction")
        tables.discard(best, members, state)
        state = after
    spark = weights.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    for step in steps:
        links = links.unionByName(step.select(F.col("v").alias("a"), F.col("star").alias("b")))
    roots = tables.written(connected_components(links), "contraction")
    tables.discard(state, *steps)
    return roots


def cuts(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(v1, v2, cut) of each pair: whether its ends have different roots; vertices without one are their own."""
    ends = pairs.select(F.col("v1").alias("v")).unionByName(pairs.select(F.col("v2").alias("v"))).groupBy("v").agg(F.count("*").alias("n"))
    place = tables.written(ends.join(roots, "v", "left").select("v", "n", F.coalesce("root", "v").alias("root")), "cuts")
    total = place.agg(F.sum("n")).first()[0] or 0
    return _at_both(pairs.select("v1", "v2"), place, total).select("v1", "v2", (F.col("_1.root") != F.col("_2.root")).alias("cut"))


def multicut_in_rounds(edges: DataFrame, beta: float = 0.95) -> DataFrame:
    """(v1, v2, cut) for each pair of edges (v1, v2, p), null probabilities left out."""
    weights = tables.written(whole_weights(edges, beta), "multicut")
    return cuts(weights, contract_in_rounds(weights))


def lifted_multicut_in_rounds(edges: DataFrame, n_vertices: int | None = None, beta: float = 0.95) -> DataFrame:
    """(v1, v2, cut) for pairs with an edge; lifted pairs weigh in, but only edges are contracted."""
    own, original = contractible_weights(edges, n_vertices, beta)
    weights = tables.written(own.withColumn("weight", F.round(F.col("weight") * UNIT).cast("decimal(38,0)")), "multicut")
    return cuts(original, contract_in_rounds(weights))


def partition_weight(weights: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (cut, joined) of weights (v1, v2, weight) that a partition (v1, v2, cut) cuts and leaves; a multicut has the least that is cut."""
    both = weights.join(partition, ["v1", "v2"])
    return both.agg(*[F.coalesce(F.sum(F.when(on, F.col("weight"))), F.lit(0)).alias(name) for on, name in ((F.col("cut"), "cut"), (~F.col("cut"), "joined"))])
