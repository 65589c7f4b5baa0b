"""Connected components as a DataFrame loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or what the context has.

    One is chosen here only on a local master; on a cluster a folder of one machine would be lost to the others.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/lattica"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def least_labels(u: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component."""
    names, place = np.unique(np.concatenate([u, p]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return names, names[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(links: DataFrame) -> DataFrame:
    """(u, p): links inside of each partition replaced by one from each vertex to the least that these links reach."""

    def run(batches):
        got = [b.select(["u", "p"]) for b in batches if b.num_rows]
        if got:
            v, root = least_labels(*(np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(2)))
            on = v != root
            yield pa.RecordBatch.from_arrays([pa.array(v[on]), pa.array(root[on])], names=["u", "p"])

    return links.mapInArrow(run, "u long, p long")


#: So many links (16 MB) are contracted in one task; more go in rounds until no more than these are left.
IN_ONE = 2**20
#: At most so many vertices are hubs of a round: those that hold this share of all link ends.
HUBS, LEAST_HUB = 2000, 1000


def _with_least(links: DataFrame, key: str, other: str, least: DataFrame, total: int) -> DataFrame:
    """(u, p): `other` of each link with the least vertex m of its `key`, from least(u, m, n).

    A hub of very many links would bring them all to one task.  Vertices with 2 * total / HUBS links or more
    are at most HUBS in number, so that these rows are broadcast; all other links meet theirs in a shuffle join.
    """
    bar = max(LEAST_HUB, -(-2 * total // HUBS))
    hubs = F.broadcast(least.where(F.col("n") >= bar).select(F.col("u").alias("_h"), F.col("m").alias("_m")))
    rest = least.where(F.col("n") < bar).select(F.col("u").alias("_u"), F.col("m").alias("_n"))
    own = links.select(F.col(key).alias("_k"), F.col(other).alias("_o")).join(hubs, F.col("_k") == F.col("_h"), "left")
    far = own.where("_m is null").join(rest, F.col("_k") == F.col("_u")).select(F.col("_o").alias("u"), F.col("_n").alias("p"))
    return own.where("_m is not null").select(F.col("_o").alias("u"), F.col("_m").alias("p")).unionByName(far)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) from edges (a, b): root is the smallest vertex that v reaches.

    Alternating large-star and small-star steps: every vertex hangs its larger neighbours under the smallest
    one, then its smaller ones.  First the links that lie in one partition are contracted there, and once no more than
    IN_ONE links are left, one task contracts these and no round follows.  The number of
    rounds grows with the logarithm of a component's size, each round aggregates before it shuffles, and each
    ends in a checkpoint.  Vertices are 64-bit integers; self-loops name isolated ones; null ends are ignored.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    named = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    alone = named.where("a = b").select(F.col("a").alias("v"))
    links = named.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p")).distinct()
    links = _contracted(links).checkpoint()
    state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds if state[0] else 0):
        if state[0] <= IN_ONE:
            links = _contracted(links.coalesce(1)).checkpoint()
            break
        # large star: larger neighbours u of p go under m(p)
        ends = links.select(F.col("u"), F.col("p"), F.lit(0).alias("n")).unionByName(links.select(F.col("p").alias("u"), F.col("u").alias("p"), F.lit(1).alias("n")))
        least = ends.groupBy("u").agg(F.least(F.min("p"), F.col("u")).alias("m"), F.sum("n").alias("n")).where("n > 0")
        large = _with_least(links, "p", "u", least, state[0]).distinct()
        # small star: u and its smaller neighbours go under the smallest of them
        small_least = large.groupBy("u").agg(F.min("p").alias("m"))
        hung = large.join(small_least, "u").select(F.explode(F.array("u", "p")).alias("u"), F.col("m").alias("p"))
        links = hung.where("u <> p").distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.select(F.col("u").alias("v"), F.col("p").alias("root")).unionByName(links.select(F.col("p").alias("v"), F.col("p").alias("root")))
    found = found.unionByName(alone.select("v", F.col("v").alias("root")))
    return found.groupBy("v").agg(F.min("root").alias("root"))
