"""Scoring candidates: a small 3-D convolutional network run in numpy, and a classifier trained by Spark.

A network is a list of layers with their weights, as plain data; `node_network` and `edge_network` lay out the two
architectures.  The engine runs a network over Arrow batches; it does not train it.  What Spark trains instead is a
logistic regression on features that a cube's counts give, from zero or (`finetune`) from another one's weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    """kind: conv (kernel [out, in, z, y, x] and bias), pool (size), flatten, dense (kernel [in, out] and bias)."""

    kind: str
    kernel: np.ndarray | None = None
    bias: np.ndarray | None = None
    size: tuple[int, int, int] = (1, 2, 2)
    activation: str = "relu"
    same: bool = False


@dataclass(frozen=True)
class Network:
    channels: int
    width: tuple[int, int, int]
    layers: list[Layer] = field(default_factory=list)


def _layers(channels: int, width, filters, pools, same: bool, seed: int, hidden: int = 512) -> list[Layer]:
    """Blocks of two 3x3x3 convolutions and a pooling, then a hidden layer and one sigmoid output; uniform first weights."""
    rng = np.random.default_rng(seed)

    def weights(shape, fan: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) * np.sqrt(6.0 / fan)

    out, size, have = [], list(width), channels
    for n, pool in zip(filters, pools, strict=True):
        for _ in range(2):
            out.append(Layer("conv", weights((n, have, 3, 3, 3), 27 * (have + n)), np.zeros(n), activation="leaky", same=same))
            size, have = [s if same else s - 2 for s in size], n
        out.append(Layer("pool", size=pool))
        size = [s // p for s, p in zip(size, pool, strict=True)]
    if min(size) < 1:
        raise ValueError(f"a cube of {tuple(width)} is too small for {len(filters)} blocks")
    flat = have * int(np.prod(size))
    return [*out, Layer("flatten"), Layer("dense", weights((flat, hidden), flat + hidden), np.zeros(hidden), activation="leaky"),
            Layer("dense", weights((hidden, 1), hidden + 1), np.zeros(1), activation="sigmoid")]


def node_network(channels: int, width, filters=(16, 32, 64), seed: int = 0, hidden: int = 512) -> Network:
    """Three or four blocks without padding; planes are pooled in the last blocks only."""
    pools = [(1, 2, 2), (1, 2, 2), (2, 2, 2), (2, 2, 2)][: len(filters)]
    return Network(channels, tuple(width), _layers(channels, width, filters, pools, False, seed, hidden))


def edge_network(channels: int, width, filters=(16, 32, 64), seed: int = 0, hidden: int = 512) -> Network:
    """Three blocks or more with padding; planes are pooled from the fourth block on."""
    pools = [(1, 2, 2)] * min(3, len(filters)) + [(2, 2, 2)] * (len(filters) - 3)
    return Network(channels, tuple(width), _layers(channels, width, filters, pools, True, seed, hidden))


def network_log(network: Network, parameters: dict) -> str:
    """A line for each layer with the shapes of its input and output, then one for each parameter."""
    x, lines = np.zeros((1, network.channels, *network.width)), []
    for k, layer in enumerate(network.layers):
        y = forward(Network(network.channels, network.width, [layer]), x)
        lines.append(f"{layer.kind}_{k + 1} {x.shape[1:]} -> {y.shape[1:]}")
        x = y
    return "\n".join([*lines, "", *(f"{k}: {v}" for k, v in parameters.items())]) + "\n"


def activate(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(x, 0)
    if kind == "leaky":
        return np.where(x > 0, x, 0.001 * x)
    return 1 / (1 + np.exp(-x)) if kind == "sigmoid" else x


def forward(network: Network, x: np.ndarray) -> np.ndarray:
    """Outputs of a batch [n, channels, z, y, x]."""
    for layer in network.layers:
        if layer.kind == "conv":
            size = layer.kernel.shape[2:]
            if layer.same:
                x = np.pad(x, [(0, 0), (0, 0), *[((s - 1) // 2, s // 2) for s in size]])
            windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=(2, 3, 4))
            x = np.einsum("nczyxabd,ocabd->nozyx", windows, layer.kernel, optimize=True) + layer.bias[None, :, None, None, None]
            x = activate(x, layer.activation)
        elif layer.kind == "pool":
            n, c = x.shape[:2]
            z, y, w = (s // p for s, p in zip(x.shape[2:], layer.size, strict=True))
            a, b, d = layer.size
            x = x[:, :, : z * a, : y * b, : w * d].reshape(n, c, z, a, y, b, w, d).max(axis=(3, 5, 7))
        elif layer.kind == "flatten":
            x = x.reshape(len(x), -1)
        else:
            x = activate(x @ layer.kernel + layer.bias, layer.activation)
    return x


def channels_of(cubes: np.ndarray, channels: int) -> np.ndarray:
    """Cubes of 0, 1 and 2 as channels of -0.5 and 0.5."""
    sets = [cubes > 0, cubes == 1, cubes == 2][:channels]
    return np.stack(sets, axis=1).astype(np.float32) - 0.5


def score_examples(examples: DataFrame, network: Network, cube: str = "cube", batch: int = 256) -> DataFrame:
    """`examples` (with an array column of cubes) and p, the network's first output."""
    from pyspark.sql.functions import pandas_udf

    shape = tuple(network.width)

    @pandas_udf("double")
    def run(cubes: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(cubes), batch):
            a = np.stack(cubes.iloc[at : at + batch].to_list()).reshape(-1, *shape)
            out.append(forward(network, channels_of(a, network.channels)).reshape(len(a), -1)[:, 0])
        return pd.Series(np.concatenate(out) if out else np.zeros(0)).astype("float64")

    return examples.withColumn("p", run(F.col(cube)))


def cube_features(examples: DataFrame, cube: str = "cube") -> DataFrame:
    """`examples` with features: shares of label one, label two and both, and how even they are."""
    size = F.size(cube).cast("double")
    share = lambda v: F.size(F.filter(cube, lambda c: c == v)) / size
    a, b = share(1), share(2)
    return examples.withColumn("features", F.array(a, b, a + b, F.least(a, b), F.abs(a - b)))


def train(examples: DataFrame, truth: str = "truth", rounds: int = 50):
    """A logistic regression on `features` of examples of known truth; not comparable with a network's figures."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = examples.where(F.col(truth).isin("positive", "negative"))
    data = known.select(array_to_vector("features").alias("features"), (F.col(truth) == "positive").cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds).fit(data)


def score_trained(examples: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(examples.withColumn("_f", F.col("features")).withColumn("features", array_to_vector("features")))
    return scored.withColumn("p", vector_to_array("probability")[1]).withColumn("features", F.col("_f")).drop("_f", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Linear:
    """Weights of features, a bias, and (epoch, loss, accuracy) of the training."""

    weights: np.ndarray
    bias: float
    losses: tuple[tuple[int, float, float], ...] = ()


def finetune(examples: DataFrame, start: Linear | None = None, epochs: int = 20, rate: float = 1.0, truth: str = "truth") -> Linear:
    """Logistic regression on `features` by full-batch gradient descent, from the weights of `start` or from zero.

    An epoch is one pass over the examples; each batch of rows gives its gradient's sum, and these sums come to the
    driver.
    """
    spark = examples.sparkSession
    data = examples.where(F.col(truth).isin("positive", "negative")).select("features", (F.col(truth) == "positive").cast("double").alias("y"))
    size = len(start.weights) if start else len(data.select("features").first()[0])
    w, losses = np.r_[start.weights, start.bias] if start else np.zeros(size + 1), list(start.losses) if start else []
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(w)

        def gradient(batches, sent=sent):
            for pdf in batches:
                x = np.column_stack([np.stack(pdf.features.to_list()), np.ones(len(pdf))])
                y, p = pdf.y.to_numpy(), 1 / (1 + np.exp(-x @ sent.value))
                loss = -(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12))).sum()
                yield pd.DataFrame({"k": range(size + 4), "v": [*((p - y) @ x), loss, float(((p > 0.5) == (y > 0.5)).sum()), float(len(y))]})

        sums = {r.k: r.v for r in data.mapInPandas(gradient, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        n = sums.get(size + 3, 0.0)
        if not n:
            break
        w = w - rate / n * np.array([sums[k] for k in range(size + 1)])
        losses.append((len(losses) + 1, sums[size + 1] / n, sums[size + 2] / n))
    return Linear(w[:-1], float(w[-1]), tuple(losses))


def loss_table(spark: SparkSession, model: Linear) -> DataFrame:
    """(epoch, loss, accuracy) of a training, for plots."""
    return spark.createDataFrame(list(model.losses), "epoch int, loss double, accuracy double")


def score_linear(examples: DataFrame, model: Linear) -> DataFrame:
    """`examples` and p by weights and bias."""
    products = F.zip_with("features", F.array(*[F.lit(float(v)) for v in model.weights]), lambda x, v: x * v)
    z = F.aggregate(products, F.lit(float(model.bias)), lambda a, x: a + x)
    return examples.withColumn("p", 1 / (1 + F.exp(-z)))


def edge_forward(scored: DataFrame) -> DataFrame:
    """The confusion record of scored candidates of known truth: a pair is called positive above 0.5."""
    from lattica.operators.metrics import confusion_matrix

    known = scored.where("truth <> 'unknown'").select((F.col("truth") == "positive").alias("truth"), (F.col("p") > 0.5).alias("pred"))
    return confusion_matrix(known)
