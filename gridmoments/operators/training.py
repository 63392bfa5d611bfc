"""Standardisation, hurdle losses, decoding, metrics and a small network for presence and magnitude."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions.physics import bce_with_logits, col, finite, sigmoid
from .masks import all_finite
from .sampling import split_exactly

PHASES = ("q_liq", "q_ice")


def scaling(df: DataFrame, columns: list[str], population: bool = False) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each column; one that is zero or not finite becomes 1."""
    spread = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*(F.avg(col(c)).alias(f"m_{c}") for c in columns), *(spread(col(c)).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, s if (s := row[f"s_{c}"]) and np.isfinite(s) else 1.0) for c in columns}


def standardize(df: DataFrame, columns: list[str], population: bool = False) -> DataFrame:
    """Columns minus their means over their deviations: of a sample (features) or a population (targets)."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*(F.avg(col(c)).alias(f"_m_{c}") for c in columns), *(spread(col(c)).alias(f"_s_{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(stats))  # one row
    fix = {c: (col(c) - F.col(f"_m_{c}")) / F.when(finite(f"_s_{c}") & (F.col(f"_s_{c}") != 0), F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return wide.withColumns(fix).select(df.columns)


def split(df: DataFrame, fraction: float, keys: list[str] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """floor(fraction * n) training rows, one at least and, of several, one less than all at most, and the test rows; see split_exactly()."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    n = df.count()
    return split_exactly(df, min(n, max(1, min(math.floor(fraction * n), n - 1))), keys, seed)


def output_mapping(targets: list[str]) -> dict[str, tuple[int, int | None]]:
    """Channels of each target: the magnitude, and for phases the presence logit behind it."""
    out, at = {}, 0
    for t in targets:
        out[t] = (at, at + 1 if t in PHASES else None)
        at += 2 if t in PHASES else 1
    return out


def hurdle_loss(magnitude: str, logit: str, truth: str, present: Column) -> Column:
    """Aggregate: the mean cross-entropy of presence and, over present rows, the mean squared error of the magnitude."""
    bce = F.avg(bce_with_logits(logit, present.cast("double")))
    square = (col(magnitude) - col(truth)) * (col(magnitude) - col(truth))
    return bce + F.coalesce(F.avg(F.when(present, square)), F.lit(0.0))


def decode(magnitude: Column | str, logit: Column | str) -> Column:
    """The magnitude, not below 0, where presence is at least even; else 0."""
    return F.when(sigmoid(logit) >= 0.5, F.greatest(col(magnitude), F.lit(0.0))).otherwise(F.lit(0.0))


def target_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(target, mse, rmse, mae, r2) of (truth, prediction) columns, in one pass; r2 is NaN without variance."""
    stats = []
    for name, (truth, prediction) in sorted(pairs.items()):
        error = col(prediction) - col(truth)
        mse = F.avg(error * error)
        r2 = F.when(F.var_pop(col(truth)) > 0, 1 - mse / F.var_pop(col(truth))).otherwise(F.lit(float("nan")))
        stats.append(F.struct(F.lit(name).alias("target"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"), r2.alias("r2")))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


@dataclass
class Network:
    """Dense layers with ReLU between them and a linear output; rows are samples."""

    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def new(cls, sizes: list[int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if k + 1 < len(self.weights):
                x = np.maximum(x, 0)
            layers.append(x)
        return layers

    def gradients(self, layers: list[np.ndarray], g: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        gw, gb = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            gw.insert(0, layers[k].T @ g)
            gb.insert(0, g.sum(0))
            g = (g @ self.weights[k].T) * (layers[k] > 0)
        return gw, gb

    def save(self) -> str:
        return json.dumps({"weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]})

    @classmethod
    def load(cls, text: str) -> Network:
        d = json.loads(text)
        return cls([np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]])


def loss_sums(out: np.ndarray, y: np.ndarray, present: np.ndarray, mapping: dict[str, tuple[int, int | None]]) -> np.ndarray:
    """For each target the sums (error, its count, cross-entropy, its count) over rows; sums of parts add up to those of all."""
    sums = np.zeros((len(mapping), 4))
    for t, (m, l) in enumerate(mapping.values()):
        square = (out[:, m] - y[:, t]) ** 2
        if l is None:
            sums[t] = square.sum(), len(out), 0, 1
            continue
        z, p = out[:, l], present[:, t]
        sums[t] = square[p > 0].sum(), max(int((p > 0).sum()), 0), (np.maximum(z, 0) - z * p + np.log1p(np.exp(-np.abs(z)))).sum(), len(out)
    return sums


def loss_of(sums: np.ndarray) -> float:
    """The mean over targets of squared error and, for phases, cross-entropy of presence and squared error where present."""
    return float((sums[:, 0] / np.maximum(sums[:, 1], 1) + sums[:, 2] / np.maximum(sums[:, 3], 1)).mean())


def loss_and_gradient(out: np.ndarray, y: np.ndarray, present: np.ndarray, mapping: dict[str, tuple[int, int | None]]) -> tuple[float, np.ndarray]:
    """The loss of a batch and its gradient."""
    g, n = np.zeros_like(out), len(out)
    for t, (m, l) in enumerate(mapping.values()):
        d = out[:, m] - y[:, t]
        if l is None:
            g[:, m] = 2 * d / n
            continue
        p = present[:, t]
        g[:, l] = (0.5 * (1 + np.tanh(out[:, l] / 2)) - p) / n
        g[:, m] = 2 * d * (p > 0) / max((p > 0).sum(), 1)
    return loss_of(loss_sums(out, y, present, mapping)), g / len(mapping)


#: Training rows of a task of an epoch, about; results that one task adds up.
TASK_ROWS, FAN = 50_000, 64


class Adam:
    """A network's parameters with their moments, as one vector that tasks can send and that averages."""

    def __init__(self, sizes: list[int], state: np.ndarray, rate: float):
        self.sizes, self.rate = sizes, rate
        self.p, self.m, self.v = (a.copy() for a in state[:-1].reshape(3, -1))
        self.step = float(state[-1])

    @classmethod
    def start(cls, sizes: list[int], seed: int) -> np.ndarray:
        net = Network.new(sizes, seed)
        p = np.concatenate([a.ravel() for a in net.weights + net.biases])
        return np.concatenate([p, np.zeros(2 * len(p) + 1)])

    def network(self) -> Network:
        shapes = [*zip(self.sizes, self.sizes[1:]), *((b,) for b in self.sizes[1:])]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        arrays = [a.reshape(s) for a, s in zip(np.split(self.p, ends[:-1]), shapes)]  # views: an update of p is one of the network
        return Network(arrays[: len(self.sizes) - 1], arrays[len(self.sizes) - 1 :])

    def update(self, gw: list[np.ndarray], gb: list[np.ndarray]) -> None:
        g = np.concatenate([a.ravel() for a in gw + gb])
        self.step += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.p -= self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([self.p, self.m, self.v, [self.step]])


def matrices(batch: pa.RecordBatch, scale: dict[str, tuple[float, float]], targets: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised features, standardised targets, and which targets are present."""
    values = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    raw = np.stack([values(t) for t in targets], 1)
    return np.stack([(values(f) - m) / s for f, (m, s) in scale.items()], 1), np.stack([(raw[:, k] - m) / s for k, (m, s) in enumerate(targets.values())], 1), (raw > 0).astype(np.float64)


def added_up(parts: DataFrame) -> tuple[float, float, np.ndarray | None]:
    """(rows, skipped, average) of rows (rows, skipped, state), states weighted by their rows: FAN at a time, in rounds, so that no task and no driver meets all of them."""

    def add(t: pa.Table) -> pa.Table:
        n = t.column("rows").to_numpy()
        total = sum(k * np.frombuffer(s.as_buffer()) for k, s in zip(n, t.column("state")))
        return pa.table({"rows": [float(n.sum())], "skipped": [float(t.column("skipped").to_numpy().sum())], "state": pa.array([(total / n.sum()).tobytes()], pa.binary())})

    while (n := parts.count()) > FAN:
        groups = -(-n // FAN)
        parts = shared.written(parts.groupBy(F.pmod(F.xxhash64("rows", "state"), F.lit(groups))).applyInArrow(add, "rows double, skipped double, state binary"), "sums")
        if parts.count() == n:
            break
    left = parts.collect()
    if not left:
        return 0.0, 0.0, None
    rows = sum(r["rows"] for r in left)
    return rows, sum(r["skipped"] for r in left), sum(r["rows"] * np.frombuffer(r["state"]) for r in left) / rows


def train(df: DataFrame, features: list[str], targets: list[str], hidden: tuple[int, ...] = (64, 64, 32), epochs: int = 100, batch: int = 512, patience: int = 15, rate: float = 1e-3, seed: int = 42, fraction: float = 0.8) -> dict:
    """A network fitted on all finite rows; keeps the epoch with the least loss on all test rows.

    The rows are split exactly and written in the order of a hash. In an epoch each task, of some TASK_ROWS rows, goes on
    from the same parameters with Adam over mini-batches of its rows, in an order that the seed and the epoch set; parameters
    and moments of all tasks are then averaged, weighted by rows, in rounds of sums. A mini-batch whose loss or gradient is
    not finite is skipped. The test loss is that of all test rows at once. A table of one task's size is fitted as by one process.

    Returns network, feature and target scalings and the channel mapping, as predict() takes them, the loss, the losses of
    all epochs, and how many mini-batches were skipped.
    """
    spark, names = df.sparkSession, [*features, *targets]
    rows = df.where(all_finite(names)).select(*(col(c).alias(c) for c in names))
    train_rows, test_rows = split(rows, fraction, seed=seed)
    n = train_rows.count()
    if not n:
        raise ValueError("no finite rows to train on")
    sx, sy = scaling(rows, features), scaling(rows, targets, population=True)
    mapping = output_mapping(targets)
    tasks = -(-n // TASK_ROWS)
    order = F.xxhash64(*names, F.lit(seed))
    dealt = shared.written(train_rows.withColumn("_h", order).repartition(tasks, "_h").sortWithinPartitions("_h").drop("_h"), "training")
    test_rows = shared.written(test_rows, "test")
    sizes = [len(features), *hidden, sum(1 + (l is not None) for _, l in mapping.values())]
    state, best, kept, stale, losses, skipped = Adam.start(sizes, seed), np.inf, None, 0, [], 0.0

    def fit(epoch: int, shared_state):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            adam = Adam(sizes, shared_state.value, rate)
            net, rng, seen, bad = adam.network(), np.random.default_rng([seed, epoch]), 0, 0
            for b in batches:
                x, y, present = matrices(b, sx, sy)
                mixed = rng.permutation(len(x))
                for at in range(0, len(x), batch):
                    part = mixed[at : at + batch]
                    layers = net.forward(x[part])
                    loss, g = loss_and_gradient(layers[-1], y[part], present[part], mapping)
                    gw, gb = net.gradients(layers, g)
                    if not np.isfinite(loss) or not all(np.isfinite(d).all() for d in gw + gb):
                        bad += 1
                        continue
                    adam.update(gw, gb)
                seen += len(x)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([float(bad)]), pa.array([adam.state().tobytes()], pa.binary())], ["rows", "skipped", "state"])

        return run

    def tested(network: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = Network.load(network)
            for b in batches:
                x, y, present = matrices(b, sx, sy)
                sums = loss_sums(net.forward(x)[-1], y, present, mapping).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["place", "s"])

        return run

    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(state)
        done = shared.written(dealt.mapInArrow(fit(epoch, sent), "rows double, skipped double, state binary"), "epoch")
        _, bad, state = added_up(done)
        sent.unpersist()
        skipped += bad
        network = Adam(sizes, state, rate).network().save()
        sums = np.zeros(4 * len(mapping))
        for r in test_rows.mapInArrow(tested(network), "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
            sums[r["place"]] = r["s"]
        losses.append(loss_of(sums.reshape(-1, 4)))
        if kept is None or losses[-1] < best:
            best, kept, stale = losses[-1], network, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return {"network": kept, "features": sx, "targets": sy, "mapping": mapping, "loss": float(best), "losses": losses, "skipped": int(skipped)}


def save_run(df: DataFrame, model: dict, path: str) -> None:
    """Writes a run's artefacts: the model as JSON text, the rows with their predictions as Parquet, and the targets' metrics as CSV."""
    df.sparkSession.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    out = predict(df, model)
    out.write.mode("overwrite").parquet(f"{path}/predictions")
    out = df.sparkSession.read.parquet(f"{path}/predictions")
    metrics = target_metrics(out, {t: (t, f"pred_{t}") for t in model["targets"]}).orderBy("target")
    metrics.coalesce(1).write.mode("overwrite").csv(f"{path}/metrics", header=True)


def load_model(spark: SparkSession, path: str) -> dict:
    """The model of save_run(), as predict() takes it."""
    return json.loads(spark.read.text(f"{path}/model").first()["value"])


def predict(df: DataFrame, model: dict) -> DataFrame:
    """Adds pred_<target> in physical units: magnitudes destandardised; phases zero where presence is unlikely, never negative."""
    names, targets = list(model["features"]), list(model["targets"])
    sent = df.sparkSession.sparkContext.broadcast(model)
    form = df.schema
    for t in targets:
        form = type(form)([*form.fields]).add(f"pred_{t}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        net = Network.load(model["network"])
        for b in batches:
            x = np.stack([(b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) - model["features"][f][0]) / model["features"][f][1] for f in names], 1)
            out = net.forward(x)[-1]
            columns = []
            for t, (m, l) in model["mapping"].items():
                value = out[:, m] * model["targets"][t][1] + model["targets"][t][0]
                columns.append(pa.array(value if l is None else np.where(out[:, l] >= 0, np.maximum(value, 0), 0.0)))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(f"pred_{t}" for t in targets)])

    return df.mapInArrow(run, form)
