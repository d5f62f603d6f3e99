"""Feed-forward networks trained data-parallel.

Rows are stored once as blocks.  In every epoch, one Spark job, each task starts from the shared weights, takes the mini-batches of its
blocks in a seeded order, and the weights and optimizer moments of all tasks are averaged by rows.  A block holds ``BLOCK_ROWS``
rows and a task at least one block, so a table of one block is plain mini-batch descent.  Hidden layers may drop units;
several heads (regression, two classes or more) can share them.  Validation rows are scored with the shared weights at the start of each epoch.

Regression targets are standardised inside and given back in their own units.  Inputs are taken as they are: scale them before.
Batch normalisation is not offered: its running statistics belong to one process.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.columns import SEED
from tabspark.session import shared_scratch

BLOCK_ROWS = 8_192
KINDS = ("squared", "logistic", "softmax")
ACTIVATIONS = ("relu", "elu", "gelu", "tanh")
OPTIMIZERS = ("adam", "adamw", "sgd")
_C = 0.7978845608028654  # sqrt(2 / pi)


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (64, 32)
    activation: str = "relu"
    dropout: float = 0.1
    optimizer: str = "adam"
    learning_rate: float = 0.01
    weight_decay: float = 0.001
    epochs: int = 100
    batch_size: int = 32
    early_stopping_rounds: int | None = None
    seed: int = SEED

    def __post_init__(self):
        if self.activation not in ACTIVATIONS or self.optimizer not in OPTIMIZERS:
            raise ValueError(f"activation is one of {ACTIVATIONS}, optimizer one of {OPTIMIZERS}")
        if not 0 <= self.dropout < 1 or self.batch_size < 1 or any(h < 1 for h in self.hidden):
            raise ValueError("dropout lies in [0, 1), batch_size and layers are positive")


@dataclass(frozen=True)
class Head:
    kind: str
    size: int  # outputs: 1 for regression and two classes


def activate(z: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope."""
    if kind == "relu":
        return np.maximum(z, 0), (z > 0).astype(float)
    if kind == "tanh":
        t = np.tanh(z)
        return t, 1 - t * t
    if kind == "elu":
        e = np.exp(np.minimum(z, 0))
        return np.where(z > 0, z, e - 1), np.where(z > 0, 1.0, e)
    t = np.tanh(_C * (z + 0.044715 * z**3))
    return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * _C * (1 + 3 * 0.044715 * z * z)


class Network:
    """Weights of all layers in one vector; the heads are one last layer side by side."""

    def __init__(self, n_inputs: int, heads: Sequence[Head], hidden: Sequence[int], activation: str):
        self.heads, self.activation = list(heads), activation
        self.sizes = [n_inputs, *hidden, sum(h.size for h in heads)]
        self.length = sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        rng, parts = np.random.default_rng(seed % (1 << 31)), []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = 1 / np.sqrt(max(a, 1))
            parts.append(rng.uniform(-bound, bound, (a + 1) * b))
        return np.concatenate(parts)

    def layers(self, w: np.ndarray):
        at = 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            yield w[at : at + a * b].reshape(a, b), w[at + a * b : at + (a + 1) * b]
            at += (a + 1) * b

    def outputs(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        layers = list(self.layers(w))
        for m, b in layers[:-1]:
            x = activate(x @ m + b, self.activation)[0]
        return x @ layers[-1][0] + layers[-1][1]

    def loss(self, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each row (heads added up) and its slope by output; ``y`` has a column per head."""
        total, slope, at = np.zeros(len(out)), np.zeros_like(out), 0
        for j, h in enumerate(self.heads):
            o, t = out[:, at : at + h.size], y[:, j]
            if h.kind == "squared":
                total += (o[:, 0] - t) ** 2
                slope[:, at] = 2 * (o[:, 0] - t)
            elif h.kind == "logistic":
                total += np.logaddexp(0, np.where(t > 0, -o[:, 0], o[:, 0]))
                slope[:, at] = 1 / (1 + np.exp(-o[:, 0])) - t
            else:
                p = np.exp(o - o.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                k = t.astype(int)
                total += -np.log(np.maximum(p[np.arange(len(p)), k], 1e-300))
                p[np.arange(len(p)), k] -= 1
                slope[:, at : at + h.size] = p
            at += h.size
        return total, slope

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Mean loss of a batch and its gradient by backpropagation."""
        layers, seen, slopes = list(self.layers(w)), [x], []
        for m, b in layers[:-1]:
            value, slope = activate(seen[-1] @ m + b, self.activation)
            if dropout > 0 and rng is not None:
                keep = (rng.random(value.shape) >= dropout) / (1 - dropout)
                value, slope = value * keep, slope * keep
            seen.append(value)
            slopes.append(slope)
        loss, delta = self.loss(seen[-1] @ layers[-1][0] + layers[-1][1], y)
        delta = delta / len(x)
        parts = []
        for i in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(seen[i].T @ delta).ravel(), delta.sum(axis=0)]))
            if i:
                delta = (delta @ layers[i][0].T) * slopes[i - 1]
        return float(loss.mean()), np.concatenate(parts[::-1])


def descend(s: Settings, w, m, v, step: int, g: np.ndarray):
    """One optimizer step: new weights and moments."""
    if s.optimizer == "sgd":
        return w - s.learning_rate * (g + s.weight_decay * w), m, v
    if s.optimizer == "adam":
        g = g + s.weight_decay * w
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if s.optimizer == "adamw":
        change = change + s.weight_decay * w
    return w - s.learning_rate * change, m, v


def _blocks(df: DataFrame, wide: int, heads: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                held = part.column("held").to_numpy(zero_copy_only=False)
                for mark in (False, True):
                    rows = pa.Table.from_batches([part]).filter(pa.array(held == mark))
                    if rows.num_rows:
                        x, y = (np.array(rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), float) for c in ("x", "y"))
                        yield pa.RecordBatch.from_pydict({"held": pa.array([mark]), "n": pa.array([rows.num_rows], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())})

    path = f"{shared_scratch(df.sparkSession)}/blocks.parquet"
    df.mapInArrow(run, "held boolean, n bigint, x binary, y binary").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _epoch(net: Network, s: Settings, state, step: int, epoch: int, wide: int, centre: np.ndarray, scale: np.ndarray, learn: bool):
    """slot, w, m, v, n: a task's weights and moments after its mini-batches, times its rows; slots below 0 are loss sums."""
    def run(batches):
        w0, m, v = state
        w, k, n, sums = w0, step, 0, np.zeros(4)
        for batch in batches:
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["x"]).reshape(-1, wide), (np.frombuffer(r["y"]).reshape(-1, len(net.heads)) - centre) / scale
                if r["held"]:
                    sums[2:] += [net.loss(net.outputs(w0, x), y)[0].sum(), len(x)]
                    continue
                if not learn:
                    continue
                rng = np.random.default_rng([s.seed % (1 << 31), epoch, len(x), int(abs(x.sum()) * 1e6) % (1 << 31)])
                order = rng.permutation(len(x))
                for i in range(0, len(x), s.batch_size):
                    rows = order[i : i + s.batch_size]
                    k += 1
                    loss, g = net.gradient(w, x[rows], y[rows], s.dropout, rng)
                    w, m, v = descend(s, w, m, v, k, g)
                    sums[:2] += [loss * len(rows), len(rows)]
                n += len(x)
        slots = np.concatenate([np.arange(len(w)), -1 - np.arange(4), [-5]]) if n else np.concatenate([-1 - np.arange(4)])
        extra = np.concatenate([sums, [float(k - step)]]) if n else sums
        ones = np.full(len(slots), float(n))
        body = [np.concatenate([a * n, extra]) if n else extra for a in (w, m, v)]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots.astype(np.int64)), "w": pa.array(body[0]), "m": pa.array(body[1]), "v": pa.array(body[2]), "n": pa.array(ones)})

    return run


def outputs_of(facts: Mapping, x: np.ndarray) -> np.ndarray:
    """Outputs of all heads of a fitted network side by side; regression in units of the target."""
    net = Network(facts["n_inputs"], [Head(**h) for h in facts["heads"]], facts["settings"]["hidden"], facts["settings"]["activation"])
    out, at = net.outputs(np.asarray(facts["weights"]), x), 0
    for h, c, s in zip(facts["heads"], facts["centre"], facts["scale"]):
        if h["kind"] == "squared":
            out[:, at] = out[:, at] * s + c
        at += h["size"]
    return out


class PerceptronModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted network as a pipeline stage."""

    def __init__(self):
        super().__init__()
        self.state = Param(self, "state", "weights and shape as JSON", typeConverter=TypeConverters.toString)

    @property
    def facts(self) -> dict:
        if not hasattr(self, "_facts"):
            self._facts = json.loads(self.getOrDefault(self.state))
        return self._facts

    @property
    def losses(self) -> list[tuple[float, float | None]]:
        """Training loss (while learning) and validation loss after each epoch."""
        return [tuple(x) for x in self.facts["losses"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        facts = self.facts

        @F.pandas_udf("array<double>")
        def raw_outputs(x: pd.Series) -> pd.Series:
            return pd.Series(list(outputs_of(facts, np.stack(x.to_numpy())) if len(x) else np.zeros((0, 1))))

        out = dataset.withColumn("rawPrediction", raw_outputs(vector_to_array("__features")))
        raw, head = F.col("rawPrediction"), facts["heads"][0]  # prediction columns are those of the first head
        if head["kind"] == "squared":
            return out.withColumn("prediction", raw[0])
        if head["kind"] == "logistic":
            one = 1 / (1 + F.exp(-raw[0]))
            return out.withColumn("probability", F.array(1 - one, one)).withColumn("prediction", F.when(raw[0] >= 0, 1.0).otherwise(0.0))
        mine = F.slice(raw, 1, head["size"])
        top = F.array_max(mine)
        odds = F.transform(mine, lambda m: F.exp(m - top))
        out = out.withColumn("probability", F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)))
        return out.withColumn("prediction", (F.array_position(mine, top) - 1).cast("double"))

    @classmethod
    def of(cls, facts: dict) -> PerceptronModel:
        out = cls()
        out._set(state=json.dumps(facts))
        return out


def fit(train: DataFrame, names: Sequence[str], heads: Mapping[str, Head], settings: Settings, held: DataFrame | None = None) -> PerceptronModel:
    """Fit on columns ``names``; ``heads`` maps label columns (class numbers from 0, or values) to their outputs.

    Rows without one of the labels are left out.  With ``held`` rows and ``early_stopping_rounds`` the weights of the best epoch are kept.
    """
    if any(h.kind not in KINDS or h.size < 1 for h in heads.values()):
        raise ValueError(f"a head is one of {KINDS} with at least one output")
    wide, labels = len(names), list(heads)

    def shaped(df, mark):
        rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), F.lit(mark).alias("held"))
        return rows.where(~F.exists("y", lambda v: v.isNull()))

    rows = shaped(train, False)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("y")[j]).alias(f"c{j}") for j in range(len(labels))], *[F.stddev_pop(F.col("y")[j]).alias(f"s{j}") for j in range(len(labels))]).first()
    if not facts["n"]:
        raise ValueError("no training rows with a label")
    plain = [heads[c].kind == "squared" for c in labels]
    centre = np.array([facts[f"c{j}"] if p else 0.0 for j, p in enumerate(plain)])
    scale = np.array([(facts[f"s{j}"] or 1.0) if p else 1.0 for j, p in enumerate(plain)])
    both = rows if held is None else rows.unionByName(shaped(held, True))
    spread = both.repartition(max(1, -(-facts["n"] // BLOCK_ROWS)), F.xxhash64("x", "y"))
    blocks = _blocks(spread.sortWithinPartitions("x", "y"), wide, len(labels))
    s, net = settings, Network(wide, list(heads.values()), settings.hidden, settings.activation)
    w = net.start(s.seed)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    best, losses, kept = (np.inf, 0), [], w  # losses: training and validation after each epoch
    for epoch in range(s.epochs + 1):
        learn = epoch < s.epochs
        if not learn and held is None:
            break
        job = blocks.mapInArrow(_epoch(net, s, (w, m, v), step, epoch, wide, centre, scale, learn), "slot bigint, w double, m double, v double, n double")
        found = job.groupBy("slot").agg(F.sum("w").alias("w"), F.sum("m").alias("m"), F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("w").alias("most")).toArrow().sort_by("slot")  # as many rows as weights
        at = found.column("slot").to_numpy()
        sums = {int(-1 - k): found.column("w")[int(i)].as_py() for i, k in enumerate(at) if k < 0}
        if epoch:
            value = sums[2] / sums[3] if sums[3] else None
            losses[-1] = (losses[-1][0], value)
            if value is not None and value < best[0]:
                best, kept = (value, epoch), w
            if value is not None and s.early_stopping_rounds and epoch - best[1] >= s.early_stopping_rounds:
                break
        if learn:
            own = at >= 0
            n = found.column("n").to_numpy()[own]
            w, m, v = (found.column(c).to_numpy()[own] / n for c in ("w", "m", "v"))
            step += int(found.column("most")[int(np.flatnonzero(at == -5)[0])].as_py())
            losses.append((sums[0] / sums[1], None))
    if not (held is not None and s.early_stopping_rounds and losses and losses[0][1] is not None):
        kept = w
    return PerceptronModel.of({"n_inputs": wide, "heads": [asdict(h) for h in heads.values()], "settings": asdict(s), "weights": kept.tolist(), "centre": centre.tolist(), "scale": scale.tolist(), "losses": losses})
