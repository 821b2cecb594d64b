"""Neural NARX: a small network over the lags, trained on all rows at once.

In a round the weights are sent to the tasks, each of which runs its rows forward and back in NumPy, and the gradients
are added up by Spark; the driver takes one step (Adam).  What moves is one vector of the network's size a task,
whatever the data.  Rows of a validation part give the loss that decides which weights are kept and when to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Computed, Term, max_lag
from ..sources.scratch import materialize
from . import predict
from .lagging import lagged

#: Activations, and their derivatives from their values.
ACTIVATIONS = {
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
}
#: Rows run through the network at a time.
STEP = 4096


@dataclass(frozen=True)
class Network:
    """Layer sizes, activation of the hidden layers and how inputs and output are scaled."""

    sizes: tuple[int, ...]
    activation: str
    centre: np.ndarray
    width: np.ndarray
    y_centre: float = 0.0
    y_width: float = 1.0

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes[:-1], self.sizes[1:]))

    def layers(self, weights: np.ndarray) -> list[np.ndarray]:
        """(inputs + 1, outputs) matrices, the last row the constants."""
        out, at = [], 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:]):
            out.append(weights[at : at + (a + 1) * b].reshape(a + 1, b))
            at += (a + 1) * b
        return out

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights that keep the spread of a layer's values; constants 0."""
        rng, out = np.random.default_rng(seed), []
        for a, b in zip(self.sizes[:-1], self.sizes[1:]):
            edge = np.sqrt(6 / (a + b))
            out.append(np.vstack([rng.uniform(-edge, edge, (a, b)), np.zeros((1, b))]).ravel())
        return np.concatenate(out)

    def forward(self, weights: np.ndarray, lags: np.ndarray) -> list[np.ndarray]:
        """Values of every layer, the scaled inputs first and the scaled output last."""
        f = ACTIVATIONS[self.activation][0]
        values = [(lags - self.centre) / self.width]
        layers = self.layers(weights)
        for i, w in enumerate(layers):
            z = values[-1] @ w[:-1] + w[-1]
            values.append(f(z) if i + 1 < len(layers) else z)
        return values

    def outputs(self, weights: np.ndarray, lags: np.ndarray) -> np.ndarray:
        return self.forward(weights, lags)[-1][:, 0] * self.y_width + self.y_centre

    def gradient(self, weights: np.ndarray, lags: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """(gradient, value) of the summed squares of the scaled errors."""
        slope = ACTIVATIONS[self.activation][1]
        values, layers = self.forward(weights, lags), self.layers(weights)
        error = values[-1][:, 0] - (y - self.y_centre) / self.y_width
        back, parts = 2 * error[:, None], []
        for i in range(len(layers) - 1, -1, -1):
            parts.append(np.vstack([values[i].T @ back, back.sum(0)[None]]).ravel())
            if i:
                back = (back @ layers[i][:-1].T) * slope(values[i])
        return np.concatenate(parts[::-1]), float(error @ error)


@dataclass(frozen=True)
class NeuralModel:
    """A trained network: predicts like any model, its one term computed from the lags."""

    columns: list[str]
    network: Network
    weights: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    @property
    def terms(self) -> list[Term]:
        network, weights = self.network, self.weights
        return [("network", Computed(lambda lags: network.outputs(weights, lags)[:, None], tuple(self.columns), 0, 1))]

    def predict(self, series: DataFrame, steps_ahead: int | None = None) -> DataFrame:
        """(series_id, k, y, yhat): 1 step, blocks of several, or a free run (None)."""
        if steps_ahead == 1 or not any(c.startswith("y_") for c in self.columns):
            return predict.one_step(series, self.columns, self.terms, [1.0])
        return predict.n_steps(series, self.columns, self.terms, [1.0], steps_ahead)

    def forecast(self, series: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        return predict.forecast(series, self.columns, self.terms, [1.0], horizon, future=future)


def summed(rows: DataFrame, columns: list[str], network: Network, weights: np.ndarray, learn: bool) -> tuple[np.ndarray, float, int]:
    """(gradient, summed squares, rows) over rows (y, lags), in scaled units; without ``learn`` the gradient is 0."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, w = np.zeros(network.size + 2), shared.value
        for batch in batches:
            lags = np.column_stack([np.asarray(batch[c], float) for c in columns])
            y = np.asarray(batch["y"], float)
            for a in range(0, len(y), STEP):
                if learn:
                    g, loss = network.gradient(w, lags[a : a + STEP], y[a : a + STEP])
                    total[:-2] += g
                else:
                    e = (network.outputs(w, lags[a : a + STEP]) - y[a : a + STEP]) / network.y_width
                    loss = e @ e
                total[-2:] += (loss, len(y[a : a + STEP]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table([pa.array([sum(np.frombuffer(v) for v in group["v"].to_pylist()).tobytes()], pa.binary())], ["v"])

    found = rows.mapInArrow(run, "v binary").groupBy().applyInArrow(add, "v binary").collect()
    total = np.frombuffer(found[0]["v"]) if found else np.zeros(network.size + 2)
    return total[:-2], float(total[-2]), int(total[-1])


def train(series: DataFrame, columns: list[str], valid: DataFrame | None = None, hidden: tuple[int, ...] = (10,), activation: str = "tanh", rounds: int = 200, rate: float = 0.02, patience: int = 20, decay: float = 0.0, seed: int = 0, bucket: int | None = None) -> NeuralModel:
    """Fit y to the lag ``columns`` of all series; ``valid`` (default: the training rows) decides which round's weights are kept and ends the training after
    ``patience`` rounds without a gain.

    Inputs and output are scaled with the means and deviations of the training rows.  ``decay`` is a penalty on the squared weights, relative to the mean squared error.
    """
    if activation not in ACTIVATIONS or not columns or rounds < 1 or any(h < 1 for h in hidden):
        raise ValueError("unknown activation, or no lags, rounds or hidden units")
    sides = [lagged(s, columns, bucket).where(F.col("k") > max_lag(columns)).select(F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in columns)) for s in (series, valid) if s is not None]
    sides = [materialize(s, "network-rows").persist() for s in sides]
    try:
        stats = sides[0].agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("y", *columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        if not stats["n"]:
            raise ValueError("no row beyond the lags")
        wide = lambda c: stats[f"s_{c}"] or 1.0
        network = Network((len(columns), *hidden, 1), activation, np.array([stats[f"m_{c}"] for c in columns]), np.array([wide(c) for c in columns]), stats["m_y"], wide("y"))
        if not np.isfinite([*network.centre, *network.width, network.y_centre, network.y_width]).all():
            raise ValueError("values must be finite")
        weights = network.start(seed)
        best, least, since, history = weights, np.inf, 0, []
        mean, square = np.zeros(network.size), np.zeros(network.size)
        for t in range(1, rounds + 1):
            g, loss, n = summed(sides[0], columns, network, weights, True)
            if len(sides) > 1:
                _, held, n_held = summed(sides[1], columns, network, weights, False)
                held /= max(1, n_held)
            else:
                held = loss / n
            history.append((loss / n, held))
            if held < least:
                best, least, since = weights, held, 0
            else:
                since += 1
                if since >= patience:
                    break
            g = g / n + 2 * decay * weights
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            weights = weights - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        return NeuralModel(list(columns), network, best, history)
    finally:
        for s in sides:
            s.unpersist()
