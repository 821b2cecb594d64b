"""Binary swarm search over subsets of terms, its agents scored where the data lies.

The optimiser moves bit strings by gravity between agents (heavier ones score better) and towards the
best found so far.  An agent's terms are fitted from the Gram matrix of the training part, those
without significance go.  The agents' coefficients, a small matrix, are then sent to the tasks, each of which keeps the validation part of its series
between the rounds and runs all agents along it together; a few sums an agent come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basis import Term, max_lag
from ..functions.compiled import design
from ..functions.numerics import t_tail
from ..sources.scratch import materialize
from .estimate import least_squares
from .gram import Gram, gram
from .lagging import lagged

EPS = float(np.finfo(float).eps)


@dataclass
class Swarm:
    """Minimises ``objective``, which scores the rows of a 0/1 matrix and may change them."""

    dimension: int
    agents: int = 10
    rounds: int = 30
    g_zero: float = 100.0
    alpha: float = 23.0
    last_share: float = 2.0
    norm: float = -2
    power: float = 2.0
    ones: float = 0.5
    seed: int = 0
    best: np.ndarray | None = None
    best_value: float = math.inf
    history: list[float] = field(default_factory=list)

    def _masses(self, value: np.ndarray) -> np.ndarray:
        finite = np.isfinite(value)
        worst = value[finite].max()
        value = np.where(finite, value, worst + max(abs(worst), 1.0))
        low, high = value.min(), value.max()
        mass = np.ones(len(value)) if low == high else (high - value) / (high - low)
        return 5 * mass / mass.sum()

    def _pull(self, x: np.ndarray, mass: np.ndarray, at: int, rng: np.random.Generator) -> np.ndarray:
        share = self.last_share + (1 - at / self.rounds) * (100 - self.last_share)
        near = np.argsort(-mass, kind="stable")[: round(self.agents * share / 100)]
        force = np.zeros(x.shape)
        with np.errstate(divide="ignore"):
            for i in range(self.agents):
                for j in near[near != i]:
                    distance = np.linalg.norm(x[i] - x[j], self.norm)
                    force[i] += rng.random(self.dimension) * mass[j] * (x[j] - x[i]) / (distance**self.power + EPS)
        return force * self.g_zero * math.exp(-self.alpha * (at + 1) / self.rounds)

    def run(self, objective: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Swarm:
        """Search; ``objective(x)`` returns (values, x as scored)."""
        rng = np.random.default_rng(self.seed)
        x = (rng.random((self.agents, self.dimension)) < self.ones).astype(np.int8)
        speed = np.zeros(x.shape)
        for at in range(self.rounds):
            value, x = objective(x)
            if not np.isfinite(value).any():
                raise ValueError("no agent has a finite value")
            i = int(np.argmin(np.where(np.isfinite(value), value, np.inf)))
            if self.best is None or value[i] < self.best_value:
                self.best, self.best_value = x[i].copy(), float(value[i])
            self.history.append(self.best_value)
            pull = self._pull(x.astype(float), self._masses(value), at, rng)
            late = (at / self.rounds) ** 3
            speed = rng.random(x.shape) * speed + (2 - 2 * late) * pull + (2 + 2 * late) * (self.best - x)
            x = np.where(rng.random(x.shape) < np.abs(np.tanh(speed)), 1 - x, x).astype(np.int8)
        return self


def t_test(q: Gram, theta: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of every coefficient of a least-squares fit; all 0 without degrees of freedom or full rank."""
    m = len(theta)
    scale = np.sqrt(np.where(np.diag(q.g) > 0, np.diag(q.g), 1.0))
    unit = q.g / np.outer(scale, scale)
    if q.n <= m or np.linalg.matrix_rank(unit, tol=1e-12 * m, hermitian=True) < m:
        return np.zeros(m)
    variance = max(q.sse(theta), float(np.finfo(float).tiny)) / (q.n - m)
    error = np.sqrt(variance * np.maximum(np.diag(np.linalg.inv(unit)), 0)) / scale
    return np.array([t_tail(abs(t) / e, q.n - m) if e > 0 else 0.0 for t, e in zip(theta, error)])


def swarm_loss(miss: float, spread: float, n: float, n_terms: int, dimension: int) -> float:
    """RRSE times a penalty that grows with the number of terms; 30 where that is not finite."""
    steep = 1 / math.log(n_terms + 1) / dimension
    u = steep * (np.arange(dimension + 1) - dimension / 2)
    sigmoid = 1 / (1 + np.exp(-u))
    penalty = sigmoid * (1 + u * (1 - sigmoid))
    penalty = penalty - penalty.min()
    with np.errstate(all="ignore"):
        ratio = math.sqrt(miss / spread) if spread > 0 and math.isfinite(miss) else (0.0 if miss == 0 else math.inf)
        out = ratio * penalty[min(n_terms, dimension)]
    return float(out) if np.isfinite(out) else 30.0


def _criterion(miss: float, n: float, n_terms: int, weight: float) -> float:
    mse = max(miss / n, EPS) if n and math.isfinite(miss) else math.inf
    return n * math.log(mse) + weight * n_terms if math.isfinite(mse) else math.inf


#: Loss of a fit from its summed squares, those of y about the means of its series, the samples, the terms and the candidates.
LOSSES: dict[str, Callable] = {
    "swarm": swarm_loss,
    "aic": lambda miss, spread, n, n_terms, dimension: _criterion(miss, n, n_terms, 2),
    "bic": lambda miss, spread, n, n_terms, dimension: _criterion(miss, n, n_terms, math.log(n) if n else 0.0),
}


def _turns(series: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups that hold a series once at most: the first row of every series, the second, and so on."""
    order = np.argsort(series, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(series[order]) != 0]) if len(series) else np.zeros(0, np.int64)
    turn = np.empty(len(series), np.int64)
    turn[order] = np.arange(len(series)) - np.repeat(first, np.diff(np.r_[first, len(series)]))
    if len(series):
        yield from np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1])


def simulated(rows: DataFrame, columns: list[str], terms: list[Term], theta: np.ndarray) -> np.ndarray:
    """Summed squares of each row of coefficients, run freely over all series of rows (series_id, k, y, input lags): each series from its first max_lag
    outputs on, the coefficients all together.  Not finite once a run has run away.

    Rows come dealt by series, those of a series by k.  The next samples of all series at hand are computed together, so that a task does best where rows are sorted by
    their place in the series first; it keeps the last outputs of its series only.
    """
    p = max_lag(columns)
    outputs = [int(c[2:]) for c in columns if c.startswith("y_")]
    inputs = [c for c in columns if not c.startswith("y_")]
    shared = rows.sparkSession.sparkContext.broadcast(theta)  # agents by candidates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        build, agents = design(terms, columns), len(weights)
        at_y, at_x = [columns.index(f"y_{i}") for i in outputs], [columns.index(c) for c in inputs]
        miss, places = np.zeros(agents), {}
        h, seen = np.zeros((64, agents, p)), np.zeros(64, np.int64)
        with np.errstate(all="ignore"):
            for batch in batches:
                y = np.asarray(batch["y"], float)
                x = np.column_stack([np.asarray(batch[c], float) for c in inputs]) if inputs else np.zeros((len(y), 0))
                coded = batch["series_id"].dictionary_encode()
                names = [*coded.dictionary.to_pylist(), None]
                place = np.array([places.setdefault(v, len(places)) for v in (names if coded.null_count else names[:-1])], np.int64)
                if len(places) > len(h):
                    more = max(len(places), 2 * len(h)) - len(h)
                    h, seen = np.concatenate([h, np.zeros((more, agents, p))]), np.r_[seen, np.zeros(more, np.int64)]
                series = place[np.asarray(coded.indices.fill_null(len(place) - 1))]
                for now in _turns(series):
                    s, v = series[now], np.repeat(y[now, None], agents, 1)
                    live = np.flatnonzero(seen[s] >= p)
                    if len(live):
                        lags = np.empty((len(live), agents, len(columns)))
                        lags[:, :, at_y] = h[s[live]][:, :, [-j for j in outputs]]
                        lags[:, :, at_x] = x[now[live], None]
                        made = build(lags.reshape(-1, len(columns))).reshape(len(live), agents, -1)
                        out = np.einsum("sat,at->sa", made, weights)
                        miss += ((v[live] - out) ** 2).sum(0)
                        v[live] = out
                    h[s, :, :-1], h[s, :, -1] = h[s, :, 1:], v
                    seen[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(agents, dtype=np.int32)), pa.array(miss)], ["agent", "miss"])

    sums = rows.mapInArrow(run, "agent int, miss double").groupBy("agent").agg(F.sum("miss").alias("miss"))
    out = np.zeros(len(theta))
    for r in sums.collect():
        out[r["agent"]] = r["miss"]
    return out


def swarm_search(train: DataFrame, valid: DataFrame, columns: list[str], terms: list[Term], loss: str = "swarm", p_value: float = 0.05, **options) -> tuple[list[int], np.ndarray, Swarm]:
    """(terms, coefficients, the swarm): the subset whose free run over ``valid`` (series_id, k, y, x..) loses least.

    Coefficients come from the Gram matrix of ``train``, all its series together; every series of ``valid`` is run on its own, from its
    first max_lag samples, and their squares are summed.
    """
    if loss not in LOSSES or not 0 <= p_value <= 1:
        raise ValueError("unknown loss, or p_value outside [0, 1]")
    q = gram(train, columns, terms)
    if not (np.isfinite(q.g).all() and np.isfinite(q.b).all()):
        raise ValueError("values must be finite")
    p, m = max_lag(columns), len(terms)
    inputs = [c for c in columns if not c.startswith("y_")]
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("k"))
    rows = lagged(valid, inputs).select("series_id", "k", F.col("y").cast("double").alias("y"), *inputs, place.alias("row"))
    # written once and kept by the tasks between the rounds; a lost task reads it again
    rows = materialize(rows, "validation")
    each = rows.where(F.col("row") > p).groupBy("series_id").agg(F.count("*").alias("n"), F.var_pop("y").alias("v"))
    sums = each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("spread")).first()
    if not sums["n"]:
        raise ValueError(f"the validation part needs a series of {p + 1} samples")
    rows = rows.select("series_id", "k", "y", *inputs, "row").repartition("series_id").sortWithinPartitions("row", "series_id").persist()
    n, spread, score, seed = sums["n"], sums["spread"], LOSSES[loss], options.get("seed", 0)

    def fitted(bits: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
        """(bits without insignificant terms, coefficients of all candidates, terms that count)."""
        theta = np.zeros(m)
        for _ in range(100):
            if not bits.any():
                bits = (rng.random(m) < 0.5).astype(np.int8)
                continue
            idx = np.flatnonzero(bits)
            drop = idx[t_test(q.sub(idx), least_squares(q.sub(idx))) > p_value]
            bits[drop] = 0
            if not bits.any():
                continue
            idx = np.flatnonzero(bits)
            theta[idx] = least_squares(q.sub(idx))
            return bits, theta, len(idx) + (len(drop) if loss == "swarm" else 0)
        return bits, theta, 0

    def objective(agents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [fitted(b.astype(np.int8).copy(), np.random.default_rng([seed, a])) for a, b in enumerate(agents)]
        miss = simulated(rows, columns, terms, np.array([theta for _, theta, _ in found]))
        value = [score(float(v), float(spread), float(n), used, m) if used else math.inf for v, (_, _, used) in zip(miss, found)]
        return np.array(value), np.array([b for b, _, _ in found])

    try:
        swarm = Swarm(m, **options).run(objective)
    finally:
        rows.unpersist()
    idx = np.flatnonzero(swarm.best).tolist()
    return idx, least_squares(q.sub(idx)), swarm


def tail(series: DataFrame, part: str, lag: int) -> tuple[DataFrame, DataFrame]:
    """(train, valid) of a series split by ``part``; valid starts with the last ``lag`` training samples."""
    last = series.where(F.col(part) == "train").groupBy("series_id").agg(F.max("k").alias("_last"))
    joined = series.join(last, "series_id")
    return series.where(F.col(part) == "train"), joined.where(F.col("k") > F.col("_last") - lag).drop("_last")
