"""Structure searches over very many candidate terms: columns of the Gram matrix are computed as they are needed.

A pass evaluates the terms in NumPy inside each batch, from the lags alone, and adds up their
products with y or with some chosen terms.  What reaches the driver is a vector of the number of
terms for each of these, never the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term, max_lag
from ..functions.compiled import design
from .gram import Gram, add_up
from .lagging import lagged
from .select import ratios

#: Numbers of the term matrix held at a time, terms whose sums travel together, columns fetched in one pass.
CELLS = 4 << 20
BLOCK = 2048
AHEAD = 16


class Columns:
    """The Gram matrix of ``terms`` over a series, by columns."""

    def __init__(self, series: DataFrame, columns: list[str], terms: list[Term], bucket: int | None = None):
        self.columns, self.terms, self.m = columns, terms, len(terms)
        rows = lagged(series, columns, bucket).where(F.col("k") > max_lag(columns))
        self.rows = rows.select("y", *columns).persist()
        self.known: dict[int, np.ndarray] = {}
        d, b, sums, (yy, y_sum, n) = self._start()
        self.d, self.b, self.sums, self.yy, self.y_sum, self.n = d, b, sums, float(yy), float(y_sum), int(n)

    def close(self) -> None:
        self.rows.unpersist()

    def _pass(self, width: int, products) -> np.ndarray:
        """Sums over all rows of products(psi, y), a (terms, width) matrix for each chunk of rows."""
        columns, m, terms = self.columns, self.m, self.terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            build = design(terms, columns)
            total, tail = np.zeros((m, width)), np.zeros(3)
            step = max(1, CELLS // max(1, m))
            for batch in batches:
                y = np.asarray(batch["y"], float)
                lags = np.column_stack([np.asarray(batch[c], float) for c in columns]) if columns else np.zeros((len(y), 0))
                tail += (y @ y, y.sum(), len(y))
                for a in range(0, len(y), step):
                    psi = build(lags[a : a + step])
                    total += products(psi, y[a : a + step])
            blocks = [total[a : a + BLOCK].tobytes() for a in range(0, m, BLOCK)] + [tail.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "values"])

        blocks = add_up(self.rows.mapInArrow(run, "block int, values binary"))
        self.tail = blocks[max(blocks)]
        return np.concatenate([blocks[i] for i in range(len(blocks) - 1)]).reshape(m, width)

    def _start(self):
        sums = self._pass(3, lambda psi, y: np.column_stack([np.einsum("ij,ij->j", psi, psi), psi.T @ y, psi.sum(0)]))
        return *sums.T.copy(), self.tail

    def column(self, i: int) -> np.ndarray:
        self.fetch([i])
        return self.known[i]

    def fetch(self, wanted: list[int]) -> None:
        """Columns of the Gram matrix, in one pass for those not yet known."""
        new = [i for i in dict.fromkeys(wanted) if i not in self.known]
        if new:
            for i, column in zip(new, self._pass(len(new), lambda psi, y: psi.T @ psi[:, new]).T):
                self.known[i] = column.copy()

    def gram(self, chosen: list[int]) -> Gram:
        self.fetch(chosen)
        return Gram(np.array([self.known[i][chosen] for i in chosen]).reshape(len(chosen), len(chosen)), self.b[chosen], self.yy, self.sums[chosen], self.y_sum, self.n)


def forward(q: Columns, n_terms: int, alpha: float = 0.0, err_tol: float | None = None) -> tuple[list[int], list[float]]:
    """As ``select.forward``, with the columns of the terms likely to be chosen fetched ahead."""
    d, b = q.d.copy(), q.b.copy()
    floor = 1e-13 * np.maximum(q.d, 1e-300)
    chosen: list[int] = []
    found: list[float] = []
    rows = np.zeros((0, q.m))
    for _ in range(min(n_terms, q.m)):
        err = ratios(d, b, q.yy, floor, alpha)
        err[chosen] = -1
        k = int(np.argmax(np.round(err, 14)))
        if k not in q.known:
            q.fetch([k, *(int(i) for i in np.argsort(-err, kind="stable")[:AHEAD] if i != k and i not in chosen)])
        chosen.append(k)
        found.append(float(err[k]))
        if d[k] > floor[k]:
            row = (q.known[k] - rows[:, k] @ rows) / np.sqrt(d[k])
            b = b - row * (b[k] / np.sqrt(d[k]))
            d = d - row * row
            rows = np.vstack([rows, row])
        if err_tol is not None and sum(found) >= err_tol:
            break
    return chosen, found
