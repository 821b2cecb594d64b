"""Online LMS over a stream: one state row of coefficients and recent outputs for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def online_lms(stream: DataFrame, ylag: int = 1, mu: float = 0.01) -> DataFrame:
    """stream (series_id, k, y) -> (series_id, k, theta, error): an autoregression of order ``ylag`` updated sample by sample.

    Samples of a micro-batch are taken in order of k; those at or before the last k seen are late and ignored.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, theta, recent = state.get if state.exists else (-(1 << 62), [0.0] * ylag, [])
        theta, recent = list(theta), list(recent)
        rows = pd.concat(list(frames)).sort_values("k")
        out = []
        for k, y in zip(rows["k"], rows["y"]):
            if k <= last:
                continue
            last = int(k)
            if len(recent) == ylag:
                e = float(y) - sum(t * p for t, p in zip(theta, recent))
                theta = [t + 2 * mu * e * p for t, p in zip(theta, recent)]
                out.append((key[0], last, list(theta), e))
            recent = [float(y), *recent][:ylag]
        state.update((last, theta, recent))
        yield pd.DataFrame(out, columns=["series_id", "k", "theta", "error"])

    out = "series_id long, k long, theta array<double>, error double"
    return stream.groupBy("series_id").applyInPandasWithState(run, out, "last long, theta array<double>, recent array<double>", "append", GroupStateTimeout.NoTimeout)
