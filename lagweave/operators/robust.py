"""Searches that need more than one Gram matrix: modulated (ultra-orthogonal), over resampled views, and entropic."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import digamma
from . import entropy, loo, near
from .gram import Gram, gram_of
from .pieces import in_pieces
from .select import best_order, by_order

SUPPORT = {"bspline": 2.0, "gaussian": 3.0, "custom": 1.0}


def spline(t: np.ndarray, order: int) -> np.ndarray:
    """Cubic B-spline on [-2, 2] and its derivatives, from its truncated powers."""
    if not 0 <= order <= 3:
        raise ValueError("a cubic spline has orders 0 to 3")
    out = np.zeros_like(t)
    scale = (1 / 6, 1 / 2, 1.0, 1.0)[order]
    for j, c in enumerate((1, -4, 6, -4, 1)):
        u = t + 2 - j
        out += c * scale * (np.where(u >= 0, 1.0, 0.0) if order == 3 else np.maximum(u, 0) ** (3 - order))
    out[np.abs(t) >= 2] = 0.0
    return out


def kernel(order: int, support: int = 9, kind: str = "bspline", sigma: float = 1.0, custom: Callable | None = None) -> tuple[np.ndarray, float]:
    """Test function of unit energy at ``support`` points, and the factor that makes its sum 1 (1 if it is odd)."""
    if support < 3 or support % 2 == 0:
        raise ValueError("support must be an odd number from 3")
    edge = SUPPORT[kind] * (sigma if kind == "gaussian" else 1.0)
    t = np.linspace(-edge, edge, support)
    if kind == "bspline":
        w = spline(t, order)
    elif kind == "gaussian":
        w = np.exp(-0.5 * (t / sigma) ** 2)
        for _ in range(order):
            w = np.gradient(w, t)
    else:
        w = np.asarray(custom(t, order), float)
    norm = np.linalg.norm(w)
    if norm == 0:
        raise ValueError("the test function is zero everywhere")
    w = w / norm
    return w, 1.0 if abs(w.sum()) < 1e-8 else float(1 / w.sum())


def modulate(psi: DataFrame, columns: list[str], weights: list[float], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns replaced by sums of the weights with the samples from k on; the tail without a full kernel goes."""
    w = Window.partitionBy("series_id").orderBy("k")
    whole = F.lead("k", len(weights) - 1).over(w).isNotNull()
    sums = [sum((F.lit(float(a)) * F.lead(c, i).over(w) for i, a in enumerate(weights)), F.lit(0.0)).alias(c) for c in columns]
    return psi.select("series_id", "k", *keep, *sums, whole.alias("_whole")).where("_whole").drop("_whole")


def augment(psi: DataFrame, m: int, orders: int, support: int = 9, **options) -> DataFrame:
    """psi (series_id, k, y, t0..) stacked with its modulated copies of orders 1..orders, each scaled by the area factor and sqrt(n / n modulated)."""
    columns = ["y", *(f"t{i}" for i in range(m))]
    out = psi.select("series_id", "k", *columns)
    base = out.join(psi.groupBy("series_id").agg(F.count("*").alias("_n")), "series_id")
    for j in range(1, orders + 1):
        w, area = kernel(j, support, **options)
        size = area * F.sqrt(F.col("_n") / (F.col("_n") - (support - 1)))
        part = modulate(base, columns, w.tolist(), keep=("_n",))
        out = out.unionByName(part.select("series_id", "k", *((F.col(c) * size).alias(c) for c in columns)))
    return out


def ultra_orthogonal(psi: DataFrame, m: int, orders: int = 1, **options) -> Gram:
    """Gram matrix of the augmented signals; ``select.forward`` on it is the ultra-orthogonal search."""
    return gram_of(augment(psi, m, orders, **options), m)


MEASURES = ("mae", "mse", "phi3", "rmse_ratio")


def _measure(name: str, w: np.ndarray, e: np.ndarray, y: np.ndarray, fit: np.ndarray, eps: float) -> np.ndarray:
    """Weighted error of every column of e = y - fit."""
    n = w.sum()
    if name == "mae":
        return w @ np.abs(e) / n
    if name == "mse":
        return w @ (e * e) / n
    if name == "phi3":
        top, bottom = w @ np.abs(e), w @ np.abs(y) + w @ np.abs(fit)
    else:
        top, bottom = np.sqrt(w @ (e * e) / n), np.sqrt(w @ (y * y) / n) + np.sqrt(w @ (fit * fit) / n)
    return top / np.where(bottom < eps, eps, bottom)


def _views(resampling: str, k: np.ndarray, piece: np.ndarray, subsets: int | None, size: int | None, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, weight of every sample) of the views of a piece."""
    n = len(k)
    if resampling == "loo":
        for i in piece:
            w = np.ones(n)
            w[i] = 0.0
            yield int(k[i]), w
    elif resampling == "bootstrap":
        total = subsets or n
        # the pieces share the views out, whatever their number
        for view in range(int(piece[0] * total // n), int((piece[-1] + 1) * total // n)):
            drawn = np.random.default_rng([seed, view]).integers(0, n, size or max(1, n - 1))
            yield view, np.bincount(drawn, minlength=n).astype(float)
    elif piece[0] == 0:
        yield 0, np.ones(n)


def view_errors(psi: DataFrame, m: int, chosen: list[int], measure: str = "mae", resampling: str = "loo", subsets: int | None = None, size: int | None = None, seed: int = 0, eps: float = 1e-12) -> DataFrame:
    """(series_id, view, term, error): for every view of every series and every term not yet chosen, the error of the view's
    y fitted by that term alone, after what the chosen terms explain of the term in the view is taken away.

    Views of a series leave one sample out (named by its k), draw samples with replacement, or (None) take it whole.
    Leave-one-out views cost the samples once for mse and rmse_ratio, and a sort for mae and phi3 of terms alone (``loo``); other
    views are formed one by one.
    """
    if measure not in MEASURES or resampling not in ("loo", "bootstrap", None):
        raise ValueError("unknown measure or resampling")
    if resampling == "loo" and measure in ("mse", "rmse_ratio"):
        return loo.squared_errors(psi, m, chosen, measure, eps)
    if resampling == "loo" and not chosen:
        return loo.absolute_errors(psi, m, measure, eps)
    rest = [i for i in range(m) if i not in chosen]

    def work(k: np.ndarray, data: np.ndarray, piece: np.ndarray) -> Iterator[dict]:
        y, t = data[:, 0], data[:, 1:]
        views, terms, errors = [], [], []
        for view, w in _views(resampling, k, piece, subsets, size, seed):
            q = t[:, rest]
            if chosen:
                c = t[:, chosen]
                q = q - c @ (np.linalg.pinv((c * w[:, None]).T @ c, rcond=1e-12, hermitian=True) @ ((c * w[:, None]).T @ q))
            power = w @ (q * q)
            fit = q * ((w * y) @ q / np.where(power < eps, eps, power))
            errors.append(_measure(measure, w, y[:, None] - fit, y[:, None], fit, eps))
            views += [view] * len(rest)
            terms += rest
        if views:
            yield {"view": np.array(views, np.int64), "term": np.array(terms, np.int32), "error": np.concatenate(errors)}

    return in_pieces(psi, ["y", *(f"t{i}" for i in range(m))], work, "view long, term int, error double")


def overall_errors(errors: DataFrame) -> DataFrame:
    """(term, error): the mean over the views of a series, then over the series."""
    return errors.groupBy("series_id", "term").agg(F.avg("error").alias("error")).groupBy("term").agg(F.avg("error").alias("error"))


def robust_forward(psi: DataFrame, m: int, n_terms: int, measure: str = "mae", resampling: str | None = "loo", subsets: int | None = None, size: int | None = None, seed: int = 0, err_tol: float | None = None) -> tuple[list[int], list[float]]:
    """Terms that one by one have the least overall error over the views of all series, and these errors.

    Several series are several data sets of one structure.  Ends early when the errors add up to ``err_tol``.
    """
    chosen: list[int] = []
    found: list[float] = []
    for _ in range(min(n_terms, m)):
        best = overall_errors(view_errors(psi, m, chosen, measure, resampling, subsets, size, seed)).orderBy(F.round("error", 12), "term").first()
        if best is None:
            break
        chosen.append(best["term"])
        found.append(best["error"])
        if err_tol is not None and sum(found) >= err_tol:
            break
    return chosen, found


def robust_order(psi: DataFrame, chosen: list[int], criterion: str = "aic") -> int:
    """How many of the chosen terms, in their order, a criterion keeps."""
    q = gram_of(psi.select("series_id", "k", "y", *(F.col(f"t{c}").alias(f"t{i}") for i, c in enumerate(chosen))), len(chosen))
    return best_order(by_order(q, list(range(len(chosen))), criterion), criterion)


def averaged_theta(psi: DataFrame, m: int, chosen: list[int], resampling: str | None = "loo", subsets: int | None = None, size: int | None = None, seed: int = 0) -> np.ndarray:
    """Least-squares coefficients of the chosen terms: the mean over the views of a series, then over the series."""

    if resampling == "loo":
        means = loo.coefficients(psi.select("series_id", "k", "y", *(F.col(f"t{c}").alias(f"t{i}") for i, c in enumerate(chosen))), len(chosen))
        return np.array([r["v"] for r in means.groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()])

    def work(k: np.ndarray, data: np.ndarray, piece: np.ndarray) -> Iterator[dict]:
        y, c = data[:, 0], data[:, 1:]
        found = [np.linalg.pinv((c * w[:, None]).T @ c, rcond=1e-12, hermitian=True) @ (c.T @ (w * y)) for _, w in _views(resampling, k, piece, subsets, size, seed)]
        if found:
            yield {"i": np.tile(np.arange(len(chosen), dtype=np.int32), len(found)), "v": np.concatenate(found)}

    views = in_pieces(psi, ["y", *(f"t{i}" for i in chosen)], work, "i int, v double")
    means = views.groupBy("series_id", "i").agg(F.avg("v").alias("v")).groupBy("i").agg(F.avg("v").alias("v"))
    return np.array([r["v"] for r in means.orderBy("i").collect()])


def neighbour_counts(rows: DataFrame, columns: list[str], y: str = "y", neighbours: int = 2) -> DataFrame:
    """(series_id, k, nx, ny): for every sample, how many others of its series lie nearer than its ``neighbours``-th nearest
    one in x and y together, in x (``columns``, largest difference) and in y; of series of any length (``near``)."""
    return near.neighbour_counts(rows, columns, [y], neighbours)


#: Samples up to which all pairs are compared at once.
SHORT = 256
#: Rows compared at a time, times the points they are compared with.
BLOCK = 1 << 18


def _sorted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, columns): points by the column with most distinct values, which comes first, equal points next to each other."""
    distinct = [len(np.unique(c)) for c in points.T]
    columns = np.argsort([-d for d in distinct], kind="stable")
    return np.lexsort(points.T[columns[::-1]]), columns


def _radius(points: np.ndarray, k: int) -> np.ndarray:
    """Chebyshev distance of every point to its k-th nearest other one: among those near it in one column, as many as are needed to be sure."""
    n = len(points)
    order, columns = _sorted(points)
    s = np.ascontiguousarray(points[order][:, columns])
    out, left, width = np.empty(n), np.arange(n), min(n, max(32, 4 * k + 1))
    while len(left):
        rest = []
        for a in range(0, len(left), max(1, BLOCK // width)):
            i = left[a : a + max(1, BLOCK // width)]
            low = np.clip(i - width // 2, 0, n - width)
            near = low[:, None] + np.arange(width)
            d = np.abs(s[i, 0][:, None] - s[near, 0])
            ends = d[:, 0].copy(), d[:, -1].copy()
            for c in range(1, s.shape[1]):
                np.maximum(d, np.abs(s[i, c][:, None] - s[near, c]), out=d)
            r = np.partition(d, k, axis=1)[:, k]
            out[order[i]] = r
            # points past an end are as far as the end at least
            rest.append(i[((low > 0) & (ends[0] < r)) | ((low + width < n) & (ends[1] < r))])
        left, width = np.concatenate(rest), min(n, 2 * width)
    return out


def _between(x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, from, to): places in the order of x of the points nearer to each x than its radius."""
    order = np.argsort(x, kind="stable")
    value, start = np.unique(x[order], return_index=True)
    start = np.r_[start, len(x)]
    low, high = np.searchsorted(value, x - radius), np.searchsorted(value, x + radius, "right")
    m = len(value)
    inside = lambda j: np.abs(x - value[np.clip(j, 0, m - 1)]) < radius
    # the differences decide, as they are rounded
    while (move := (low > 0) & inside(low - 1)).any():
        low = low - move
    while (move := (low < high) & ~inside(low)).any():
        low = low + move
    while (move := (high < m) & inside(high)).any():
        high = high + move
    while (move := (high > low) & ~inside(high - 1)).any():
        high = high - move
    return order, start[low], start[high]


def _within(points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many other points lie nearer to each point than its radius."""
    best = max(range(points.shape[1]), key=lambda c: len(np.unique(points[:, c])))
    order, low, high = _between(points[:, best], radius)
    size = high - low
    if points.shape[1] == 1:
        return np.maximum(size - 1, 0)
    s, out = points[order], np.zeros(len(points), np.int64)
    other = [c for c in range(points.shape[1]) if c != best]
    by = np.argsort(size, kind="stable")
    by = by[size[by] > 1]
    a = 0
    while a < len(by):
        # points with about as many candidates each
        b = min(len(by), a + max(1, BLOCK // int(size[by[a]])))
        while b - a > 1 and (b - a) * int(size[by[b - 1]]) > 2 * BLOCK:
            b = a + (b - a) // 2
        i, width = by[a:b], int(size[by[b - 1]])
        near = low[i][:, None] + np.arange(width)
        counted = near < high[i][:, None]
        near = np.minimum(near, len(s) - 1)
        for c in other:
            counted &= np.abs(points[i, c][:, None] - s[near, c]) < radius[i][:, None]
        out[i] = counted.sum(1)
        a = b
    return np.maximum(out - 1, 0)


@lru_cache(32)
def _digammas(bits: int) -> np.ndarray:
    """Of 1 to 2**bits."""
    return digamma(np.arange(1, (1 << bits) + 1))


def _apart(x: np.ndarray) -> np.ndarray:
    d = np.abs(x[:, 0, None] - x[None, :, 0])
    for c in range(1, x.shape[1]):
        np.maximum(d, np.abs(x[:, c, None] - x[None, :, c]), out=d)
    return d


def _all_pairs(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a short series in x and in y."""
    dx, dy, at = _apart(x), _apart(y), np.arange(len(x))
    d = np.maximum(dx, dy)
    d[at, at] = np.inf
    for _ in range(k - 1):
        d[at, d.argmin(1)] = np.inf
    radius = d.min(1)
    return tuple(np.maximum((e < radius).sum(0, dtype=np.int32) - 1, 0) for e in (dx, dy))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 2) -> float:
    """Nearest-neighbour estimate from Chebyshev distances, exact; points of a long series are compared with those near them in one column, in blocks."""
    n = len(x)
    if n <= k:
        raise ValueError(f"{n} samples have no {k} neighbours")
    x, y = x.reshape(n, -1), y.reshape(n, -1)
    if n <= SHORT:
        nx, ny = _all_pairs(x, y, k)
    else:
        radius = _radius(np.column_stack([x, y]), k)
        nx, ny = _within(x, radius), _within(y, radius)
    psi = _digammas(n.bit_length())
    return float(psi[k - 1] + psi[n - 1] - (psi[nx] + psi[ny]).mean())


def conditional_information(x: np.ndarray, y: np.ndarray, z: np.ndarray | None, k: int = 2) -> float:
    """I(x; y | z) as I(x; (y, z)) - I(x; z)."""
    if z is None or z.size == 0:
        return mutual_information(x, y, k)
    z = z.reshape(len(x), -1)
    return mutual_information(x, np.column_stack([y, z]), k) - mutual_information(x, z, k)


def entropic(psi: DataFrame, m: int, k: int = 2, n_perm: int = 200, quantile: float = 0.99, seed: int = 0, constant: int | None = None, least: float = 0.01) -> DataFrame:
    """(series_id, term): entropic regression for each series on its own; measurements and permutations are tasks (``entropy``).

    Forward: add the term whose fit together with those chosen shares most information with y given the present fit, while that
    exceeds the tolerance, a quantile of the information under ``n_perm`` permutations; backward: drop what adds nothing.  The
    term ``constant``, if given, is left out of the search, joins the terms found, and goes if its coefficient is below ``least``.
    The estimate compares all pairs of a series' samples inside a task; a series of over ``pieces.MOST`` samples is refused.
    """
    return entropy.entropic(psi, m, conditional_information, k, n_perm, quantile, seed, constant, least)
