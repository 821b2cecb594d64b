"""Basis expansions as SQL expressions over lag columns.

A term is (name, SQL).  Selecting terms is column pruning: only their expressions are planned.
Lag columns are named ``y_1``, ``x1_2``: variable and lag.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np


@dataclass(frozen=True)
class Computed:
    """Stands where a term's SQL stands: column ``index`` of what a Python function makes of the lags."""

    function: Callable
    columns: tuple[str, ...]
    index: int
    size: int


Term = tuple[str, "str | Computed"]
BIAS: Term = ("1", "1D")


def computed(terms: list[Term], columns: list[str], lags: np.ndarray) -> dict[int, np.ndarray]:
    """Values of those terms that are computed, by place, for rows of lags with columns in the order of ``columns``; each function is called once."""
    made: dict[tuple, np.ndarray] = {}
    out = {}
    for i, (name, c) in enumerate(terms):
        if not isinstance(c, Computed):
            continue
        key = (c.function, c.columns)
        if key not in made:
            value = np.asarray(c.function(lags[:, [columns.index(x) for x in c.columns]]), float)
            if value.shape != (len(lags), c.size):
                raise ValueError(f"the function of {name} gave {value.shape} for {len(lags)} rows and {c.size} terms")
            made[key] = value
        out[i] = made[key][:, c.index]
    return out


def lag_columns(ylag: list[int], xlags: list[list[int]], model_type: str = "NARMAX") -> list[str]:
    """Lag columns of a model: y lags for NARMAX and NAR, input lags for NARMAX and NFIR."""
    if model_type not in ("NARMAX", "NAR", "NFIR"):
        raise ValueError(f"unknown model type {model_type}")
    ys = [f"y_{i}" for i in ylag] if model_type != "NFIR" else []
    return ys + ([f"x{j + 1}_{i}" for j, lags in enumerate(xlags) for i in lags] if model_type != "NAR" else [])


def lags(spec: int | list[int]) -> list[int]:
    """An int stands for 1..n."""
    out = list(range(1, spec + 1)) if isinstance(spec, int) and not isinstance(spec, bool) else list(spec)
    if not out or any(not isinstance(i, int) or i < 1 for i in out):
        raise ValueError(f"lags must be integers from 1: {spec}")
    return out


def max_lag(columns: list[str]) -> int:
    return max((int(c.rpartition("_")[2]) for c in columns), default=1)


def variable(column: str) -> str:
    return column.rpartition("_")[0]


def product(factors: tuple[str, ...]) -> Term:
    return ("*".join(factors), " * ".join(factors)) if factors else BIAS


def factors(name: str) -> tuple[str, ...]:
    """The lag columns of a product's name, sorted; none for the constant."""
    return () if name == "1" else tuple(sorted(name.split("*")))


def index_of(terms: list[Term], wanted: list[str]) -> list[int]:
    """Place of every wanted term among the candidates, in the order asked for; factors may come in any order.

    A term that is missing, asked for twice or held twice by the candidates is an error.
    """
    places: dict[tuple[str, ...], list[int]] = {}
    for i, (name, _) in enumerate(terms):
        places.setdefault(factors(name), []).append(i)
    out = []
    for name in wanted:
        found = places.get(factors(name), [])
        if len(found) != 1:
            raise ValueError(f"{name} is {'ambiguous' if found else 'no candidate'}")
        if found[0] in out:
            raise ValueError(f"{name} is asked for twice")
        out.append(found[0])
    return out


def output_terms(terms: list[Term]) -> list[Term]:
    """Terms with a lag of the output."""
    return [t for t in terms if any(variable(f) == "y" for f in factors(t[0]))]


def input_terms(terms: list[Term]) -> list[Term]:
    """Terms with a lag of an input."""
    return [t for t in terms if any(variable(f) != "y" for f in factors(t[0]))]


def product_terms(wanted: list[str]) -> tuple[list[str], list[Term]]:
    """(lag columns, terms) of a model given by the names of its products."""
    names = [tuple(n.split("*")) if n != "1" else () for n in wanted]
    if any(not c.rpartition("_")[2].isdigit() or int(c.rpartition("_")[2]) < 1 for f in names for c in f):
        raise ValueError(f"terms are products of lags such as y_1 or x1_2: {wanted}")
    columns = sorted({c for f in names for c in f}, key=lambda c: (variable(c) != "y", variable(c), int(c.rpartition("_")[2])))
    return columns, [product(f) for f in names]


def horner(coefficients: list[float], x: str) -> str:
    """SQL of a polynomial from its coefficients, constant first."""
    out = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}D)"
    return out


def recurrence(order: int, first: list[float], step) -> list[list[float]]:
    """Coefficients of orders 0..order from p1 and step(n, p_n, p_(n-1)) -> p_(n+1)."""
    out = [[1.0], first]
    for n in range(1, order):
        out.append(step(n, out[n], out[n - 1] + [0.0]))
    return out[: order + 1]


def _combine(a: float, p: list[float], b: float, q: list[float], c: float, r: list[float]) -> list[float]:
    """a x p + b q + c r on coefficient lists."""
    size = max(len(p) + 1, len(q), len(r))
    out = [0.0] * size
    for i, v in enumerate(p):
        out[i + 1] += a * v
    for i, v in enumerate(q):
        out[i] += b * v
    for i, v in enumerate(r):
        out[i] += c * v
    while len(out) > 1 and out[-1] == 0:
        out.pop()
    return out


@dataclass(frozen=True)
class Basis:
    """Subclass and give ``terms`` for a basis of your own."""

    degree: int = 1
    include_bias: bool = True

    def terms(self, columns: list[str]) -> list[Term]:
        raise NotImplementedError


@dataclass(frozen=True)
class Vectorised(Basis):
    """A basis written in Python: ``function(lags)`` takes a NumPy matrix, a row for each sample and a column for each lag in the order of the model's lag columns, and gives
    a matrix with a column for each name.

    It runs over Arrow batches where the Gram matrix is summed, and over single rows where a prediction is fed back.  ``names`` are the terms' names, or a function from the lag
    columns to these.
    """

    function: Callable | None = None
    names: Callable | tuple[str, ...] = ()

    def terms(self, columns: list[str]) -> list[Term]:
        names = list(self.names(columns) if callable(self.names) else self.names)
        if self.function is None or not names or len(set(names)) < len(names):
            raise ValueError("needs a function and names of its terms, each once")
        own = [(n, Computed(self.function, tuple(columns), i, len(names))) for i, n in enumerate(names)]
        return [BIAS, *own] if self.include_bias else own


@dataclass(frozen=True)
class Polynomial(Basis):
    """All products of up to ``degree`` lag columns, in lexicographic order with 1 first."""

    degree: int = 2

    def factors(self, columns: list[str]) -> list[tuple[str, ...]]:
        return [tuple(c for c in combo if c != "1") for combo in combinations_with_replacement(["1", *columns], self.degree)]

    def terms(self, columns: list[str]) -> list[Term]:
        return [product(f) for f in self.factors(columns) if f or self.include_bias]


@dataclass(frozen=True)
class Bilinear(Polynomial):
    """Polynomial without the products of ``degree`` lags that are all of one variable."""

    def terms(self, columns: list[str]) -> list[Term]:
        if self.degree == 1 and not self.include_bias:
            raise ValueError("a bilinear basis of degree 1 needs its bias")
        pure = lambda f: len(f) == self.degree and len({variable(c) for c in f}) == 1
        return [product(f) for f in self.factors(columns) if not pure(f) and (f or self.include_bias)]


@dataclass(frozen=True)
class Fourier(Basis):
    """cos and sin of n harmonics of every base column; over degree 1 the base is the polynomial of degree 2 without bias."""

    n: int = 1
    p: float = 2 * math.pi
    ensemble: bool = True

    def terms(self, columns: list[str]) -> list[Term]:
        base = [product((c,)) for c in columns] if self.degree == 1 else Polynomial(2, False).terms(columns)
        waves = [(f"{f}({h}*{name})", f"{f}({2 * math.pi * h / self.p!r}D * ({sql}))") for name, sql in base for h in range(1, self.n + 1) for f in ("cos", "sin")]
        return (base if self.ensemble else []) + waves


@dataclass(frozen=True)
class Univariate(Basis):
    """Orders 1..degree of a polynomial family in every lag column."""

    ensemble: bool = False

    def family(self) -> list[list[float]]:
        raise NotImplementedError

    def expression(self, order: int, x: str) -> str:
        return horner(self.family()[order], x)

    def terms(self, columns: list[str]) -> list[Term]:
        name = type(self).__name__
        out = [product((c,)) for c in columns] if self.ensemble else []
        out += [BIAS] if self.include_bias else []
        return out + [(f"{name}{d}({c})", self.expression(d, c)) for c in columns for d in range(1, self.degree + 1)]


class Legendre(Univariate):
    def family(self):
        return recurrence(self.degree, [0.0, 1.0], lambda n, p, q: _combine((2 * n + 1) / (n + 1), p, 0.0, p, -n / (n + 1), q))


class Hermite(Univariate):
    """Physicists' polynomials."""

    def family(self):
        return recurrence(self.degree, [0.0, 2.0], lambda n, p, q: _combine(2.0, p, 0.0, p, -2.0 * n, q))


class HermiteNormalized(Univariate):
    """Probabilists' polynomials."""

    def family(self):
        return recurrence(self.degree, [0.0, 1.0], lambda n, p, q: _combine(1.0, p, 0.0, p, -float(n), q))


class Laguerre(Univariate):
    def family(self):
        return recurrence(self.degree, [1.0, -1.0], lambda n, p, q: _combine(-1 / (n + 1), p, (2 * n + 1) / (n + 1), p, -n / (n + 1), q))


class Bernstein(Univariate):
    """Binomial weights; 0 outside [0, 1]."""

    def expression(self, order: int, x: str) -> str:
        up, down = " * ".join([x] * order), " * ".join([f"(1D - {x})"] * (self.degree - order))
        value = f"{float(math.comb(self.degree, order))!r}D * {up}" + (f" * {down}" if down else "")
        return f"case when {x} between 0D and 1D then {value} else 0D end"
