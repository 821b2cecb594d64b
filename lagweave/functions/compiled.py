"""Terms as Python functions, for folds and for NumPy inside a batch; their SQL is what the library's bases write."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

import numpy as np

from .basis import Computed, Term, computed

_NUMBER = re.compile(r"(?<![\w.])([0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?)D\b")
_INSIDE = re.compile(r"case when (\w+) between 0D and 1D then (.*?) else 0D end")
_LAG = re.compile(r"\b(?:y|x\d+)_\d+\b")


def _safe(f: Callable) -> Callable:
    """f with NaN where it has no value and infinity where it overflows, as doubles have in a column."""

    def run(*v: float) -> float:
        try:
            return f(*v)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    return run


_SCALAR = {"cos": _safe(math.cos), "sin": _safe(math.sin), "exp": _safe(math.exp), "sqrt": _safe(math.sqrt), "ln": _safe(math.log), "abs": abs, "tanh": math.tanh, "pow": _safe(math.pow), "signum": lambda v: math.copysign(1.0, v) if v else v}
_VECTOR = {"cos": np.cos, "sin": np.sin, "exp": np.exp, "sqrt": np.sqrt, "ln": np.log, "abs": np.abs, "tanh": np.tanh, "pow": np.power, "signum": np.sign, "where": np.where}


def _python(sql: str, vector: bool) -> str:
    inside = r"where((\1 >= 0) & (\1 <= 1), \2, 0D)" if vector else r"((\2) if 0 <= \1 <= 1 else 0D)"
    return _NUMBER.sub(r"\1", _INSIDE.sub(inside, sql))


_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Constant, ast.Subscript, ast.Compare, ast.IfExp, ast.Tuple, ast.Slice, ast.Load)
_NODES += (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.BitAnd, ast.USub, ast.UAdd, ast.Lt, ast.LtE, ast.Gt, ast.GtE)


def _compile(body: str, names: list[str], known: dict, term: str = "") -> Callable:
    """lambda names: body, of numbers, operators, the names and calls of ``known`` only; anything else is an error that names the term."""
    try:
        tree = ast.parse(body, mode="eval")
    except SyntaxError:
        raise ValueError(f"no Python form of the term {term or body}") from None
    calls = {n.func for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in known and not n.keywords}
    for n in ast.walk(tree):
        fine = isinstance(n, _NODES)
        fine &= not isinstance(n, ast.Call) or n.func in calls
        fine &= not isinstance(n, ast.Name) or n in calls or n.id in names
        fine &= not isinstance(n, ast.Constant) or isinstance(n.value, (int, float)) or n.value is None
        fine &= not isinstance(n, ast.Subscript) or isinstance(n.value, ast.Name)
        if not fine:
            raise ValueError(f"no Python form of the term {term or body}")
    return eval(compile(f"lambda {', '.join(names)}: {body}", "<terms>", "eval"), {"__builtins__": {}, **known})  # noqa: S307 - its tree was looked through above


def next_output(terms: list[Term], columns: list[str]) -> Callable:
    """f(h, x, theta): the output after the outputs h (last at the end), with the input lags x in the order of ``columns``.

    It gives infinity or NaN where a term overflows or has no value, never an exception.
    """
    if any(isinstance(sql, Computed) for _, sql in terms):
        return _next_computed(terms, columns)
    inputs = {c: f"x[{i}]" for i, c in enumerate(c for c in columns if not c.startswith("y_"))}

    def place(match: re.Match) -> str:
        c = match[0]
        return inputs[c] if c in inputs else f"h[-{c.rpartition('_')[2]}]"

    parts = [f"theta[{i}] * ({_LAG.sub(place, _python(sql, False))})" for i, (_, sql) in enumerate(terms)]
    for (name, _), part in zip(terms, parts):
        _compile(part, ["h", "x", "theta"], _SCALAR, name)
    step = _compile(" + ".join(parts) or "0.0", ["h", "x", "theta"], _SCALAR)

    def run(h: list[float], x: tuple, theta: list[float]) -> float:
        try:
            return step(h, x, theta)
        except (ZeroDivisionError, OverflowError):
            return math.nan

    return run


def _next_computed(terms: list[Term], columns: list[str]) -> Callable:
    """As ``next_output`` with some terms computed by Python functions, which are called for one row."""
    sql = [i for i, (_, x) in enumerate(terms) if not isinstance(x, Computed)]
    rest = next_output([terms[i] for i in sql], columns)
    order = [c for c in columns if not c.startswith("y_")]
    back = [int(c[2:]) if c.startswith("y_") else 0 for c in columns]
    from_x = [order.index(c) if c in order else 0 for c in columns]

    def run(h: list[float], x: tuple, theta: list[float]) -> float:
        lags = np.array([[h[-b] if b else x[i] for b, i in zip(back, from_x)]], float)
        with np.errstate(all="ignore"):
            made = computed(terms, columns, lags)
            return rest(h, x, [theta[i] for i in sql]) + float(sum(theta[i] * v[0] for i, v in made.items()))

    return run


def design(terms: list[Term], columns: list[str]) -> Callable:
    """f(lags): the matrix of all terms for rows of lags, columns in the order of ``columns``.

    Products are built from shorter ones, a term each from its prefix and its last factor.
    """
    place = {c: i for i, c in enumerate(columns)}
    products = {(): 0}
    steps: list[list[tuple[int, int, int]]] = []
    wanted: list[tuple[int, tuple[str, ...]]] = []
    other: list[tuple[int, Callable]] = []
    for i, (name, sql) in enumerate(terms):
        if isinstance(sql, Computed):
            continue
        factors = () if name == "1" else tuple(name.split("*"))
        if all(f in place for f in factors):
            wanted.append((i, factors))
        else:
            other.append((i, _compile(_LAG.sub(lambda m: f"lags[:, {place[m[0]]}]", _python(sql, True)), ["lags"], _VECTOR, name)))
    for _, factors in wanted:
        for d in range(1, len(factors) + 1):
            if factors[:d] not in products:
                products[factors[:d]] = len(products)
                while len(steps) < d:
                    steps.append([])
                steps[d - 1].append((products[factors[:d]], products[factors[: d - 1]], place[factors[d - 1]]))
    levels = [tuple(np.array(x) for x in zip(*level)) for level in steps if level]
    at, of = np.array([i for i, _ in wanted], int), np.array([products[f] for _, f in wanted], int)

    def run(lags: np.ndarray) -> np.ndarray:
        every = np.ones((len(lags), len(products)))
        for target, prefix, column in levels:
            every[:, target] = every[:, prefix] * lags[:, column]
        made = computed(terms, columns, lags)
        if not other and not made and len(at) == len(products) and np.array_equal(of, np.arange(len(of))):
            return every
        out = np.empty((len(lags), len(terms)))
        out[:, at] = every[:, of]
        for i, f in other:
            out[:, i] = f(lags)
        for i, v in made.items():
            out[:, i] = v
        return out

    return run
