"""Terms and models as text: plain, LaTeX or ASCII."""

from __future__ import annotations

import re
from collections.abc import Callable

_LAG = re.compile(r"\b(y|x\d+)_(\d+)\b")
_FAMILY = re.compile(r"^(\w+?)(\d+)\((\w+)\)$")
_WAVE = re.compile(r"^(cos|sin)\((\d+)\*(.+)\)$")
STYLES = ("text", "latex", "ascii")


def lag(name: str, style: str = "text") -> str:
    """``x1_2`` as x1(k-2), x1_{k-2} or x1[k-2]."""
    form = {"text": r"\1(k-\2)", "latex": r"\1_{k-\2}", "ascii": r"\1[k-\2]"}[style]
    return _LAG.sub(form, name)


def product(name: str, style: str = "text") -> str:
    """``y_1*x1_2*x1_2`` as y(k-1) x1(k-2)^2."""
    if name == "1":
        return "1"
    factors = name.split("*")
    powers = [lag(f, style) + (("^{%d}" if style == "latex" else "^%d") % factors.count(f) if factors.count(f) > 1 else "") for f in dict.fromkeys(factors)]
    return {"text": " ", "latex": " ", "ascii": "*"}[style].join(powers)


def wave(name: str, style: str = "text") -> str | None:
    """``cos(2*y_1)`` as cos(2 y(k-1))."""
    m = _WAVE.match(name)
    if not m:
        return None
    inner = product(m[3], style)
    gap = "*" if style == "ascii" else " "
    head = f"\\{m[1]}" if style == "latex" else m[1]
    return f"{head}({inner})" if m[2] == "1" else f"{head}({m[2]}{gap}{inner})"


def family(name: str, style: str = "text") -> str | None:
    """``Legendre2(y_1)`` as Legendre2(y(k-1)), or Legendre_{2}(y_{k-1})."""
    m = _FAMILY.match(name)
    if not m:
        return None
    return f"{m[1]}_{{{m[2]}}}({lag(m[3], style)})" if style == "latex" else f"{m[1]}{m[2]}({lag(m[3], style)})"


#: Renderers by name, tried in this order; each returns None for a term that is not its own.
RENDERERS: dict[str, Callable[[str, str], str | None]] = {"wave": wave, "family": family}


def register(name: str, renderer: Callable[[str, str], str | None]) -> None:
    """Add a renderer for the terms of a basis of your own; it goes before those already there."""
    rest = {k: v for k, v in RENDERERS.items() if k != name}
    RENDERERS.clear()
    RENDERERS.update({name: renderer, **rest})


def render(name: str, style: str = "text") -> str:
    """A term's name in a style; a name that no renderer knows and that is no product comes back with its lags rendered."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    for renderer in RENDERERS.values():
        out = renderer(name, style)
        if out is not None:
            return out
    return product(name, style)


def equation(names: list[str], theta: list[float], digits: int = 4, style: str = "text") -> str:
    """y(k) = ... with signed coefficients in the given order."""
    gap = {"text": " ", "latex": " \\, ", "ascii": "*"}[style] if style in STYLES else " "
    parts = [f"{t:+.{digits}f}" + ("" if n == "1" else gap + render(n, style)) for n, t in zip(names, theta)]
    head = {"text": "y(k) = ", "latex": "y_{k} = ", "ascii": "y[k] = "}.get(style)
    if head is None:
        raise ValueError(f"unknown style {style}")
    return head + " ".join(parts)


def results(names: list[str], theta: list[float], err: list[float], theta_digits: int = 4, err_digits: int = 8, scientific: bool = False) -> list[tuple[str, str, str]]:
    """(regressor, coefficient, error reduction ratio) as text, with fixed or scientific numbers."""
    kind = "E" if scientific else "f"
    return [(render(n), f"{t:.{theta_digits}{kind}}", f"{e:.{err_digits}E}") for n, t, e in zip(names, theta, err)]
