"""Numeric functions."""

from __future__ import annotations


def _log(name: str):
    """IEEE results outside the domain."""
    return lambda x: f"if(({x}) = 0d, double('-inf'), if(({x}) < 0, double('NaN'), {name}({x})))"


def gcd(a: str, b: str) -> str:
    """Euclid's steps; 92 suffice for 64 bits."""
    return f"aggregate(sequence(1, 92), named_struct('a', abs(cast({a} AS bigint)), 'b', abs(cast({b} AS bigint))), (z, i) -> if(z.b = 0, z, named_struct('a', z.b, 'b', z.a % z.b)), z -> z.a)"


def log(base_or_x: str, x: str | None = None) -> str:
    return _log("log10")(base_or_x) if x is None else f"log({base_or_x}, {x})"


def trunc(x: str, places: str = "0") -> str:
    """Toward zero."""
    return f"(signum({x}) * floor(abs({x}) * power(10, {places})) / power(10, {places}))"


REWRITES = {
    "gcd": gcd,
    "lcm": lambda a, b: f"if(({a}) = 0 OR ({b}) = 0, 0, abs(({a}) * ({b})) div {gcd(a, b)})",
    "iszero": lambda x: f"(({x}) = 0)",
    "isnan": lambda x: f"if(({x}) IS NULL, NULL, isnan({x}))",
    "nanvl": lambda x, y: f"if(({x}) IS NULL OR ({y}) IS NULL, NULL, nanvl({x}, {y}))",
    "log": log,
    "ln": _log("ln"),
    "log2": _log("log2"),
    "log10": _log("log10"),
    "ceil": lambda x: f"cast(ceil({x}) AS double)",
    "floor": lambda x: f"cast(floor({x}) AS double)",
    "trunc": trunc,
    "pow": lambda x, y: f"power({x}, {y})",
    "random": lambda: "rand()",
    "factorial": lambda n: f"if(({n}) > 20, raise_error('factorial overflows'), factorial({n}))",
}
