"""Scalar and aggregate functions whose meaning differs from Spark's, as rewrites to Spark SQL.

``REWRITES`` maps a function's name to a callable that takes its arguments (Spark SQL texts) and gives
a Spark SQL text; built-ins of the same meaning need no entry.  ``AGGREGATES`` does so for aggregates
that take an ORDER BY or WITHIN GROUP.  Every rewrite stays within Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from tessera.functions import arrays, core, datetimes, maths, strings
from tessera.functions.aggregates import AGGREGATES

REWRITES: dict[str, Callable[..., str]] = {
    **strings.REWRITES,
    **maths.REWRITES,
    **datetimes.REWRITES,
    **core.REWRITES,
    **arrays.REWRITES,
}

__all__ = ["AGGREGATES", "REWRITES"]
