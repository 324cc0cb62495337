"""Aggregates with an order, and those whose results differ at the edges.

Each rewrite takes the arguments, the ORDER BY keys ((expression, descending, nulls first) triples)
and whether DISTINCT was said.
"""

from __future__ import annotations


def _sorted(value: str, keys, distinct: bool) -> str:
    """Values as an array in the order of the keys, NULL values kept."""
    if not keys:
        return f"transform(array_agg({'DISTINCT ' if distinct else ''}named_struct('v', {value})), e -> e.v)"
    fields = ", ".join(f"'k{i}', {k[0]}" for i, k in enumerate(keys))
    rows = f"array_agg({'DISTINCT ' if distinct else ''}named_struct({fields}, 'v', {value}))"
    test = "0"
    for i, (_, down, nulls_first) in reversed(list(enumerate(keys))):
        less, more, null = ("1", "-1", "-1") if down else ("-1", "1", "-1")
        null = "-1" if nulls_first else "1"
        other = "1" if null == "-1" else "-1"
        test = f"CASE WHEN a.k{i} <=> b.k{i} THEN {test} WHEN a.k{i} IS NULL THEN {null} WHEN b.k{i} IS NULL THEN {other} WHEN a.k{i} < b.k{i} THEN {less} ELSE {more} END"
    return f"transform(array_sort({rows}, (a, b) -> {test}), e -> e.v)"


def _first(value: str, keys) -> str:
    """The value of the first row: a running minimum or maximum, unless the keys run in different directions."""
    if len(keys) == 1 and not keys[0][1] and not keys[0][2]:
        return f"min_by({value}, {keys[0][0]})"
    if len(keys) == 1 and keys[0][1] and not keys[0][2]:
        return f"max_by({value}, {keys[0][0]})"
    if len({down for _, down, _ in keys}) == 1:
        down = keys[0][1]
        # where NULL counts as the larger side, the mark of NULL is compared before the key
        parts = [f"({e}) IS {'' if first == down else 'NOT '}NULL, {e}" for e, _, first in keys]
        return f"{'max' if down else 'min'}_by({value}, struct({', '.join(parts)}))"
    return f"get({_sorted(value, keys, False)}, 0)"


def _reversed(keys):
    return [(e, not down, not first) for e, down, first in keys]


def first_value(args, keys, distinct):
    return f"first({args[0]})" if not keys else _first(args[0], keys)


def last_value(args, keys, distinct):
    return f"last({args[0]})" if not keys else _first(args[0], _reversed(keys))


def nth_value(args, keys, distinct):
    n = args[1]
    return f"try_element_at({_sorted(args[0], keys, False)}, {n})"


def string_agg(args, keys, distinct):
    order = ", ".join(f"{f'cast({e} AS string)' if e == args[0] else e}{' DESC' if down else ''}" for e, down, _ in keys)
    return f"listagg({'DISTINCT ' if distinct else ''}cast({args[0]} AS string), {args[1]})" + (f" WITHIN GROUP (ORDER BY {order})" if keys else "")


def corr(args, keys, distinct):
    y, x = args
    return f"if(regr_count({y}, {x}) = 0, NULL, coalesce(try_divide(regr_sxy({y}, {x}), sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x}))), 0d))"


def percentile(args, keys, distinct):
    """Approximate percentile of the WITHIN GROUP key; a count of centroids becomes the accuracy."""
    value, down = keys[0][0], keys[0][1]
    share = f"1 - ({args[0]})" if down else args[0]
    return f"approx_percentile({value}, {share}{', ' + str(int(float(args[1])) * 100) if len(args) > 1 else ''})"


AGGREGATES = {
    "array_agg": lambda args, keys, distinct: _sorted(args[0], keys, distinct),
    "first_value": first_value,
    "last_value": last_value,
    "nth_value": nth_value,
    "string_agg": string_agg,
    "corr": corr,
    "approx_distinct": lambda args, keys, distinct: f"approx_count_distinct({args[0]})",
    "approx_median": lambda args, keys, distinct: f"approx_percentile({args[0]}, 0.5)",
    "approx_percentile_cont": percentile,
    "approx_percentile_cont_with_weight": lambda args, keys, distinct: f"percentile({keys[0][0]}, {args[1]}, {args[0]})",
    "mean": lambda args, keys, distinct: f"avg({args[0]})",
    "covar": lambda args, keys, distinct: f"covar_samp({args[0]}, {args[1]})",
    "var": lambda args, keys, distinct: f"var_samp({args[0]})",
    "var_sample": lambda args, keys, distinct: f"var_samp({args[0]})",
    "var_population": lambda args, keys, distinct: f"var_pop({args[0]})",
    "stddev": lambda args, keys, distinct: f"stddev_samp({args[0]})",
}
