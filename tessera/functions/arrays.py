"""Array functions: 1-based, tolerant of places out of range, and with NULL elements equal to each other."""

from __future__ import annotations


def _either_null(a: str, b: str, then: str) -> str:
    return f"if(({a}) IS NULL OR ({b}) IS NULL, NULL, {then})"


def element(a: str, n: str) -> str:
    return f"if(({n}) = 0, NULL, try_element_at({a}, cast(if(({n}) = 0, 1, {n}) AS int)))"


def slice_(a: str, begin: str, end: str, stride: str | None = None) -> str:
    """From begin to end, both inclusive; negative places count from the end."""
    b = f"if(({begin}) < 0, size({a}) + ({begin}) + 1, ({begin}))"
    e = f"if(({end}) < 0, size({a}) + ({end}) + 1, ({end}))"
    first, last = f"cast(greatest({b}, 1) AS int)", f"cast(least({e}, size({a})) AS int)"
    cut = f"slice({a}, {first}, greatest({last} - {first} + 1, 0))"
    return cut if stride is None else f"filter({cut}, (e, i) -> i % ({stride}) = 0)"


def fold(a: str, hit: str, most: str, instead: str | None) -> str:
    """The first ``most`` elements equal to ``hit`` replaced, or dropped."""
    put = f"concat(z.o, array({instead}))" if instead is not None else "z.o"
    zero = f"named_struct('o', slice({a}, 1, 0), 'c', 0)"
    return f"aggregate({a}, {zero}, (z, e) -> if(e <=> ({hit}) AND z.c < ({most}), named_struct('o', {put}, 'c', z.c + 1), named_struct('o', concat(z.o, array(e)), 'c', z.c)), z -> z.o)"


def position(a: str, x: str, start: str = "1") -> str:
    """The first place of an element from a place on, NULL without one."""
    return f"array_min(filter(transform({a}, (e, i) -> if(e <=> ({x}) AND i + 1 >= ({start}), i + 1, NULL)), p -> p IS NOT NULL))"


def sort(a: str, order: str = "'ASC'", nulls: str = "'NULLS FIRST'") -> str:
    """NULLs come first in both directions unless said otherwise."""
    down = "desc" in order.lower()
    some = f"filter({a}, e -> e IS NOT NULL)"
    none = f"filter({a}, e -> e IS NULL)"
    body = f"sort_array({some}, {'false' if down else 'true'})"
    return f"concat({none}, {body})" if "first" in nulls.lower() else f"concat({body}, {none})"


def series(start: str, stop: str, step: str | None, inclusive: bool) -> str:
    """Steps from start; empty if they lead away from stop, and without the stop itself if exclusive."""
    if step is not None and "interval" in step.lower():
        whole = f"if(({start}) <= ({stop}), sequence({start}, {stop}, {step}), array())"
        return whole if inclusive else f"filter({whole}, e -> e < ({stop}))"
    step = step or "1"
    run = f"if((({stop}) - ({start})) * sign({step}) >= 0, sequence({start}, {stop}, {step}), slice(sequence({start}, {start}), 1, 0))"
    return run if inclusive else f"filter({run}, e -> e <> ({stop}))"


def _range(*x: str) -> str:
    return series("0", x[0], None, False) if len(x) == 1 else series(x[0], x[1], x[2] if len(x) > 2 else None, False)


def _has(a: str, x: str) -> str:
    return f"if(({a}) IS NULL OR ({x}) IS NULL, NULL, coalesce(array_contains({a}, {x}), false))"


def _dims(a: str) -> str:
    return f"array(size({a}), size(get({a}, 0)))"


_ONE = {
    "array_has": _has,
    "array_has_all": lambda a, b: _either_null(a, b, f"size(array_except({b}, {a})) = 0"),
    "array_has_any": lambda a, b: _either_null(a, b, f"size(array_intersect({a}, {b})) > 0"),
    "cardinality": lambda a: f"size({a})",
    "array_append": lambda a, x: f"concat(coalesce({a}, array()), array({x}))",
    "array_prepend": lambda x, a: f"concat(array({x}), coalesce({a}, array()))",
    "array_concat": lambda *xs: f"if({' AND '.join(f'({x}) IS NULL' for x in xs)}, NULL, concat({', '.join(f'coalesce({x}, array())' for x in xs)}))",
    "array_dims": _dims,
    "array_ndims": lambda a: f"((length(typeof({a})) - length(replace(typeof({a}), 'array<', ''))) div 6)",
    "array_distance": lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (p, q) -> power(cast(p AS double) - q, 2)), 0d, (p, q) -> p + q))",
    "empty": lambda a: f"(size({a}) = 0)",
    "array_element": element,
    "array_slice": slice_,
    "array_pop_front": lambda a: f"if(size({a}) = 0, {a}, slice({a}, 2, size({a})))",
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))",
    "array_any_value": lambda a: f"get(filter({a}, e -> e IS NOT NULL), 0)",
    "flatten": lambda a: f"flatten(filter({a}, e -> e IS NOT NULL))",
    "array_length": lambda a, d="1": f"if(({a}) IS NULL, NULL, {f'size({a})' if d.strip() == '1' else f'size(get({a}, 0))'})",
    "make_array": lambda *xs: f"array({', '.join(xs)})",
    "array_position": position,
    "array_positions": lambda a, x: f"filter(transform({a}, (e, i) -> if(e <=> ({x}), i + 1, NULL)), p -> p IS NOT NULL)",
    "array_remove": lambda a, x: fold(a, x, "1", None),
    "array_remove_n": lambda a, x, n: fold(a, x, n, None),
    "array_remove_all": lambda a, x: f"filter({a}, e -> NOT (e <=> ({x})))",
    "array_replace": lambda a, x, y: fold(a, x, "1", y),
    "array_replace_n": lambda a, x, y, n: fold(a, x, n, y),
    "array_replace_all": lambda a, x, y: f"transform({a}, e -> if(e <=> ({x}), {y}, e))",
    "array_resize": lambda a, n, x="NULL": f"slice(concat({a}, array_repeat({x}, greatest(cast({n} AS int) - size({a}), 0))), 1, cast({n} AS int))",
    "array_reverse": lambda a: f"reverse({a})",
    "array_union": lambda a, b: f"concat(sort_array(array_distinct(coalesce({a}, array()))), sort_array(array_except(coalesce({b}, array()), coalesce({a}, array()))))",
    "array_intersect": lambda a, b: f"sort_array(array_intersect(coalesce({a}, array()), coalesce({b}, array())))",
    "array_distinct": lambda a: f"sort_array(array_distinct({a}))",
    "array_sort": sort,
    "array_to_string": lambda a, d, null=None: f"array_join(transform({a}, e -> cast(e AS string)), {d}{', ' + null if null else ''})",
    "array_except": lambda a, b: f"array_except({a}, {b})",
    "array_max": lambda a: f"array_max({a})",
    "array_min": lambda a: f"array_min({a})",
    "array_repeat": lambda x, n: f"array_repeat({x}, cast({n} AS int))",
    "range": _range,
    "generate_series": lambda a, b, s=None: series(a, b, s, True),
}

#: Other names of the array functions.
ALIASES = {
    "array_contains": "array_has", "list_contains": "array_has", "list_has": "array_has", "list_has_all": "array_has_all", "list_has_any": "array_has_any", "arrays_overlap": "array_has_any",
    "array_push_back": "array_append", "list_push_back": "array_append", "array_push_front": "array_prepend", "list_push_front": "array_prepend", "array_cat": "array_concat", "list_cat": "array_concat",
    "array_empty": "empty", "array_extract": "array_element", "list_extract": "array_element", "array_indexof": "array_position", "list_indexof": "array_position",
    "make_list": "make_array", "array_join": "array_to_string", "list_join": "array_to_string",
}

REWRITES = dict(_ONE)
REWRITES |= {"list_" + k.removeprefix("array_"): v for k, v in _ONE.items() if k.startswith("array_")}
REWRITES |= {alias: _ONE[name] for alias, name in ALIASES.items()}
