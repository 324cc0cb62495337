"""String and regular-expression functions."""

from __future__ import annotations


def constant(text: str) -> str | None:
    """The value of a string literal, or None for any other expression."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] == "'" and "'" not in t[1:-1].replace("''", ""):
        return t[1:-1].replace("''", "'").replace("\\\\", "\\")
    return None


def quoted(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_flags(pattern: str, flags: str | None) -> str:
    """The pattern with its flags inline (``g`` is not the pattern's)."""
    kept = "".join(c for c in (constant(flags) or "") if c != "g") if flags else ""
    return f"concat('(?{kept})', {pattern})" if kept else pattern


def split_on(text: str, delimiter: str) -> str:
    return f"split({text}, concat('\\\\Q', {delimiter}, '\\\\E'), -1)"


def _trim(where: str):
    return lambda s, chars=None: f"trim({where} {chars} FROM {s})" if chars else f"trim({where} FROM {s})"


def left(s: str, n: str) -> str:
    return f"if(({n}) < 0, substr({s}, 1, greatest(length({s}) + ({n}), 0)), left({s}, {n}))"


def right(s: str, n: str) -> str:
    return f"if(({n}) < 0, substr({s}, 1 - ({n})), right({s}, {n}))"


def substr(s: str, start: str, length: str | None = None) -> str:
    """A window of characters that may begin before the text."""
    if length is None:
        return f"substring({s}, greatest({start}, 1))"
    return f"substring({s}, greatest({start}, 1), greatest(({length}) + least(({start}) - 1, 0), 0))"


def initcap(s: str) -> str:
    """Words are runs of letters and digits."""
    return f"array_join(transform(regexp_extract_all({s}, '([A-Za-z0-9\\\\u00c0-\\\\uffff]+|[^A-Za-z0-9\\\\u00c0-\\\\uffff]+)', 1), w -> initcap(w)), '')"


def groups_of(pattern: str) -> int:
    """Capture groups of a constant pattern."""
    n, escaped, in_class = 0, False, False
    for i, c in enumerate(pattern):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(" and (pattern[i + 1 : i + 2] != "?" or pattern[i + 2 : i + 4] in ("P<",) or (pattern[i + 2 : i + 3] == "<" and pattern[i + 3 : i + 4] not in ("=", "!"))):
            n += 1
    return n


def regexp_match(s: str, pattern: str, flags: str | None = None) -> str:
    """The capture groups of the first match (the match itself without groups); NULL without a match."""
    full = with_flags(pattern, flags)
    count = groups_of(constant(pattern) or "")
    parts = ", ".join(f"regexp_extract({s}, {full}, {i})" for i in (range(1, count + 1) if count else (0,)))
    return f"if(regexp_like({s}, {full}), array({parts}), null)"


def regexp_replace(s: str, pattern: str, replacement: str, flags: str | None = None) -> str:
    """Replaces the first match, all of them with the flag ``g``; groups as ``\\1`` in the replacement."""
    import re

    full = with_flags(pattern, flags)
    value = constant(replacement)
    to = quoted(re.sub(r"\\(\d)", r"$\1", value)) if value is not None else f"regexp_replace({replacement}, '\\\\\\\\([0-9])', '\\\\$$1')"
    if flags and "g" in (constant(flags) or ""):
        return f"regexp_replace({s}, {full}, {to})"
    # what stands before the first match is kept and the rest left as it was
    at = f"regexp_instr({s}, {full})"
    found = f"regexp_extract({s}, {full}, 0)"
    return f"if({at} = 0, {s}, concat(substr({s}, 1, {at} - 1), regexp_replace({found}, {full}, {to}), substr({s}, {at} + length({found}))))"


def regexp_count(s: str, pattern: str, start: str | None = None, flags: str | None = None) -> str:
    return f"regexp_count({f'substr({s}, {start})' if start else s}, {with_flags(pattern, flags)})"


def regexp_instr(s: str, pattern: str, start: str = "1", nth: str = "1", flags: str | None = None, group: str | None = None) -> str:
    """The place of the n-th match from a place on; matches lie between the parts that splitting leaves."""
    full = with_flags(pattern, flags)
    text = s if start.strip() == "1" else f"substr({s}, {start})"
    if group and group.strip() != "0":
        whole = f"regexp_extract({text}, {full}, 0)"
        return f"if(regexp_like({text}, {full}), regexp_instr({text}, {full}) + instr({whole}, regexp_extract({text}, {full}, {group})) + ({start}) - 2, 0)"
    if nth.strip() == "1":
        return f"if(regexp_instr({text}, {full}) = 0, 0, regexp_instr({text}, {full}) + ({start}) - 1)"
    before = f"aggregate(slice(zip_with(split({text}, {full}, -1), regexp_extract_all({text}, {full}, 0), (a, b) -> length(a) + coalesce(length(b), 0)), 1, ({nth}) - 1), 0, (x, y) -> x + y)"
    return f"if(regexp_count({text}, {full}) < ({nth}), 0, {before} + length(get(split({text}, {full}, -1), ({nth}) - 1)) + ({start}))"


REWRITES = {
    "btrim": lambda s, chars=None: f"btrim({s}, {chars})" if chars else f"trim({s})",
    "trim": lambda s, chars=None: f"btrim({s}, {chars})" if chars else f"trim({s})",
    "ltrim": _trim("LEADING"),
    "rtrim": _trim("TRAILING"),
    "chr": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')",
    "concat": lambda *parts: f"concat_ws('', {', '.join(parts)})",
    "ends_with": lambda s, t: f"endswith({s}, {t})",
    "starts_with": lambda s, t: f"startswith({s}, {t})",
    "to_hex": lambda n: f"lower(hex({n}))",
    "initcap": initcap,
    "left": left,
    "right": right,
    "strpos": lambda s, t: f"instr({s}, {t})",
    "substr": substr,
    "substring": substr,
    "substr_index": lambda s, d, n: f"substring_index({s}, {d}, {n})",
    "regexp_match": regexp_match,
    "regexp_replace": regexp_replace,
    "regexp_count": regexp_count,
    "regexp_instr": regexp_instr,
    "regexp_like": lambda s, p, flags=None: f"regexp_like({s}, {with_flags(p, flags)})",
    "string_to_array": lambda s, d, null=None: split_on(s, d) if null is None else f"transform({split_on(s, d)}, e -> nullif(e, {null}))",
    "string_to_list": lambda s, d, null=None: split_on(s, d) if null is None else f"transform({split_on(s, d)}, e -> nullif(e, {null}))",
    "uuid": lambda: "uuid()",
}
