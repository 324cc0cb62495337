"""Date and time functions."""

from __future__ import annotations

from tessera.functions.strings import constant, quoted

#: Strftime fields and the patterns that print them.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "j": "DDD", "I": "hh", "p": "a", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "f": "SSSSSS", "z": "xx", "Z": "zzz", "%": "%",
}


def pattern(strftime: str) -> str:
    """A strftime format as a date pattern; other letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            while strftime[i] in ".-369" and i + 1 < len(strftime):
                i += 1
            out.append(STRFTIME.get(strftime[i], strftime[i]))
        else:
            out.append(f"'{c}'" if c.isalpha() else c)
        i += 1
    return "".join(out).replace("''", "")


def _format(f: str) -> str:
    value = constant(f)
    return f if value is None or "%" not in value else quoted(pattern(value))


def date_bin(interval: str, ts: str, origin: str | None = None) -> str:
    """Start of the bin of a fixed width that holds a time, counted from the origin (floor before it)."""
    months = _months(interval)
    if months:
        start = origin or "timestamp_ntz'1970-01-01 00:00:00'"
        steps = f"floor((months_between(date_trunc('month', {ts}), date_trunc('month', {start}))) / {months}) * {months}"
        return f"add_months(date_trunc('month', {start}), cast({steps} AS int))"
    width = str(_micros(interval))
    start = f"unix_micros(cast({origin} AS timestamp_ltz))" if origin else "0"
    return f"cast(timestamp_micros(unix_micros(cast({ts} AS timestamp_ltz)) - pmod(unix_micros(cast({ts} AS timestamp_ltz)) - {start}, {width})) AS timestamp_ntz)"


_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def _words(interval: str) -> list[tuple[float, str]]:
    words = interval.replace("'", " ").split()
    if words and words[0].lower() == "interval":
        words = words[1:]
    return [(float(n), u.lower().rstrip("s")) for n, u in zip(words[::2], words[1::2])]


def _micros(interval: str) -> int:
    return int(sum(n * _UNITS[u] for n, u in _words(interval)))


def _months(interval: str) -> int:
    return int(sum(n * {"month": 1, "year": 12, "quarter": 3}.get(u, 0) for n, u in _words(interval)))


def date_part(part: str, ts: str) -> str:
    field = (constant(part) or part).lower()
    if field in ("dow", "dayofweek"):
        return f"(dayofweek({ts}) - 1)"
    if field == "doy":
        return f"dayofyear({ts})"
    if field == "isodow":
        return f"(weekday({ts}) + 1)"
    if field == "epoch":
        return f"(unix_micros(cast({ts} AS timestamp_ltz)) / 1e6D)"
    if field in ("second", "seconds"):
        return f"cast(floor(extract(second FROM {ts})) AS int)"
    if field in ("millisecond", "milliseconds"):
        return f"cast(floor(extract(second FROM {ts}) * 1000) AS int)"
    if field in ("microsecond", "microseconds"):
        return f"cast(floor(extract(second FROM {ts}) * 1000000) AS int)"
    return f"extract({field} FROM {ts})"


def date_trunc(unit: str, ts: str) -> str:
    return f"cast(date_trunc({unit}, {ts}) AS timestamp_ntz)"


def _parsed(kind: str, convert: str):
    """Formats are tried in order; without any, ISO texts."""

    def rewrite(x: str, *formats: str) -> str:
        if not formats:
            return convert.format(x=x)
        return "coalesce(" + ", ".join(f"try_{kind}({x}, {_format(f)})" for f in formats) + ")"

    return rewrite


REWRITES = {
    "today": lambda: "current_date()",
    "now": lambda: "current_timestamp()",
    "current_time": lambda: "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')",
    "date_bin": date_bin,
    "date_part": date_part,
    "datepart": date_part,
    "date_trunc": date_trunc,
    "datetrunc": date_trunc,
    "from_unixtime": lambda n, tz=None: f"from_utc_timestamp(timestamp_seconds({n}), {tz})" if tz else f"timestamp_seconds({n})",
    "to_char": lambda x, f: f"date_format({x}, {_format(f)})",
    "date_format": lambda x, f: f"date_format({x}, {_format(f)})",
    "to_date": _parsed("to_date", "to_date({x})"),
    "to_local_time": lambda ts: f"cast({ts} AS timestamp_ntz)",
    "to_timestamp": _parsed("to_timestamp", "cast({x} AS timestamp_ltz)"),
    "to_timestamp_seconds": lambda x, *f: f"date_trunc('second', cast({x} AS timestamp_ltz))" if not f else _parsed("to_timestamp", "")(x, *f),
    "to_timestamp_millis": lambda x, *f: f"timestamp_millis({x})" if not f else _parsed("to_timestamp", "")(x, *f),
    "to_timestamp_micros": lambda x, *f: f"timestamp_micros({x})" if not f else _parsed("to_timestamp", "")(x, *f),
    "to_timestamp_nanos": lambda x, *f: f"timestamp_micros(({x}) div 1000)" if not f else _parsed("to_timestamp", "")(x, *f),
    "to_unixtime": lambda x, *f: f"unix_timestamp(cast({x} AS timestamp_ltz))" if not f else f"unix_timestamp({x}, {_format(f[0])})",
}
