"""Core, digest and encoding functions."""

from __future__ import annotations

import re

from tessera.functions.strings import constant

#: Arrow type names and the Spark types that hold them.
ARROW = {
    "Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint",
    "UInt64": "decimal(20,0)", "Float16": "float", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Utf8View": "string",
    "Binary": "binary", "LargeBinary": "binary", "BinaryView": "binary", "Date32": "date", "Date64": "date",
}
TYPEOF = {"boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "binary": "Binary", "date": "Date32", "timestamp_ntz": "Timestamp(Microsecond, None)", "timestamp": 'Timestamp(Microsecond, Some("+00:00"))'}


def spark_type(arrow: str) -> str:
    """The Spark type of an Arrow type's text."""
    arrow = arrow.strip()
    if arrow in ARROW:
        return ARROW[arrow]
    if m := re.fullmatch(r"Decimal(?:128|256)\((\d+),\s*(-?\d+)\)", arrow):
        return f"decimal({m[1]},{m[2]})"
    if m := re.fullmatch(r"Timestamp\(\w+,\s*(.+)\)", arrow):
        return "timestamp_ntz" if m[1] == "None" else "timestamp"
    if m := re.fullmatch(r"(?:List|LargeList)\((.+)\)", arrow):
        return f"array<{spark_type(m[1])}>"
    if m := re.fullmatch(r"Dictionary\(\w+,\s*(.+)\)", arrow):
        return spark_type(m[1])
    raise ValueError(f"{arrow} has no counterpart")


def digest(x: str, algorithm: str) -> str:
    name = (constant(algorithm) or algorithm).lower()
    if name == "md5":
        return f"unhex(md5({x}))"
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return f"unhex(sha2({x}, {name[3:]}))"
    return f"tessera_digest(cast({x} AS binary), '{name}')"  # blake2b, blake2s, blake3: a vectorised function of the session


def encode(x: str, form: str) -> str:
    if (constant(form) or form).lower() == "hex":
        return f"lower(hex({x}))"
    return f"rtrim('=', base64(cast({x} AS binary)))"


def decode(x: str, form: str) -> str:
    if (constant(form) or form).lower() == "hex":
        return f"unhex({x})"
    return f"unbase64(rpad({x}, cast(ceil(length({x}) / 4.0) * 4 AS int), '='))"


def typeof(x: str) -> str:
    return f"coalesce(element_at(map({', '.join(repr(v) for kv in TYPEOF.items() for v in kv)}), typeof({x})), typeof({x}))"


REWRITES = {
    "arrow_cast": lambda x, t: f"cast({x} AS {spark_type(constant(t) or t)})",
    "arrow_typeof": typeof,
    "get_field": lambda x, f: f"{x}[{f}]",
    "struct": lambda *xs: f"named_struct({', '.join(f"'c{i}', {x}" for i, x in enumerate(xs))})",
    "row": lambda *xs: f"named_struct({', '.join(f"'c{i}', {x}" for i, x in enumerate(xs))})",
    "union_tag": lambda u: f"({u}).tag",
    "union_extract": lambda u, f: f"if(({u}).tag = {f}, ({u}).{constant(f)}, NULL)",
    "digest": digest,
    **{f"sha{n}": (lambda x, n=n: f"unhex(sha2({x}, {n}))") for n in (224, 256, 384, 512)},
    "encode": encode,
    "decode": decode,
    "map": lambda keys, values: f"map_from_arrays({keys}, {values})",
    "make_map": lambda keys, values: f"map_from_arrays({keys}, {values})",
    "map_extract": lambda m, k: f"array(try_element_at({m}, {k}))",
    "element_at": lambda m, k: f"array(try_element_at({m}, {k}))",
}
