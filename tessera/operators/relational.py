"""Joins, set operations, unnesting and recursion that Spark's DataFrame API has in another shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SWAPPED = {"right_semi": "left_semi", "right_anti": "left_anti", "rightsemi": "left_semi", "rightanti": "left_anti"}
_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftsemi": "left_semi", "leftanti": "left_anti", "left_semi": "left_semi", "left_anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, how: str, left_on: list[str], right_on: list[str], extra: Column | None = None) -> DataFrame:
    """Equi-join with a residual condition; right semi and anti joins swap the sides, mark joins add ``mark``."""
    conditions = [left[a] == right[b] for a, b in zip(left_on, right_on)] + ([extra] if extra is not None else [])
    return join_on(left, right, how, reduce(lambda a, b: a & b, conditions) if conditions else None)


def join_on(left: DataFrame, right: DataFrame, how: str, on: Column | None) -> DataFrame:
    how = how.lower().replace(" ", "_")
    if how in ("left_mark", "leftmark"):
        return mark_join(left, right, on)
    if how in ("right_mark", "rightmark"):
        return mark_join(right, left, on)
    if how in _SWAPPED:
        return right.join(left, on, _SWAPPED[how])
    return left.crossJoin(right) if on is None and how == "inner" else left.join(right, on, _HOW[how])


def mark_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Each left row with whether it has a partner: the left rows with one and those without, united.

    Rows pass by their own values, not by numbers, so both branches agree whatever order they run in.
    """
    return left.join(right, on, "left_semi").withColumn("mark", F.lit(True)).unionAll(left.join(right, on, "left_anti").withColumn("mark", F.lit(False)))


def null_safe_join(left: DataFrame, right: DataFrame, how: str, left_on: list[str], right_on: list[str]) -> DataFrame:
    """NULL keys match each other."""
    return join_on(left, right, how, reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in zip(left_on, right_on)]))


def unnest(df: DataFrame, names: list[str], preserve_nulls: bool = True) -> DataFrame:
    """Lists to rows (several zipped, padded with NULL), structs to columns; empty lists give no row."""
    kinds = dict(df.dtypes)
    lists = [n for n in names if kinds[n].startswith("array")]
    for n in (n for n in names if kinds[n].startswith("struct")):
        fields = [F.col(f"{n}.{f.name}").alias(f"{n}.{f.name}") for f in df.schema[n].dataType.fields]
        df = df.select(*(x for c in df.columns for x in (fields if c == n else [F.col(f"`{c}`")])))
    if not lists:
        return df
    longest = F.greatest(*(F.coalesce(F.size(F.coalesce(n, F.array())), F.lit(0)) for n in lists), F.lit(0))
    all_null = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in lists])
    count = F.when(all_null, F.lit(1 if preserve_nulls else 0)).otherwise(longest)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    spread = df.withColumn("__at", F.explode(places))
    return spread.select(*(F.get(F.col(c), F.col("__at")).alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns))


def union_by_name_all(parts: list[tuple[DataFrame, bool]]) -> DataFrame:
    """Frames united by column name, absent columns NULL; a part said to be distinct drops repeated rows so far."""
    out = parts[0][0]
    for df, distinct in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
        out = out.distinct() if distinct else out
    return out


def split_by_name(sql: str) -> list[tuple[str, bool]] | None:
    """The branches of a UNION [ALL] BY NAME at the outermost level, or None."""
    import re

    depth, quote, starts = 0, "", []
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[()]|\bUNION(\s+ALL)?\s+BY\s+NAME\b", sql, re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth and m[0][0] not in "'\"":
            starts.append((m.start(), m.end(), not m[1]))
    if not starts:
        return None
    out, at, distinct = [], 0, False
    for s, e, d in starts:
        out.append((sql[at:s], distinct))
        at, distinct = e, d
    return [*out, (sql[at:], distinct)]


def fixpoint(seed: DataFrame, step, folder: str, distinct: bool = True, rounds: int = 10_000) -> DataFrame:
    """Recursion with UNION (distinct): rounds of ``step`` over the rows that are new, until there are none.

    Each round's rows are written to the shared ``folder``, which cuts the lineage; only a count comes
    to the driver.
    """
    spark = seed.sparkSession

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/round-{k}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round-{k}")

    found = new = kept(seed.distinct() if distinct else seed, 0)
    for k in range(1, rounds):
        made = step(new)
        made = made.toDF(*seed.columns)
        new = kept(made.distinct().subtract(found) if distinct else made, k)
        if new.isEmpty():
            break
        found = found.unionAll(new)
    return found


_RECURSIVE = r"\s*WITH\s+RECURSIVE\s+(\w+)\s*(\([^()]*\))?\s+AS\s*\("


def split_recursion(sql: str) -> tuple[str, list[str], str, str, str] | None:
    """(name, columns, seed, step, rest) of ``WITH RECURSIVE name AS (seed UNION step) rest`` with a UNION that isn't ALL."""
    import re

    m = re.match(_RECURSIVE, sql, re.I)
    if not m:
        return None
    depth, union = 1, None
    for t in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[()]|\bUNION\b(\s+ALL\b|\s+DISTINCT\b)?", sql[m.end() :], re.I):
        if t[0] in "()":
            depth += 1 if t[0] == "(" else -1
            if not depth:
                break
        elif depth == 1 and t[0][0] not in "'\"":
            union = t
    if union is None or (union[1] or "").strip().upper() == "ALL":
        return None
    body, at = sql[m.end() :], m.end()
    rest = sql[at + t.end() :]
    if rest.lstrip().startswith(","):
        return None
    columns = [c.strip() for c in (m[2] or "()")[1:-1].split(",") if c.strip()]
    return m[1], columns, body[: union.start()], body[union.end() : t.start()], rest
