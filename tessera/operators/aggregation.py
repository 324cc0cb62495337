"""Aggregations in shapes of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def describe(df: DataFrame) -> DataFrame:
    """count, null_count, mean, std, min, max and median of each column, in one pass over the table."""
    kinds = dict(df.dtypes)
    rules = {
        "count": lambda c: F.count(c).cast("double"),
        "null_count": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
        "mean": lambda c: F.avg(c) if kinds[c].startswith(_NUMBERS) else F.lit(None),
        "std": lambda c: F.stddev_samp(c) if kinds[c].startswith(_NUMBERS) else F.lit(None),
        "min": F.min,
        "max": F.max,
        "median": lambda c: F.median(c) if kinds[c].startswith(_NUMBERS) else F.lit(None),
    }
    wide = df.agg(*(rule(c).cast("string").alias(f"{name}|{c}") for name, rule in rules.items() for c in df.columns))
    rows = F.array(*(F.struct(F.lit(name).alias("describe"), *(F.col(f"`{name}|{c}`").alias(c) for c in df.columns)) for name in rules))
    return wide.select(F.inline(rows))


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, aggregate: Column, name: str) -> DataFrame:
    """A GROUPS frame: peers are numbered, and a RANGE over the numbers spans them."""
    numbered = df.withColumn("__peers", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("__peers").rangeBetween(start, end)
    return numbered.withColumn(name, aggregate.over(frame)).drop("__peers")


def ntile(n: int, partition: list[str], order: list[Column]) -> Column:
    """Buckets by floor(place * n / rows), which spreads a remainder over all buckets."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return (F.floor(place * F.least(F.lit(n), rows) / rows) + 1).cast("bigint")

