"""Unbounded inputs as Structured Streaming: sources, windowed aggregation, joins, state and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import folder


def stream(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Files of a folder as they arrive; without a schema, that of the files present."""
    from tessera.sources.files import CSV, read

    reader = spark.readStream.format(form)
    reader = reader.schema(schema) if schema else reader.schema(read(spark, path, form, **options).schema)
    for key, value in options.items():
        reader = reader.option(CSV.get(key, key), value)
    return reader.load(path)


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by bins of time; a bin closes when the watermark passes its end."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sliding(df: DataFrame, time: str, width: str, slide: str, late: str, keys: list[str], *aggregates) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, late: str, lower: str, upper: str) -> DataFrame:
    """Symmetric join of two streams: equal keys, and the right time within an interval of the left one.

    Watermarks on both sides and the range let Spark drop rows from the state that can't match any more.
    """
    a = left.withWatermark(time, late).select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.withWatermark(time, late).select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & F.expr(f"r_{time} BETWEEN l_{time} + INTERVAL {lower} AND l_{time} + INTERVAL {upper}")
    return a.join(b, on)


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_count(df: DataFrame, key: str) -> DataFrame:
    """A window function over an endless input: each row's number within its key, from one counter of state."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "n": range(n + 1, n + 1 + len(batch))})
            n += len(batch)
        state.update((n,))

    kind = dict(df.dtypes)[key]
    return df.select(key).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long", "n long", "append", "NoTimeout")


def _checkpoint(spark: SparkSession) -> str:
    return folder(spark, "stream")


def to_files(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Append what there is to files, exactly once, and stop."""
    df.writeStream.format(form).option("path", path).option("checkpointLocation", _checkpoint(df.sparkSession)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_available(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return its result as a table of files in the shared folder."""
    spark, folder = df.sparkSession, _checkpoint(df.sparkSession)
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{folder}/out")
        else:  # a batch that runs again replaces its own files
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    return out.select(*schema.names)
