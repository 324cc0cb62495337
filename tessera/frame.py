"""The DataFrame surface: names and defaults of the engine over a Spark DataFrame.

Texts given as expressions are in the engine's dialect.  ``df`` is the Spark DataFrame underneath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.udf import merged
from tessera.operators import aggregation, relational
from tessera.plans import dialect


class Frame:
    def __init__(self, df: DataFrame, session=None):
        self.df, self.session = df, session

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, self.session)

    def _col(self, e: str | Column) -> Column:
        if isinstance(e, Column):
            return e
        return dialect.column(e, self.df)

    # -- projection and filter ----------------------------------------------------------------

    def select(self, *exprs) -> Frame:
        return self._new(self.df.select(*map(self._col, exprs)))

    select_exprs = select

    def select_columns(self, *names: str) -> Frame:
        return self._new(self.df.select(*(F.col(f"`{n}`") for n in names)))

    def drop_columns(self, *names: str) -> Frame:
        return self._new(self.df.drop(*names))

    def filter(self, condition) -> Frame:
        return self._new(self.df.where(self._col(condition)))

    def with_column(self, name: str, e) -> Frame:
        return self._new(self.df.withColumn(name, self._col(e)))

    def with_column_renamed(self, old: str, new: str) -> Frame:
        return self._new(self.df.withColumnRenamed(old, new))

    def alias(self, name: str) -> Frame:
        return self._new(self.df.alias(name))

    def unnest_columns(self, *names: str, preserve_nulls: bool = True) -> Frame:
        return self._new(relational.unnest(self.df, list(names), preserve_nulls))

    unnest_columns_with_options = unnest_columns

    def fill_null(self, value, columns: list[str] | None = None) -> Frame:
        return self._new(self.df.fillna(value, columns or None))

    # -- aggregation and windows --------------------------------------------------------------

    def aggregate(self, keys: list, aggregates: list) -> Frame:
        return self._new(self.df.groupBy(*map(self._col, keys)).agg(*map(self._col, aggregates)))

    def aggregate_merging(self, keys: list[str], arguments: list[str], made, name: str, returns: str) -> Frame:
        """A user aggregate (``functions.udf.Merging``) by keys."""
        return self._new(merged(self.df, keys, arguments, made, name, returns))

    def window(self, *exprs) -> Frame:
        return self._new(self.df.select("*", *map(self._col, exprs)))

    def distinct(self) -> Frame:
        return self._new(self.df.distinct())

    def distinct_on(self, on: list, select: list, order: list | None = None) -> Frame:
        keys = list(map(self._col, on))
        by = [self._order(o) for o in order] if order else keys
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return self._new(self.df.select(*map(self._col, select), nth.alias("__nth")).where("__nth = 1").drop("__nth"))

    def describe(self) -> Frame:
        return self._new(aggregation.describe(self.df))

    # -- order and limits ---------------------------------------------------------------------

    def _order(self, key) -> Column:
        """A key as text may end in ASC or DESC and NULLS FIRST or LAST; NULLs are the largest values."""
        if isinstance(key, Column):
            return key
        text, up = key.upper(), key
        nulls = "first" if text.endswith("NULLS FIRST") else "last" if text.endswith("NULLS LAST") else None
        up = up[: text.rindex("NULLS")].rstrip() if nulls else up
        down = up.upper().endswith(" DESC")
        column = self._col(up.rsplit(None, 1)[0] if up.upper().endswith((" DESC", " ASC")) else up)
        return getattr(column, f"{'desc' if down else 'asc'}_nulls_{nulls or ('first' if down else 'last')}")()

    def sort(self, *keys) -> Frame:
        return self._new(self.df.orderBy(*map(self._order, keys)))

    sort_by = sort

    def limit(self, skip: int = 0, fetch: int | None = None) -> Frame:
        df = self.df.offset(skip) if skip else self.df
        return self._new(df if fetch is None else df.limit(fetch))

    def repartition(self, n: int, *keys: str) -> Frame:
        return self._new(self.df.repartition(n, *keys))

    # -- joins and sets -----------------------------------------------------------------------

    def join(self, other: Frame, how: str, left: list[str], right: list[str], filter: str | None = None) -> Frame:
        return self._new(relational.join(self.df, other.df, how, left, right, self._col(filter) if filter else None))

    def join_on(self, other: Frame, how: str, conditions: list) -> Frame:
        on = None
        for c in map(self._col, conditions):
            on = c if on is None else on & c
        return self._new(relational.join_on(self.df, other.df, how, on))

    def union(self, other: Frame) -> Frame:
        return self._new(self.df.unionAll(other.df))

    def union_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.union(other.df).distinct())

    def union_by_name(self, other: Frame) -> Frame:
        return self._new(self.df.unionByName(other.df, allowMissingColumns=True))

    def union_by_name_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.unionByName(other.df, allowMissingColumns=True).distinct())

    def intersect(self, other: Frame) -> Frame:
        return self._new(self.df.intersectAll(other.df))

    def intersect_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.intersect(other.df))

    def except_(self, other: Frame) -> Frame:
        return self._new(self.df.exceptAll(other.df))

    def except_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.subtract(other.df))

    # -- results ------------------------------------------------------------------------------

    def count(self) -> int:
        return self.df.count()

    def collect(self):
        return self.df.toArrow()

    def collect_partitioned(self) -> list[list]:
        """Rows by partition, as ``execute_stream_partitioned`` but all at once: for results that fit the driver."""
        return [list(rows) for rows in self.execute_stream_partitioned()]

    def execute_stream(self):
        return self.df.toLocalIterator(prefetchPartitions=True)

    def execute_stream_partitioned(self) -> list:
        """An iterator to each partition of the frame's plan, in their order."""
        import itertools

        marked = self.df.withColumn("__part", F.spark_partition_id())
        runs = itertools.groupby(marked.toLocalIterator(), key=lambda r: r["__part"])
        return ((tuple(r)[:-1] for r in rows) for _, rows in runs)

    def coalesce(self, n: int) -> Frame:
        """At most ``n`` partitions, without a shuffle."""
        return self._new(self.df.coalesce(n))

    def into_parts(self) -> tuple:
        """The session and the plan."""
        return self.session, self.logical_plan()

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    show_limit = show

    def to_string(self, n: int = 20) -> str:
        return self.df._jdf.showString(n, 0, False)

    def schema(self):
        return self.df.schema

    def logical_plan(self) -> str:
        return self.df._jdf.queryExecution().logical().toString()

    into_unoptimized_plan = logical_plan

    def into_optimized_plan(self) -> str:
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def create_physical_plan(self) -> str:
        return self.df._jdf.queryExecution().executedPlan().toString()

    def explain(self, verbose: bool = False, analyze: bool = False) -> Frame:
        from tessera.plans.statements import explained

        return self._new(explained(self.df, "extended" if verbose else "formatted", analyze))

    explain_with_options = explain

    def into_view(self, name: str) -> None:
        self.session.register_table(name, self.df)

    def cache(self) -> Frame:
        return self._new(self.df.cache())

    def registry(self) -> list[str]:
        return [f.name for f in self.df.sparkSession.catalog.listFunctions()]

    def with_param_values(self, params) -> Frame:
        """A frame's placeholders all have values; those without are ``session.Open``."""
        return self

    # -- writers ------------------------------------------------------------------------------

    def _write(self, path: str, form: str, **options) -> int:
        from tessera.sources.files import write

        return write(self.df, path, form, **options)

    def write_parquet(self, path: str, **options) -> int:
        return self._write(path, "parquet", **options)

    def write_csv(self, path: str, **options) -> int:
        return self._write(path, "csv", **options)

    def write_json(self, path: str, **options) -> int:
        return self._write(path, "json", **options)

    def write_arrow(self, path: str, **options) -> int:
        return self._write(path, "arrow", **options)

    def write_table(self, name: str, overwrite: bool = False) -> None:
        if self.df.sparkSession.catalog.tableExists(name):
            self.df.write.insertInto(name, overwrite=overwrite)
        else:
            self.df.write.saveAsTable(name)
