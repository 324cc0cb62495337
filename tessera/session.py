"""The session: tables, readers, SQL statements and registration of user functions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.operators import relational
from tessera.plans import dialect
from tessera.sources import files, scratch

#: Settings that the engine's semantics and large clusters call for; a value the user set stays, but for the
#: type that TIMESTAMP stands for, which the dialect relies on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Options of the engine by the Spark settings that stand for them.
OPTIONS = {
    "execution.batch_size": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "execution.target_partitions": "spark.sql.shuffle.partitions",
    "execution.time_zone": "spark.sql.session.timeZone",
    "execution.parquet.pushdown_filters": "spark.sql.parquet.filterPushdown",
    "execution.parquet.compression": "spark.sql.parquet.compression.codec",
    "optimizer.prefer_hash_join": "spark.sql.join.preferSortMergeJoin",
    "optimizer.hash_join_single_partition_threshold": "spark.sql.autoBroadcastJoinThreshold",
    "optimizer.repartition_joins": "spark.sql.adaptive.enabled",
    "optimizer.enable_dynamic_filter_pushdown": "spark.sql.optimizer.dynamicPartitionPruning.enabled",
}
_INVERTED = {"optimizer.prefer_hash_join"}


class Session:
    """Entry point over a SparkSession."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
        for key, value in DEFAULTS.items():
            if self.spark.conf.get(key, None) is None or key == "spark.sql.timestampType":
                self.spark.conf.set(key, value)
        self._prepared: dict[str, str] = {}
        self._variables: dict[str, object] = {}
        self._views: set[str] = set()
        self._digest = False
        self._pending: dict[str, str] = {}

    # -- tables -------------------------------------------------------------------------------

    def register_table(self, name: str, df: DataFrame | Frame) -> None:
        (df.df if isinstance(df, Frame) else df).createOrReplaceTempView(name)
        self._views.add(name.lower())

    def register_batch(self, name: str, batch) -> None:
        """A pyarrow table or batch, or a list of batches."""
        self.register_table(name, self.read_batch(batch))

    def deregister_table(self, name: str) -> bool:
        self._views.discard(name.lower())
        return self.spark.catalog.dropTempView(name)

    def register_folder(self, folder: str, names) -> None:
        """Parquet tables of a folder, each read once a statement names it."""
        self._pending |= {n: f"{folder}/{n}.parquet" for n in names}

    def _touch(self, text: str) -> None:
        for name in [n for n in self._pending if re.search(rf"\b{n}\b", text, re.I)]:
            self.register_parquet(name, self._pending.pop(name))

    def table(self, name: str) -> Frame:
        self._touch(name)
        return Frame(self.spark.table(name), self)

    read_table = table

    def table_exist(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def catalog_names(self) -> list[str]:
        return [c.name for c in self.spark.catalog.listCatalogs()]

    def refresh_catalogs(self) -> None:
        for t in self.spark.catalog.listTables():
            if not t.isTemporary:
                self.spark.catalog.refreshTable(t.name)

    def read_empty(self) -> Frame:
        return Frame(self.spark.range(0).select(), self)

    def read_batch(self, batch) -> Frame:
        import pyarrow as pa

        data = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        data = pa.Table.from_batches(data) if isinstance(data, list) else data
        return Frame(self.spark.createDataFrame(data), self)

    read_batches = read_batch

    def from_columns(self, columns: dict) -> Frame:
        import pyarrow as pa

        return self.read_batch(pa.table(columns))

    def read(self, path: str, form: str | None = None, **options) -> Frame:
        return Frame(files.read(self.spark, path, form, **options), self)

    def read_parquet(self, path: str, **options) -> Frame:
        return self.read(path, "parquet", **options)

    def read_csv(self, path: str, **options) -> Frame:
        return self.read(path, "csv", **options)

    def read_json(self, path: str, **options) -> Frame:
        return self.read(path, "json", **options)

    def read_avro(self, path: str, **options) -> Frame:
        return self.read(path, "avro", **options)

    def read_arrow(self, path: str, **options) -> Frame:
        return self.read(path, "arrow", **options)

    def register_parquet(self, name: str, path: str, **options) -> None:
        self.register_table(name, self.read_parquet(path, **options))

    def register_csv(self, name: str, path: str, **options) -> None:
        self.register_table(name, self.read_csv(path, **options))

    def register_json(self, name: str, path: str, **options) -> None:
        self.register_table(name, self.read_json(path, **options))

    def register_avro(self, name: str, path: str, **options) -> None:
        self.register_table(name, self.read_avro(path, **options))

    def register_arrow(self, name: str, path: str, **options) -> None:
        self.register_table(name, self.read_arrow(path, **options))

    register_listing_table = register_parquet

    # -- functions ----------------------------------------------------------------------------

    def register_udf(self, name: str, function: Callable) -> None:
        """A scalar or aggregate function."""
        if hasattr(function, "eval"):
            raise TypeError("table functions go to register_udtf")
        self.spark.udf.register(name, function)

    register_udaf = register_udwf = register_udf

    def register_udtf(self, name: str, function) -> None:
        self.spark.udtf.register(name, function)

    def deregister_udf(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def register_variable(self, name: str, value) -> None:
        self._variables[name.lstrip("@")] = value

    def table_function(self, name: str, *arguments) -> Frame:
        """A registered table function applied to literals."""
        return Frame(self.spark.sql(f"SELECT * FROM {name}({', '.join(map(_literal, arguments))})"), self)

    def create_physical_expr(self, text: str, df: DataFrame | Frame):
        """An expression resolved against a frame, as a column."""
        return self.parse_sql_expr(text, df.df if isinstance(df, Frame) else df)

    def execute_logical_plan(self, plan) -> Frame:
        """The frame of a logical plan, such as ``Frame.into_parts`` and ``Frame.logical_plan`` give."""
        jvm = self.spark._jvm.org.apache.spark.sql.classic.Dataset
        return Frame(DataFrame(jvm.ofRows(self.spark._jsparkSession, plan), self.spark), self)

    def register_catalog(self, name: str, implementation: str, **options) -> None:
        """A catalog by the class of its Spark plugin; tables are then called name.schema.table."""
        self.spark.conf.set(f"spark.sql.catalog.{name}", implementation)
        for key, value in options.items():
            self.spark.conf.set(f"spark.sql.catalog.{name}.{key}", value)

    def enable_url_table(self) -> Session:
        """Paths in quotes stand for tables in every session; here for the sake of the interface."""
        return self

    # -- SQL ----------------------------------------------------------------------------------

    def _ready(self, text: str) -> None:
        if "tessera_digest(" in text and not self._digest:
            from tessera.functions.udf import digest_function

            self.spark.udf.register("tessera_digest", digest_function())
            self._digest = True

    def _values(self, sql: str) -> dict[str, str]:
        return {at + name: _literal(value) for name, value in self._variables.items() for at in ("@", "@@")}

    def columns_of(self, source: str) -> list[str] | None:
        """Column names of a FROM clause in Spark SQL, or None where it can't stand alone."""
        from pyspark.errors import AnalysisException, ParseException

        try:
            return self.spark.sql(f"SELECT * {source}").columns
        except (AnalysisException, ParseException):
            return None

    def translated(self, sql: str, args: dict | None = None, values: dict[str, str] | None = None) -> str:
        values = self._values(sql) | (values or {})

        def plan(text):
            self._ready(text)
            return (self.spark.sql(text, args=args) if args else self.spark.sql(text))._jdf.queryExecution().analyzed()

        translate = lambda divisions: dialect.translate(sql, divisions, values, self.columns_of)
        # statements that do something aren't run to learn their types
        text = dialect.divided(translate, plan) if re.match(r"\s*(SELECT|WITH|VALUES|FROM|\()", sql, re.I) else translate(None)
        self._ready(text)
        return text

    def parse_sql_expr(self, text: str, df: DataFrame | None = None):
        """An expression as a column; with a frame, divisions follow the types of its columns."""
        values = self._values(text)
        if df is None:
            return F.expr(dialect.expression(text, None, values))
        return dialect.column(text, df, values)

    def sql(self, sql: str, params: dict | list | None = None) -> Frame:
        from tessera.plans.statements import run

        self._touch(sql)
        if params is None and re.match(r"\s*(SELECT|WITH|VALUES)\b", sql, re.I) and re.search(r"\$\w+", re.sub(r"'[^']*'", "", sql)):
            return Open(self, sql)
        return Frame(run(self, sql.strip().rstrip(";").strip(), params), self)

    def sql_with_options(self, sql: str, allow_ddl: bool = True, allow_dml: bool = True, allow_statements: bool = True) -> Frame:
        first = sql.split(None, 1)[0].upper()
        for allowed, words in ((allow_ddl, ("CREATE", "DROP", "ALTER")), (allow_dml, ("INSERT", "COPY", "UPDATE", "DELETE")), (allow_statements, ("SET", "PREPARE", "EXECUTE", "DEALLOCATE"))):
            if not allowed and first in words:
                raise PermissionError(f"{first} isn't allowed here")
        return self.sql(sql)

    def query(self, sql: str, params=None, values: dict[str, str] | None = None) -> DataFrame:
        """A query (no statement) as a Spark DataFrame; ``values`` are texts for placeholders."""
        args = {f"p{k}": v for k, v in (params.items() if isinstance(params, dict) else enumerate(params or [], 1))}
        recursion = relational.split_recursion(sql)
        if recursion:
            return self._recursive(*recursion, params, values)
        sql = self._united_by_name(sql, params, values)
        parts = relational.split_by_name(sql)
        if parts:
            return relational.union_by_name_all([(self.query(text, params, values), distinct) for text, distinct in parts])
        text = self.translated(sql, args, values)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _recursive(self, name: str, columns: list[str], seed: str, step: str, rest: str, params, values) -> DataFrame:
        """Recursion with UNION: the step sees the rows that were new in the last round under the name."""
        first = self.query(seed, params, values)
        first = first.toDF(*columns) if columns else first

        def made(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(name)
            return self.query(step, params, values)

        relational.fixpoint(first, made, scratch.folder(self.spark, "recursion")).createOrReplaceTempView(name)
        return self.query(rest, params, values)

    def _united_by_name(self, sql: str, params, values) -> str:
        """Brackets that hold a UNION BY NAME become views of their own; they see the WITH queries before them."""
        while True:
            span = _bracket_by_name(sql)
            if span is None:
                return sql
            start, end = span
            before = re.match(r"\s*WITH\b", sql, re.I)
            # the common table expressions that are whole before the bracket
            head = re.sub(r",?\s*\w+\s*(?:\([^()]*\))?\s+AS\s*$", "", sql[:start], flags=re.I) if before else ""
            known = head if before and head.strip().upper() != "WITH" and head.count("(") == head.count(")") and head != sql[:start] else ""
            inside = [(f"{known} {text}", distinct) for text, distinct in relational.split_by_name(sql[start + 1 : end])]
            view = f"__united_{uuid.uuid4().hex[:12]}"
            relational.union_by_name_all([(self.query(text, params, values), distinct) for text, distinct in inside]).createOrReplaceTempView(view)
            sql = f"{sql[: start + 1]}SELECT * FROM {view}{sql[end:]}"

    def set_option(self, key: str, value: str) -> None:
        name = key if key in OPTIONS else key.split(".", 1)[-1]
        target = OPTIONS.get(name, key)
        if name in _INVERTED:
            value = {"true": "false", "false": "true"}[value.lower()]
        self.spark.conf.set(target, value)


class Open:
    """A query whose placeholders have no values yet."""

    def __init__(self, session: Session, sql: str):
        self.session, self.text = session, sql

    def with_param_values(self, params: dict | list) -> Frame:
        return self.session.sql(self.text, params)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _bracket_by_name(sql: str) -> tuple[int, int] | None:
    """The innermost brackets that hold a UNION BY NAME of their own."""
    open_: list[tuple[int, bool]] = []
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[()]|\bUNION(?:\s+ALL)?\s+BY\s+NAME\b", sql, re.I):
        if m[0] == "(":
            open_.append((m.start(), False))
        elif m[0] == ")":
            start, found = open_.pop() if open_ else (0, False)
            if found:
                return start, m.start()
        elif m[0][0] not in "'\"" and open_:
            open_[-1] = (open_[-1][0], True)
    return None
