"""Sources, sinks, statements, user functions and streams, as queries with an oracle."""

from __future__ import annotations

import numpy as np
import asyncio

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions import udf
from tessera.registry import session
from tessera.sources import scratch
from tessera.sources.parquet_info import parquet_metadata
from tessera.streaming import queries as streaming


def _folder(spark) -> str:
    return scratch.folder(spark, "io")


def _round_trip(form: str, options: str = "", columns: str = "p_partkey, p_name, p_size, p_retailprice"):
    def run(spark, sf_dir):
        s, path = session(spark, sf_dir), f"{_folder(spark)}/t"
        s.sql(f"COPY (SELECT {columns} FROM part) TO '{path}' STORED AS {form}{' OPTIONS (' + options + ')' if options else ''}")
        schema = "p_partkey long, p_name string, p_size int, p_retailprice double"
        return s.read(path, form.lower(), schema=schema, **({"delimiter": ";"} if ";" in options else {})).df

    return run


_PARTS = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"


def partitioned(spark, sf_dir):
    s, path = session(spark, sf_dir), f"{_folder(spark)}/t"
    s.sql(f"COPY orders TO '{path}' STORED AS PARQUET PARTITIONED BY (o_orderstatus)")
    return s.read_parquet(path).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").df


def copy_count(spark, sf_dir):
    s = session(spark, sf_dir)
    return s.sql(f"COPY (SELECT * FROM lineitem WHERE l_quantity > 25) TO '{_folder(spark)}/t' STORED AS PARQUET OPTIONS ('format.compression' 'zstd(3)')").df


def external_table(spark, sf_dir):
    s, path = session(spark, sf_dir), f"{_folder(spark)}/t"
    s.table("nation").write_csv(path)
    s.sql(f"CREATE EXTERNAL TABLE nations (n_nationkey INT, n_name VARCHAR, n_regionkey INT) STORED AS CSV OPTIONS ('format.has_header' 'true') LOCATION '{path}'")
    return s.sql("SELECT n_regionkey, count(*) AS n FROM nations GROUP BY n_regionkey").df


def file_as_table(spark, sf_dir):
    return session(spark, sf_dir).sql(f"SELECT r_name FROM '{sf_dir}/region.parquet'").df


def create_insert(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE kept AS SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
    s.sql("INSERT INTO kept VALUES (100, 'new'), (101, NULL)")
    return s.sql("SELECT * FROM kept").df


def insert_overwrite(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE kept AS SELECT n_nationkey AS k, n_name AS name FROM nation")
    s.sql("INSERT OVERWRITE kept SELECT r_regionkey, r_name FROM region")
    return s.sql("SELECT * FROM kept").df


def view(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("CREATE OR REPLACE VIEW big AS SELECT * FROM part WHERE p_size > 40")
    return s.sql("SELECT count(*) AS n FROM big").df


def prepared(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("PREPARE q(INT, VARCHAR) AS SELECT p_partkey FROM part WHERE p_size > $1 AND p_brand <> $2")
    out = s.sql("EXECUTE q(30, 'Brand#11')").df
    s.sql("DEALLOCATE q")
    return out


def parameters(spark, sf_dir):
    return session(spark, sf_dir).sql("SELECT p_partkey FROM part WHERE p_size > $1 AND p_name LIKE $2", [30, "a%"]).df


def variables(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register_variable("@limit", 30)
    return s.sql("SELECT p_partkey FROM part WHERE p_size > @limit").df


def placeholders_in_texts(spark, sf_dir):
    """Variables and placeholders are tokens: what looks like one inside a text stays."""
    s = session(spark, sf_dir)
    s.register_variable("@limit", 30)
    s.sql("PREPARE q(INT) AS SELECT p_partkey, 'cost $1, mail@limit.org' AS t FROM part WHERE p_size > $1 AND p_size > @limit")
    return s.sql("EXECUTE q(20)").df


def stored_rows(spark, sf_dir):
    """CREATE TABLE AS keeps the rows of its time."""
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE source AS SELECT r_regionkey AS k FROM region")
    s.sql("CREATE TABLE copied AS SELECT * FROM source")
    s.sql("INSERT INTO source VALUES (77)")
    return s.sql("SELECT k, 'copied' AS t FROM copied UNION ALL SELECT k, 'source' FROM source").df


def copy_appends(spark, sf_dir):
    """COPY adds files; what the folder holds stays."""
    s, path = session(spark, sf_dir), f"{_folder(spark)}/t"
    for part in ("r_regionkey < 2", "r_regionkey >= 2"):
        s.sql(f"COPY (SELECT r_regionkey FROM region WHERE {part}) TO '{path}' STORED AS PARQUET")
    return s.read_parquet(path).df


def unbounded_table(spark, sf_dir):
    """CREATE UNBOUNDED EXTERNAL TABLE over CSV with a declared order, aggregated as a stream."""
    s, path = session(spark, sf_dir), f"{_folder(spark)}/t"
    s.table("nation").write_csv(path)
    s.sql(f"CREATE UNBOUNDED EXTERNAL TABLE coming (n_nationkey INT, n_name VARCHAR, n_regionkey INT) STORED AS CSV OPTIONS ('format.has_header' 'true') LOCATION '{path}'")
    return streaming.run_available(s.sql("SELECT n_regionkey, count(*) AS n FROM coming GROUP BY n_regionkey").df)


def show_tables(spark, sf_dir):
    s = session(spark, sf_dir)
    s.table("nation"), s.table("region")
    return s.sql("SHOW TABLES").filter("table_name IN ('nation', 'region')").select("table_name").df


def show_columns(spark, sf_dir):
    s = session(spark, sf_dir)
    s.table("nation")
    return s.sql("SHOW COLUMNS FROM nation").select("column_name").df


def show_settings(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("SET tessera.execution.time_zone = 'UTC'")
    return s.sql("SHOW tessera.execution.time_zone").select("value").df


def information_schema(spark, sf_dir):
    return session(spark, sf_dir).sql("SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'part'").df


def describe_table(spark, sf_dir):
    return session(spark, sf_dir).sql("DESCRIBE nation").select("column_name").df


def explain_rows(spark, sf_dir):
    return session(spark, sf_dir).sql("EXPLAIN SELECT count(*) FROM part").select("plan_type").df


def create_function(spark, sf_dir):
    s = session(spark, sf_dir)
    s.sql("CREATE FUNCTION twice_plus(x INT, y INT) RETURNS INT RETURN x * 2 + y")
    return s.sql("SELECT p_partkey, twice_plus(p_size, 1) AS v FROM part").df


def memory_table(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register_table("held", s.from_columns({"a": [1, 2, 3], "b": ["x", None, "z"]}))
    return s.sql("SELECT a, b FROM held WHERE a > 1").df


def footers(spark, sf_dir):
    # the reader of this table is pyarrow's footer parser; its rows are checked against the data itself
    found = parquet_metadata(spark, f"{sf_dir}/nation.parquet")
    return found.groupBy("path_in_schema").agg(F.sum("num_values").cast("long").alias("n"))


# -- user functions ---------------------------------------------------------------------------


def scalar_function(spark, sf_dir):
    s = session(spark, sf_dir)

    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    s.register_udf("py_double", udf.scalar("long", doubled))
    return s.sql("SELECT p_partkey, py_double(p_partkey) AS v FROM part").df


def async_function(spark, sf_dir):
    s = session(spark, sf_dir)

    async def later(x):
        await asyncio.sleep(0)
        return x + 1

    return s.table("part").df.select("p_partkey", udf.asynchronous("long", later)("p_partkey").alias("v"))


def aggregate_function(spark, sf_dir):
    s = session(spark, sf_dir)
    span = udf.aggregate("double", lambda v: float(v.max() - v.min()))
    return s.table("part").df.groupBy("p_brand").agg(F.round(span("p_retailprice"), 4).alias("v"))


class GeometricMean(udf.Merging):
    """A user aggregate with a state of its own: count and sum of logarithms."""

    def zero(self):
        return 0, 0.0

    def update(self, state, values):
        v = values.iloc[:, 0].dropna()
        return state[0] + len(v), state[1] + float(np.log(v).sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def evaluate(self, state):
        return float(np.exp(state[1] / state[0])) if state[0] else None


def mergeable_aggregate(spark, sf_dir):
    s = session(spark, sf_dir)
    return s.table("part").aggregate_merging(["p_brand"], ["p_retailprice"], GeometricMean(), "v", "double").select("p_brand", "round(v, 4) AS v").df


def mergeable_global(spark, sf_dir):
    s = session(spark, sf_dir)
    return s.table("lineitem").aggregate_merging([], ["l_extendedprice"], GeometricMean(), "v", "double").select("round(v, 4) AS v").df


def window_function(spark, sf_dir):
    from pyspark.sql import Window

    s = session(spark, sf_dir)
    largest = udf.aggregate("double", lambda v: float(v.max()))
    return s.table("part").df.select("p_partkey", largest(F.col("p_retailprice")).over(Window.partitionBy("p_brand")).alias("v"))


def table_function(spark, sf_dir):
    s = session(spark, sf_dir)

    @udtf(returnType="n: int, square: int")
    class Squares:
        def eval(self, lo: int, hi: int):
            for n in range(lo, hi):
                yield n, n * n

    s.register_udtf("squares", Squares)
    return s.sql("SELECT n, square FROM squares(1, 12)").df


# -- streams ----------------------------------------------------------------------------------


def _events(spark, sf_dir):
    import os.path

    folder, name = os.path.split(f"{sf_dir}/events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # times of a stream's watermark are instants
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp_ltz"))


def stream_tumbling(spark, sf_dir):
    agg = streaming.tumbling(_events(spark, sf_dir), "ts", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n"))
    return streaming.run_available(agg.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "append")


def stream_sliding(spark, sf_dir):
    agg = streaming.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "10 minutes", [], F.count("*").alias("n"))
    return streaming.run_available(agg.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


def stream_sessions(spark, sf_dir):
    agg = streaming.sessions(_events(spark, sf_dir), "ts", "30 minutes", "10 minutes", ["user_id"], F.count("*").alias("n"))
    return streaming.run_available(agg.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


def stream_dedup(spark, sf_dir):
    seen = streaming.deduplicated(_events(spark, sf_dir), ["event_id"], "ts", "10 minutes")
    return streaming.run_available(seen.select("event_id"), "append")


def stream_join(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    both = streaming.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "1 hour", "0 seconds", "6 hours")
    return streaming.run_available(both.select("l_event_id", "r_event_id"), "append")


def stream_running(spark, sf_dir):
    return streaming.run_available(streaming.running_count(_events(spark, sf_dir), "event_type"), "append")


def stream_sink(spark, sf_dir):
    path = f"{_folder(spark)}/t"
    streaming.to_files(_events(spark, sf_dir).select("event_id", "value"), path)
    return spark.read.schema("event_id long, value double").parquet(path)


ALL = {
    "io_parquet": (_round_trip("PARQUET"), _PARTS),
    "io_csv": (_round_trip("CSV"), _PARTS),
    "io_csv_options": (_round_trip("CSV", "'format.delimiter' ';', 'format.compression' 'gzip'"), _PARTS),
    "io_json": (_round_trip("JSON"), _PARTS),
    "io_arrow": (_round_trip("ARROW"), _PARTS),
    "io_partitioned": (partitioned, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "io_copy_count": (copy_count, "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25"),
    "io_external_table": (external_table, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "io_file_as_table": (file_as_table, "SELECT r_name FROM region"),
    "io_parquet_metadata": (footers, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS path_in_schema, count(*) AS n FROM nation"),
    "stmt_create_insert": (create_insert, "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 100, 'new' UNION ALL SELECT 101, NULL"),
    "stmt_insert_overwrite": (insert_overwrite, "SELECT r_regionkey AS k, r_name AS name FROM region"),
    "stmt_view": (view, "SELECT count(*) AS n FROM part WHERE p_size > 40"),
    "stmt_prepare": (prepared, "SELECT p_partkey FROM part WHERE p_size > 30 AND p_brand <> 'Brand#11'"),
    "stmt_parameters": (parameters, "SELECT p_partkey FROM part WHERE p_size > 30 AND p_name LIKE 'a%'"),
    "stmt_variables": (variables, "SELECT p_partkey FROM part WHERE p_size > 30"),
    "stmt_placeholders_in_texts": (placeholders_in_texts, "SELECT p_partkey, 'cost $1, mail@limit.org' AS t FROM part WHERE p_size > 30"),
    "stmt_stored_rows": (stored_rows, "SELECT r_regionkey AS k, 'copied' AS t FROM region UNION ALL SELECT r_regionkey, 'source' FROM region UNION ALL SELECT 77, 'source'"),
    "io_copy_appends": (copy_appends, "SELECT r_regionkey FROM region"),
    "stream_unbounded_table": (unbounded_table, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "stmt_show_tables": (show_tables, "SELECT unnest(['nation', 'region']) AS table_name"),
    "stmt_show_columns": (show_columns, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name"),
    "stmt_show": (show_settings, "SELECT 'UTC' AS value"),
    "stmt_information_schema": (information_schema, "SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name, CAST(unnest([0, 1, 2, 3, 4, 5]) AS INT) AS ordinal_position"),
    "stmt_describe": (describe_table, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name"),
    "stmt_explain": (explain_rows, "SELECT unnest(['logical_plan', 'physical_plan']) AS plan_type"),
    "stmt_create_function": (create_function, "SELECT p_partkey, p_size * 2 + 1 AS v FROM part"),
    "io_memory": (memory_table, "SELECT * FROM (VALUES (CAST(2 AS BIGINT), NULL), (3, 'z')) v(a, b)"),
    "udf_scalar": (scalar_function, "SELECT p_partkey, p_partkey * 2 AS v FROM part"),
    "udf_async": (async_function, "SELECT p_partkey, p_partkey + 1 AS v FROM part"),
    "udf_aggregate": (aggregate_function, "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 4) AS v FROM part GROUP BY p_brand"),
    "udf_aggregate_mergeable": (mergeable_aggregate, "SELECT p_brand, round(exp(sum(ln(p_retailprice)) / count(*)), 4) AS v FROM part GROUP BY p_brand"),
    "udf_aggregate_mergeable_global": (mergeable_global, "SELECT round(exp(sum(ln(l_extendedprice)) / count(*)), 4) AS v FROM lineitem"),
    "udf_window": (window_function, "SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand) AS v FROM part"),
    "udf_table": (table_function, "SELECT CAST(range AS INT) AS n, CAST(range * range AS INT) AS square FROM range(1, 12)"),
    "stream_tumbling": (stream_tumbling, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"),
    "stream_sliding": (stream_sliding, "SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS start FROM events, range(0, 2) r(h)) GROUP BY start HAVING start + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT event_id FROM events"),
    "stream_interval_join": (stream_join, "SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '6 hours'"),
    "stream_running_count": (stream_running, "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events"),
    "stream_sink": (stream_sink, "SELECT event_id, value FROM events"),
}

QUERIES = {name: f for name, (f, _) in ALL.items()}
ORACLE = {name: sql for name, (_, sql) in ALL.items()}
