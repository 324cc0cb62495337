"""Statements that Spark spells otherwise: COPY, external tables, SHOW, PREPARE, SET, EXPLAIN, catalog views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import dialect
from tessera.sources import files, scratch

_OPT = r"(?:\s+OPTIONS\s*\((?P<options>.*?)\))?"
_COPY = re.compile(rf"COPY\s+(?P<source>\(.*\)|[\w.\"]+)\s+TO\s+'(?P<path>[^']+)'(?:\s+STORED\s+AS\s+(?P<form>\w+))?(?:\s+PARTITIONED\s+BY\s*\((?P<parts>[^)]*)\))?{_OPT}\s*$", re.I | re.S)
_EXTERNAL = re.compile(
    rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?(?P<unbounded>UNBOUNDED\s+)?EXTERNAL\s+TABLE\s+(?P<absent>IF\s+NOT\s+EXISTS\s+)?(?P<name>[\w.]+)\s*(?P<columns>\((?:[^()]|\([^()]*\))*\))?\s*STORED\s+AS\s+(?P<form>\w+)"
    rf"(?:\s+PARTITIONED\s+BY\s*\((?P<parts>[^)]*)\))?(?:\s+WITH\s+ORDER\s*\((?P<order>[^)]*)\))?{_OPT}\s*LOCATION\s+'(?P<path>[^']+)'{_OPT.replace('options', 'more')}\s*$",
    re.I | re.S,
)


def _options(text: str | None) -> dict[str, str]:
    return {k.strip("'\"").removeprefix("format."): v for k, v in re.findall(r"('[^']*'|[\w.]+)\s+'?((?<=')[^']*|[^',\s]+)'?", text or "")}


def _rows(session, rows: list[tuple], schema: str) -> DataFrame:
    return session.spark.createDataFrame(rows, schema)


def run(session, sql: str, params) -> DataFrame:
    first = sql.split(None, 1)[0].upper() if sql else ""
    handler = _HANDLERS.get(first)
    if handler:
        done = handler(session, sql, params)
        if done is not None:
            return done
    if "information_schema." in sql.lower():
        sql = _with_catalog(session, sql)
    if first in ("CREATE", "DROP", "ALTER", "SHOW", "INSERT"):
        return session.spark.sql(session.translated(sql))
    return session.query(sql, params)


def copy(session, sql: str, params) -> DataFrame:
    m = _COPY.match(sql)
    if not m:
        raise ValueError("COPY {table | (query)} TO 'path' [STORED AS format] [PARTITIONED BY (columns)] [OPTIONS (…)]")
    source = m["source"]
    df = session.query(source[1:-1], params) if source.startswith("(") else session.spark.table(source.strip('"'))
    parts = [p.strip() for p in (m["parts"] or "").split(",") if p.strip()]
    n = files.write(df, m["path"], (m["form"] or files.form_of(m["path"])).lower(), partition_by=parts, mode="append", **_options(m["options"]))
    return _rows(session, [(n,)], "count long")


def create(session, sql: str, params) -> DataFrame | None:
    m = _EXTERNAL.match(sql)
    if m:
        if m["absent"] and session.table_exist(m["name"]):
            return _rows(session, [], "ok string")
        options = _options(m["options"]) | _options(m["more"])
        schema = None
        if m["columns"]:
            columns = [c.strip() for c in re.split(r",(?![^()]*\))", m["columns"].strip()[1:-1])]
            schema = ", ".join(f"{c.split(None, 1)[0]} {dialect.Translator()._type(dialect.grouped(dialect.tokens(re.sub('(?i)NOT NULL', '', c.split(None, 1)[1]))))}" for c in columns)
        if m["unbounded"]:
            from tessera.streaming.queries import stream

            df = stream(session.spark, m["path"], m["form"].lower(), schema, **options)
        else:
            df = files.read(session.spark, m["path"], m["form"].lower(), schema=schema, **options)
        if m["order"] and m["unbounded"]:  # an ordered unbounded input bounds the state by its order
            df = df.withWatermark(m["order"].split(",")[0].split()[0], "0 seconds")
        session.register_table(m["name"], df)
        return _rows(session, [], "ok string")
    m = re.match(r"CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s+AS\s+(.*)$", sql, re.I | re.S)
    if m:
        # the rows as they are now: later changes of the sources don't show
        session.register_table(m[3], scratch.stored(session.query(m[4], params), scratch.folder(session.spark, "table")))
        return _rows(session, [], "ok string")
    m = re.match(r"CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+([\w.]+)\s+AS\s+(.*)$", sql, re.I | re.S)
    if m:
        session.register_table(m[2], session.query(m[3], params))
        return _rows(session, [], "ok string")
    m = re.match(r"CREATE\s+(OR\s+REPLACE\s+)?(TEMPORARY\s+)?FUNCTION\s+(\w+)\s*\(([^)]*)\)\s*RETURNS\s+(\w+)\s+RETURN\s+(.*)$", sql, re.I | re.S)
    if m:
        # the parameters as columns of a frame, whose types the divisions follow
        given = [x.split(None, 1) for x in m[4].split(",") if x.strip()]
        frame = session.spark.range(0).select(*(F.expr(f"CAST(NULL AS {kind}) AS {name}") for name, kind in given))
        body = dialect.divided(lambda d: dialect.expression(m[6], d), lambda t: frame.select(F.expr(t))._jdf.queryExecution().analyzed())
        session.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[3]}({m[4]}) RETURNS {m[5]} RETURN {body}")
        return _rows(session, [], "ok string")
    return None


def drop(session, sql: str, params) -> DataFrame | None:
    m = re.match(r"DROP\s+(?:TABLE|VIEW)\s+(IF\s+EXISTS\s+)?([\w.]+)$", sql, re.I)
    if m and session.deregister_table(m[2]):
        return _rows(session, [], "ok string")
    m = re.match(r"DROP\s+FUNCTION\s+(IF\s+EXISTS\s+)?(\w+)$", sql, re.I)
    if m:
        return session.spark.sql(f"DROP TEMPORARY FUNCTION {m[1] or ''}{m[2]}")
    return None


def insert(session, sql: str, params) -> DataFrame | None:
    """INSERT into a registered frame: the rows are appended (or take its place) in a new frame of that name."""
    m = re.match(r"INSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?([\w.]+)\s*(\([^)]*\))?\s+((?:SELECT|VALUES|WITH)\b.*)$", sql, re.I | re.S)
    if not m or m[2].lower() not in session._views:
        return None
    old = session.spark.table(m[2])
    new = session.query(m[4], params)
    names = [c.strip() for c in m[3][1:-1].split(",")] if m[3] else old.columns[: len(new.columns)]
    kinds = dict(old.dtypes)
    new = new.toDF(*names).select(*((F.col(c) if c in names else F.lit(None)).cast(kinds[c]).alias(c) for c in old.columns))
    new = scratch.stored(new, scratch.folder(session.spark, "rows"))  # the query runs once
    count = new.count()
    session.register_table(m[2], new if m[1].upper() == "OVERWRITE" else old.unionAll(new))
    return _rows(session, [(count,)], "count long")


def prepare(session, sql: str, params) -> DataFrame:
    m = re.match(r"PREPARE\s+(\w+)\s*(?:\([^)]*\))?\s+AS\s+(.*)$", sql, re.I | re.S)
    session._prepared[m[1]] = m[2]
    return _rows(session, [], "ok string")


def execute(session, sql: str, params) -> DataFrame:
    m = re.match(r"EXECUTE\s+(\w+)\s*(?:\((.*)\))?$", sql, re.I | re.S)
    given = dialect.split_items(dialect.grouped(dialect.tokens(m[2]))) if m[2] else []
    return session.query(session._prepared[m[1]], values={f"${k}": f"({dialect.Translator().text(x)})" for k, x in enumerate(given, 1)})


def deallocate(session, sql: str, params) -> DataFrame:
    session._prepared.pop(sql.split()[-1], None)
    return _rows(session, [], "ok string")


def set_(session, sql: str, params) -> DataFrame:
    m = re.match(r"SET\s+([\w.]+)\s*(?:=|TO)\s*'?(.*?)'?$", sql, re.I | re.S)
    session.set_option(m[1], m[2])
    return _rows(session, [], "ok string")


def show(session, sql: str, params) -> DataFrame | None:
    words = sql.split()
    what = words[1].upper()
    if what == "TABLES":
        return catalog_view(session, "tables")
    if what == "COLUMNS":
        return catalog_view(session, "columns").where(F.col("table_name") == words[-1].lower())
    if what == "FUNCTIONS":
        return catalog_view(session, "routines")
    if what == "ALL":
        return catalog_view(session, "df_settings")
    if what == "CREATE":
        name = words[-1]
        fields = ", ".join(f"{n} {t}" for n, t in session.spark.table(name).dtypes)
        return _rows(session, [(name, f"CREATE TABLE {name} ({fields})")], "table_name string, definition string")
    value = session.spark.conf.get(_spark_name(words[-1]), None)
    return _rows(session, [(words[-1], value)], "name string, value string")


def _spark_name(key: str) -> str:
    from tessera.session import OPTIONS

    return OPTIONS.get(key if key in OPTIONS else key.split(".", 1)[-1], key)


def describe(session, sql: str, params) -> DataFrame:
    name = sql.split()[-1]
    return _rows(session, [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for f in session.spark.table(name).schema], "column_name string, data_type string, is_nullable string")


def explain(session, sql: str, params) -> DataFrame:
    m = re.match(r"EXPLAIN\s+(?P<analyze>ANALYZE\s+)?(?P<verbose>VERBOSE\s+)?(?:FORMAT\s+(?P<form>\w+)\s+)?(?P<sql>.*)$", sql, re.I | re.S)
    mode = "extended" if m["verbose"] else {"indent": "simple", "tree": "formatted", "pgjson": "json", "graphviz": "dot"}.get((m["form"] or "tree").lower(), "formatted")
    return explained(session.query(m["sql"], params), mode, bool(m["analyze"]))


def explained(df: DataFrame, mode: str = "formatted", analyze: bool = False) -> DataFrame:
    """(plan_type, plan) rows; with ``analyze`` the query runs and the plan carries its row counts and times."""
    import json

    query = df._jdf.queryExecution()
    if analyze:
        rows = df.count()
        lines = [("Plan with Metrics", query.executedPlan().toString()), ("Output Rows", str(rows))]
    elif mode == "json":
        lines = [("physical_plan", json.dumps([{"Plan": _tree(query.executedPlan())}], indent=2))]
    elif mode == "dot":
        lines = [("physical_plan", _graph(_tree(query.executedPlan())))]
    else:
        lines = [("logical_plan", query.optimizedPlan().toString()), ("physical_plan", query.executedPlan().toString())]
        if mode == "extended":
            lines.insert(0, ("initial_logical_plan", query.logical().toString()))
    return df.sparkSession.createDataFrame(lines, "plan_type string, plan string")


def _tree(node) -> dict:
    """The physical plan as nested nodes, each with its operator, its text and its inputs."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _tree(node.inputPlan())
    inputs = node.children().iterator()
    below = []
    while inputs.hasNext():
        below.append(_tree(inputs.next()))
    return {"Node Type": node.nodeName(), "Text": node.simpleString(100)} | ({"Plans": below} if below else {})


def _graph(root: dict) -> str:
    """A graph with an edge from each input to the operator that reads it."""
    lines, count = ["digraph {"], 0

    def draw(node: dict) -> int:
        nonlocal count
        number = count
        count += 1
        label = node["Text"][:120].replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  {number} [label="{label}"];')
        lines.extend(f"  {draw(below)} -> {number};" for below in node.get("Plans", []))
        return number

    draw(root)
    return "\n".join([*lines, "}"])


# -- information_schema -----------------------------------------------------------------------


def catalog_view(session, name: str) -> DataFrame:
    spark = session.spark
    # what the catalog lists: names only, no table is read
    tables = [(t.catalog or "spark_catalog", (t.namespace or ["default"])[0], t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    if name == "tables":
        return _rows(session, tables, "table_catalog string, table_schema string, table_name string, table_type string")
    if name == "views":
        return _rows(session, [(*t[:3], None) for t in tables if t[3] == "VIEW"], "table_catalog string, table_schema string, table_name string, definition string")
    if name == "columns":
        rows = [(*t[:3], f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString()) for t in tables for i, f in enumerate(spark.table(t[2]).schema)]
        return _rows(session, rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
    if name == "schemata":
        return _rows(session, [(d.catalog, d.name) for d in spark.catalog.listDatabases()], "catalog_name string, schema_name string")
    if name == "routines":
        from tessera.functions import AGGREGATES, REWRITES

        own = {(n, "FUNCTION") for n in REWRITES} | {(n, "AGGREGATE") for n in AGGREGATES}
        own |= {(f.name, "FUNCTION") for f in spark.catalog.listFunctions() if f.name not in REWRITES and f.name not in AGGREGATES}
        return _rows(session, sorted(own), "routine_name string, routine_type string")
    if name == "parameters":
        import inspect

        from tessera.functions import REWRITES

        rows = [(n, p.name, i + 1) for n, f in REWRITES.items() for i, p in enumerate(inspect.signature(f).parameters.values())]
        return _rows(session, rows, "specific_name string, parameter_name string, ordinal_position int")
    if name == "df_settings":
        from tessera.session import OPTIONS

        return _rows(session, [(k, spark.conf.get(v, None)) for k, v in OPTIONS.items()], "name string, value string")
    raise ValueError(f"information_schema has no {name}")


def _with_catalog(session, sql: str) -> str:
    for name in set(re.findall(r"information_schema\.(\w+)", sql, re.I)):
        catalog_view(session, name.lower()).createOrReplaceTempView(f"__catalog_{name.lower()}")
    return re.sub(r"information_schema\.(\w+)", lambda m: f"__catalog_{m[1].lower()}", sql, flags=re.I)


_HANDLERS = {"COPY": copy, "CREATE": create, "DROP": drop, "INSERT": insert, "PREPARE": prepare, "EXECUTE": execute, "DEALLOCATE": deallocate, "SET": set_, "SHOW": show, "DESCRIBE": describe, "EXPLAIN": explain}
