"""The dialect, statements, plans and edges of functions that the registered queries don't reach."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.plans.dialect import translate
from tessera.session import Session


@pytest.fixture(scope="module")
def s(spark, sf):
    out = Session(spark)
    out.register_folder(sf, ["part", "orders", "customer", "lineitem", "nation"])
    return out


def one(s, expr):
    return s.sql(f"SELECT {expr} AS v").df.head()["v"]


@pytest.mark.parametrize(
    "expr, want",
    [
        ("concat('a', NULL, 'b')", "ab"),
        ("initcap('hello-world foo')", "Hello-World Foo"),
        ("left('abcdef', -2)", "abcd"),
        ("right('abcdef', -2)", "cdef"),
        ("substr('abcdef', -1, 4)", "ab"),
        ("chr(128640)", "\U0001f680"),
        ("to_hex(255)", "ff"),
        ("regexp_replace('aaa', 'a', 'b')", "baa"),
        ("regexp_replace('aAa', 'a', 'b', 'gi')", "bbb"),
        (r"regexp_replace('foobar', '(o+)', '<\1>')", "f<oo>bar"),
        ("regexp_match('foobar', '(o)(b)')", ["o", "b"]),
        ("regexp_match('foobar', 'x')", None),
        ("regexp_instr('abcabc', 'b', 3)", 5),
        ("regexp_instr('abcabc', 'b', 1, 2)", 5),
        ("split_part('a.b.c', '.', -1)", "c"),
        ("log(100)", 2.0),
        ("ln(0)", float("-inf")),
        ("trunc(-2.7)", -2.0),
        ("gcd(12, 18)", 6),
        ("lcm(4, 6)", 12),
        ("7 / 2", 3),
        ("7 / 2.0", 3.5),
        ("[1, 2, 3][2]", 2),
        ("[1, 2, 3][-1]", 3),
        ("[1, 2, 3][9]", None),
        ("[1, 2, 3, 4][2:3]", [2, 3]),
        ("array_slice([1, 2, 3, 4], -3, -2)", [2, 3]),
        ("array_position([1, 2, 3], 9)", None),
        ("array_remove([1, 2, 1], 1)", [2, 1]),
        ("array_has([1, NULL], 2)", False),
        ("array_has_any([1, NULL], [NULL])", True),
        ("array_sort([2, NULL, 1])", [None, 1, 2]),
        ("array_sort([2, NULL, 1], 'DESC', 'NULLS LAST')", [2, 1, None]),
        ("array_append(NULL::int[], 1)", [1]),
        ("flatten([[1], NULL, [2]])", [1, 2]),
        ("range(0)", []),
        ("generate_series(5, 1)", []),
        ("generate_series(5, 1, -2)", [5, 3, 1]),
        ("map_extract(MAP {'a': 1}, 'b')", [None]),
        ("encode('hi', 'base64')", "aGk"),
        ("{a: 1, b: 'x'}['b']", "x"),
        ("3 = ANY([1, 3])", True),
        ("5 # 1", 4),
        ("arrow_typeof(1::bigint)", "Int64"),
        ("'2024-02-03'::date::varchar", "2024-02-03"),
        ("date_part('dow', '2024-02-04'::date)", 0),
        ("to_char('2024-02-03 04:05:06'::timestamp, '%d.%m.%Y at %H')", "03.02.2024 at 04"),
        ("to_date('03/02/2024', '%Y-%m-%d', '%d/%m/%Y')::varchar", "2024-02-03"),
        ("date_bin(INTERVAL '15 minutes', '1969-12-31 23:59:00'::timestamp)::varchar", "1969-12-31 23:45:00"),
        ("strpos('a''b', '''')", 2),
        (r"length('a\b')", 3),
    ],
)
def test_edges(s, expr, want):
    assert one(s, expr) == want


def test_corr_of_constants(s):
    assert s.sql("SELECT corr(p_size * 0, p_size) AS v FROM part").df.head().v == 0.0


def test_no_python_in_rewrites(s):
    plan = s.sql("SELECT initcap(p_name) AS a, array_sort(string_to_array(p_name, ' ')) AS b, date_bin(INTERVAL '1 hour', now()) AS c FROM part").df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_pushdown_and_pruning(s):
    plan = s.sql("SELECT p_partkey FROM part WHERE p_size > 40").df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan and "p_name" not in plan


def test_top_k_plan(s):
    assert "TakeOrderedAndProject" in s.sql("SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 3").df._jdf.queryExecution().executedPlan().toString()


def test_translation_leaves_texts_alone():
    assert translate("SELECT 'concat(a, b) :: x' AS t") == "SELECT 'concat(a, b) :: x' AS t"
    assert translate("SELECT a FROM t ORDER BY a DESC") == "SELECT a FROM t ORDER BY a DESC NULLS FIRST"
    with pytest.raises(ValueError):
        translate("SELECT (a FROM t")


def test_statements(s, tmp_path):
    path = f"file://{tmp_path}/x"
    assert s.sql(f"COPY part TO '{path}' STORED AS PARQUET").df.head()["count"] == s.table("part").count()
    assert s.read_parquet(path).count() == s.table("part").count()
    s.sql("CREATE TABLE t1 AS SELECT 1 AS a")
    assert s.table_exist("t1") and s.sql("SHOW COLUMNS FROM t1").count() == 1
    s.sql("DROP TABLE t1")
    assert not s.table_exist("t1")
    with pytest.raises(PermissionError):
        s.sql_with_options("DROP TABLE t1", allow_ddl=False)
    assert s.sql("EXPLAIN ANALYZE SELECT count(*) FROM part").count() == 2
    assert {r.routine_name for r in s.sql("SELECT routine_name FROM information_schema.routines").df.collect()} >= {"initcap", "array_agg"}
    s.set_option("execution.target_partitions", "8")


def test_arrow_files(s, tmp_path):
    path = f"file://{tmp_path}/a"
    assert s.table("nation").write_arrow(path) == 25
    assert s.read_arrow(path).count() == 25
    assert pa.table({"a": [1]}).equals(s.read_batch(pa.table({"a": [1]})).collect())


def test_frame_methods(s):
    p = s.table("part")
    n = p.count()
    assert sum(map(len, p.df.repartition(3).rdd.glom().map(lambda x: [len(x)]).collect())) == 3
    assert sum(map(len, p.repartition(3).collect_partitioned())) == n
    assert len(list(p.limit(5, 7).execute_stream())) == 7
    assert "p_size" in p.to_string(2) and "Relation" in p.logical_plan() and p.create_physical_plan()
    assert p.join_on(s.table("nation"), "inner", ["p_size = n_nationkey"]).count() == p.join(s.table("nation"), "inner", ["p_size"], ["n_nationkey"]).count()
    assert p.union_by_name(s.table("nation")).count() == n + 25
    p.into_view("again")
    assert s.sql("SELECT count(*) AS n FROM again").df.head().n == n


def test_command_line(s):
    import io

    from tessera.__main__ import Shell, statements

    assert statements("SELECT ';' -- a; b\n; SELECT 2;") == ["SELECT ';' -- a; b", "SELECT 2"]
    out = io.StringIO()
    shell = Shell(s, "csv", quiet=True, out=out)
    shell.run("SELECT 1 AS a, 'x' AS b; SELECT 2 AS c")
    assert out.getvalue() == "a,b\n1,x\nc\n2\n"
    assert shell.command("\\pset format nd-json") and shell.form == "nd-json"
    shell.run("SELECT 3 AS d")
    assert out.getvalue().endswith('{"d":3}\n') and not shell.command("\\q")


def test_parameters(s):
    assert s.sql("SELECT $1 + 1 AS v").with_param_values([4]).df.head().v == 5
    assert s.sql("SELECT $a AS v", {"a": "x"}).df.head().v == "x"


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1,), (None,)], "x int")
    b = spark.createDataFrame([(None,), (1,), (2,)], "y int")
    assert relational.null_safe_join(a, b, "inner", ["x"], ["y"]).count() == 2
    marked = relational.mark_join(a, b, F.col("x") == F.col("y"))
    assert sorted((r.x or 0, r.mark) for r in marked.collect()) == [(0, False), (1, True)]


def test_missing_subpackage():
    """The rest of the library doesn't import the training-data operators."""
    import pathlib

    import tessera

    top = pathlib.Path(tessera.__file__).parent
    assert not [f for f in top.rglob("*.py") if "llm" not in f.parts and "tessera.llm" in f.read_text()]


def test_stands_alone(tmp_path):
    """A copy without the subpackage imports, lists the other queries and runs one, with or without the pipeline's file."""
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(top, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = (
        "import __spark_entry__ as e\n"
        "from tessera import registry\n"
        "assert set(e.queries()) == set(registry.collect()[0]) and set(e.oracle_sql()) == set(registry.collect()[1]) and len(e.queries()) > 400\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert e.entry(spark).count() > 0\n"
    )
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (tmp_path / "copy" / gone).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]


def test_digests(s):
    import hashlib

    for name in ("sha224", "sha384", "sha512", "blake2b", "blake2s", "md5", "sha256"):
        for text in ("", "abc", "é" * 300):
            got = s.sql(f"SELECT encode(digest('{text}', '{name}'), 'hex') AS v").df.head().v
            assert got == hashlib.new(name, text.encode()).hexdigest(), name
    for name in ("sha224", "sha384", "sha512"):
        assert s.sql(f"SELECT encode({name}('abc'), 'hex') AS v").df.head().v == hashlib.new(name, b"abc").hexdigest()


def test_division_follows_types(s, spark):
    """The type decides, whatever other tables hold under the same name."""
    s.register_table("whole", spark.createDataFrame([(7,)], "k int"))
    assert s.sql("SELECT k / 2 AS v FROM whole").df.head().v == 3
    s.register_table("parts", spark.createDataFrame([(7.0,)], "k double"))
    assert s.sql("SELECT k / 2 AS v FROM whole").df.head().v == 3
    assert tuple(s.sql("SELECT a.k / 2 AS v, b.k / 2 AS w FROM whole a, parts b").df.head()) == (3, 3.5)
    assert sorted(r.v for r in s.sql("SELECT k / 2 AS v FROM whole UNION ALL SELECT k / 2 FROM parts").df.collect()) == [3.0, 3.5]
    assert s.table("whole").select("k / 2 AS v").df.head().v == 3


def test_wildcards_in_place(s):
    assert s.sql("SELECT * REPLACE (upper(n_name) AS n_name) FROM nation").df.columns == ["n_nationkey", "n_name", "n_regionkey"]
    assert s.sql("SELECT * ILIKE '%KEY' FROM nation").df.columns == ["n_nationkey", "n_regionkey"]


def test_parts_and_streams(s):
    f = s.table("nation").repartition(3)
    streamed = [sum(1 for _ in rows) for rows in f.execute_stream_partitioned()]
    assert sum(streamed) == f.count() and len(streamed) <= 3
    assert f.coalesce(1).df.rdd.getNumPartitions() == 1 and f.into_parts()[0] is s
    with pytest.raises(TypeError):
        s.register_udf("x", type("T", (), {"eval": lambda self: None})())


def test_merging_aggregate_with_null_keys(spark):
    from tessera.frame import Frame
    from tessera.registry.statements import GeometricMean

    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 9.0), (None, None), ("b", None)], "k string, v double").repartition(3)
    got = {r.k: r.g for r in Frame(df).aggregate_merging(["k"], ["v"], GeometricMean(), "g", "double").df.collect()}
    assert got == {"a": pytest.approx(2.0), None: pytest.approx(9.0), "b": None}


def test_explain_forms(s):
    import json

    sql = "SELECT a.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey"
    plan = json.loads(s.sql(f"EXPLAIN FORMAT pgjson {sql}").df.head().plan)[0]["Plan"]

    def nodes(n):
        return [n, *(x for c in n.get("Plans", []) for x in nodes(c))]

    joins = [n for n in nodes(plan) if "Join" in n["Node Type"]]
    assert len(joins) == 1 and len(joins[0]["Plans"]) == 2
    graph = s.sql(f"EXPLAIN FORMAT graphviz {sql}").df.head().plan
    edges = [line for line in graph.splitlines() if "->" in line]
    assert len(edges) == len(nodes(plan)) - 1
    number = next(line.split()[0] for line in graph.splitlines() if "label" in line and "Join" in line.split('"')[1].split()[0])
    assert sum(line.endswith(f"-> {number};") for line in edges) == 2


def test_plans_expressions_and_functions(s, spark):
    f = s.table("nation").filter("n_nationkey < 3")
    assert s.execute_logical_plan(f.df._jdf.queryExecution().logical()).count() == 3
    assert f.df.select(s.create_physical_expr("n_nationkey / 2 AS v", f)).agg({"v": "sum"}).head()[0] == 1
    assert s.table_function("range", 2, 5).count() == 3
    assert s.enable_url_table() is s
    s.register_catalog("own", "org.apache.spark.sql.connector.catalog.InMemoryTableCatalog", kind="x")
    assert spark.conf.get("spark.sql.catalog.own.kind") == "x"
