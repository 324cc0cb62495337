"""Projection, filters, joins, sorting, set operations and subqueries; SQL and the frame methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregation
from tessera.registry import in_sql, session

SQL: dict[str, tuple[str, str | None]] = {
    # projection and filter
    "select_project": ("SELECT p_partkey, p_retailprice * 2 AS twice FROM part", None),
    "select_filter": ("SELECT * FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '1996-06-01 00:00:00'", None),
    "select_null_tests": ("SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NULL OR NOT (nullif(p_size, 9) IS NOT NULL)", None),
    "select_exclude": ("SELECT * EXCLUDE (p_name, p_type) FROM part", None),
    "select_except": ("SELECT * EXCEPT (p_name, p_type) FROM part", "SELECT * EXCLUDE (p_name, p_type) FROM part"),
    "select_replace": ("SELECT * REPLACE (p_size * 10 AS p_size) FROM part", None),
    "select_qualified_star": ("SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "select_quoted_names": ('SELECT "p_partkey" AS "Part Key", p."p_size" FROM part AS p', None),
    "select_values": ("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(n, s)", None),
    "select_no_table": ("SELECT 1 AS one, 'x' AS x, 2.5 AS y", "SELECT 1 AS one, 'x' AS x, CAST(2.5 AS DOUBLE) AS y"),
    "select_no_rows": ("SELECT p_partkey FROM part WHERE false", None),
    # joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey", None),
    "join_full": ("SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0", None),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_using": ("SELECT n_name, x FROM nation JOIN (SELECT n_nationkey, n_nationkey * 2 AS x FROM nation) t USING (n_nationkey)", None),
    "join_natural": ("SELECT n_name, x FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS x FROM nation) t", None),
    "join_residual": ("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice * 3 > o_totalprice", None),
    "join_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey", None),
    "join_left_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000"),
    "join_left_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_right_semi": ("SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_right_anti": ("SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_null_safe": ("SELECT a.p_partkey, b.n_nationkey FROM part a JOIN nation b ON nullif(a.p_size, 7) <=> nullif(b.n_nationkey, 7)", "SELECT a.p_partkey, b.n_nationkey FROM part a JOIN nation b ON nullif(a.p_size, 7) IS NOT DISTINCT FROM nullif(b.n_nationkey, 7)"),
    "join_lateral": ("SELECT n_name, m FROM nation, LATERAL (SELECT max(s_acctbal) AS m FROM supplier WHERE s_nationkey = n_nationkey) t", None),
    "join_broadcast": ("SELECT /*+ BROADCAST(nation) */ s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", None),
    # sort and limits
    "sort_nulls": ("SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s DESC, p_partkey LIMIT 60", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 60"),
    "sort_nulls_last": ("SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s, p_partkey LIMIT 60", "SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s NULLS LAST, p_partkey LIMIT 60"),
    "sort_top_k": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", None),
    "sort_offset": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 37", None),
    # sets, subqueries, recursion
    "set_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "set_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "set_union_by_name": ("SELECT n_name AS a, n_nationkey AS b FROM nation UNION ALL BY NAME SELECT r_regionkey AS b, r_name AS c FROM region", None),
    "set_union_by_name_distinct": ("SELECT n_regionkey AS b FROM nation UNION BY NAME SELECT r_regionkey AS b, r_name AS c FROM region", None),
    "set_intersect": ("SELECT p_size FROM part INTERSECT SELECT n_nationkey FROM nation", None),
    "set_intersect_all": ("SELECT p_size FROM part INTERSECT ALL SELECT n_nationkey FROM nation", None),
    "set_except": ("SELECT p_size FROM part EXCEPT SELECT n_nationkey FROM nation", None),
    "set_except_all": ("SELECT p_size FROM part EXCEPT ALL SELECT n_nationkey FROM nation", None),
    "cte": ("WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT k, n * 2 AS m FROM a) SELECT r_name, m FROM b JOIN region ON k = r_regionkey", None),
    "cte_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t", None),
    "subquery_scalar": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)", None),
    "subquery_correlated": ("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", None),
    "subquery_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "subquery_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "subquery_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "subquery_exists_or": ("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", None),
    "unnest_select": ("SELECT p_partkey, unnest(string_to_array(p_name, ' ')) AS w FROM part", None),
    "unnest_zip": ("SELECT p_partkey, unnest(string_to_array(p_name, ' ')) AS a, unnest([p_size, 2, 3]) AS b FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, unnest([p_size, 2, 3]) AS b FROM part"),
    "unnest_zip_apart": ("SELECT unnest([p_size, 1]) AS a, p_partkey, unnest(string_to_array(p_name, ' ')) AS b FROM part", "SELECT unnest([p_size, 1]) AS a, p_partkey, unnest(string_split(p_name, ' ')) AS b FROM part"),
    "win_groups_frame": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM orders", None),
    "win_groups_frame_sum": ("SELECT o.o_orderkey, CAST(sum(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderpriority GROUPS 1 PRECEDING) AS BIGINT) AS v FROM orders o WHERE o.o_orderkey > 10", None),
    "win_nth_from_end": ("SELECT o_orderkey, nth_value(o_orderkey, -2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders", "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders"),
    "win_nth_from_end_default_frame": ("SELECT o_orderkey, nth_value(o_orderkey, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders", "SELECT o_orderkey, o_orderkey AS v FROM orders"),
    "win_array_agg_ordered": ("SELECT n_nationkey, array_to_string(array_agg(n_name ORDER BY n_name DESC) OVER (PARTITION BY n_regionkey), ',') AS v FROM nation", "SELECT n_nationkey, (SELECT string_agg(m.n_name, ',' ORDER BY m.n_name DESC) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS v FROM nation n"),
    "select_star_ilike": ("SELECT * ILIKE 'p_%PRICE' FROM part", "SELECT p_retailprice FROM part"),
    "set_union_by_name_nested": ("SELECT b, count(*) AS n FROM (SELECT n_name AS a, n_nationkey AS b FROM nation UNION ALL BY NAME SELECT r_regionkey AS b, r_name AS c FROM region) u GROUP BY b", None),
    "set_union_by_name_cte": ("WITH x AS (SELECT n_nationkey AS b FROM nation), y AS (SELECT b FROM x UNION BY NAME SELECT r_regionkey AS b, r_name AS c FROM region) SELECT b, c FROM y", None),
    "cte_recursive_distinct": ("WITH RECURSIVE t(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation WHERE n_nationkey < 5 UNION SELECT t.a, (t.b * 7 + 3) % 25 FROM t) SELECT a, b FROM t", None),
    "agg_first_value_two_keys": ("SELECT o_custkey, first_value(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey DESC) AS a, last_value(o_orderkey ORDER BY nullif(o_orderpriority, '1-URGENT'), o_orderkey) AS b FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderpriority DESC, o_orderkey DESC) AS a, last(o_orderkey ORDER BY nullif(o_orderpriority, '1-URGENT') NULLS LAST, o_orderkey) AS b FROM orders GROUP BY o_custkey"),
    # rank errors: at most two of a hundred rows and one row
    "agg_approx_percentile_rank": ("WITH q AS (SELECT p_brand AS brand, approx_percentile_cont(0.9) WITHIN GROUP (ORDER BY p_retailprice) AS at FROM part GROUP BY p_brand) SELECT brand, count(*) FILTER (WHERE p_retailprice <= at) >= 0.88 * count(*) - 1 AND count(*) FILTER (WHERE p_retailprice < at) <= 0.92 * count(*) + 1 AS fits FROM q JOIN part ON p_brand = brand GROUP BY brand", "SELECT DISTINCT p_brand AS brand, true AS fits FROM part"),
    "agg_approx_percentile_weighted_rank": ("WITH q AS (SELECT p_brand AS brand, approx_percentile_cont_with_weight(p_size, 0.5) WITHIN GROUP (ORDER BY p_retailprice) AS at FROM part GROUP BY p_brand) SELECT brand, sum(p_size) FILTER (WHERE p_retailprice <= at) >= 0.48 * sum(p_size) - 50 AND coalesce(sum(p_size) FILTER (WHERE p_retailprice < at), 0) <= 0.52 * sum(p_size) + 50 AS fits FROM q JOIN part ON p_brand = brand GROUP BY brand", "SELECT DISTINCT p_brand AS brand, true AS fits FROM part"),
    # integer division by type
    "fn_integer_division_aggregate": ("SELECT p_brand, count(*) / 3 AS a, CAST(sum(p_size) / count(*) AS BIGINT) AS b FROM part GROUP BY p_brand", "SELECT p_brand, count(*) // 3 AS a, CAST(sum(p_size) // count(*) AS BIGINT) AS b FROM part GROUP BY p_brand"),
    "fn_integer_division_cte": ("WITH t AS (SELECT p_partkey, p_partkey * 3 / 2 AS k, p_retailprice AS d FROM part) SELECT p_partkey, k / 2 / 2 AS a, d / 2 AS b FROM t", "WITH t AS (SELECT p_partkey, p_partkey * 3 // 2 AS k, p_retailprice AS d FROM part) SELECT p_partkey, k // 2 // 2 AS a, d / 2 AS b FROM t"),
    "fn_integer_division_call": ("SELECT p_partkey, length(p_name) / 2 AS a, CASE WHEN p_size > 9 THEN p_size ELSE 1 END / 4 AS b, sum(p_size) OVER (PARTITION BY p_brand) / 7 AS c FROM part", "SELECT p_partkey, length(p_name) // 2 AS a, CASE WHEN p_size > 9 THEN p_size ELSE 1 END // 4 AS b, CAST(sum(p_size) OVER (PARTITION BY p_brand) // 7 AS BIGINT) AS c FROM part"),
    "fn_integer_division_cast": ("SELECT p_partkey, CAST(p_size AS BIGINT) / 2 AS a, p_size::DOUBLE / 2 AS b, -p_size / 2 AS c FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) // 2 AS a, p_size::DOUBLE / 2 AS b, -(p_size // 2) AS c FROM part"),
    "generate_series_table": ("SELECT value FROM generate_series(1, 20, 3)", "SELECT CAST(generate_series AS INT) AS value FROM generate_series(1, 20, 3)"),
    "range_table": ("SELECT value * 2 AS v FROM range(0, 10)", "SELECT CAST(range * 2 AS INT) AS v FROM range(0, 10)"),
    "generate_series_dates": ("SELECT value FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-03 00:00:00', INTERVAL '6 hours')", "SELECT generate_series AS value FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-03 00:00:00', INTERVAL '6 hours')"),
}


def _frames(spark, sf_dir):
    s = session(spark, sf_dir)
    return s, s.table


def mark_join(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("customer").join(t("orders"), "left_mark", ["c_custkey"], ["o_custkey"]).select_columns("c_custkey", "mark").df


def join_hints(spark, sf_dir):
    """The three algorithms give one result."""
    _, t = _frames(spark, sf_dir)
    o, c = t("orders").df, t("customer").df
    parts = [o.join(c.hint(h), o.o_custkey == c.c_custkey).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")).withColumn("h", F.lit(h)) for h in ("broadcast", "shuffle_hash", "merge")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def ntile_even(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("part").df.select("p_partkey", aggregation.ntile(4, ["p_brand"], [F.col("p_partkey")]).alias("v"))


def unnest_frame(spark, sf_dir):
    s, _ = _frames(spark, sf_dir)
    f = s.sql("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN array_remove_all([p_size], p_size) ELSE [p_size, 1] END AS a FROM part")
    return f.unnest_columns("a").df


def unnest_struct(spark, sf_dir):
    s, _ = _frames(spark, sf_dir)
    return s.sql("SELECT p_partkey, {x: p_size, y: p_name} AS s FROM part").unnest_columns("s").df.toDF("p_partkey", "x", "y")


def frame_chain(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    f = t("lineitem").filter("l_quantity > 10").with_column("net", "l_extendedprice * (1 - l_discount)").aggregate(["l_returnflag"], ["count(*) AS n", "round(sum(net), 4) AS net"])
    return f.with_column_renamed("net", "total").sort("l_returnflag DESC").limit(0, 10).df


def frame_sets(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    a, b = t("part").select("p_size AS k"), t("nation").select("n_nationkey AS k")
    parts = {"u": a.union(b), "ud": a.union_distinct(b), "i": a.intersect(b), "id": a.intersect_distinct(b), "e": a.except_(b), "ed": a.except_distinct(b)}
    out = None
    for name, f in parts.items():
        one = f.aggregate([], ["count(*) AS n", "CAST(sum(k) AS BIGINT) AS s"]).df.withColumn("op", F.lit(name))
        out = one if out is None else out.unionAll(one)
    return out


def frame_distinct_on(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("orders").distinct_on(["o_custkey"], ["o_custkey", "o_orderkey"], ["o_totalprice DESC", "o_orderkey"]).df


def frame_describe(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("part").select("p_size").describe().df.select("describe", F.round(F.col("p_size").cast("double"), 6).alias("p_size"))


def frame_fill_null(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("part").select("p_partkey", "nullif(p_size, 7) AS s").fill_null(-1, ["s"]).df


def frame_window(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("part").window("sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS running").select("p_partkey", "running").df


def frame_drop(spark, sf_dir):
    _, t = _frames(spark, sf_dir)
    return t("nation").drop_columns("n_regionkey").repartition(3, "n_nationkey").alias("x").df


FRAMES = {
    "join_mark": (mark_join, "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS mark FROM customer"),
    "join_algorithms": (join_hints, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, h FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES ('broadcast'), ('shuffle_hash'), ('merge')) v(h) GROUP BY h"),
    "win_ntile_even": (ntile_even, "SELECT p_partkey, CAST(floor((row_number() OVER w - 1) * least(4, n) / n) + 1 AS BIGINT) AS v FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)"),
    "unnest_preserve_nulls": (unnest_frame, "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE unnest([p_size, 1]) END AS a FROM part WHERE p_size % 3 = 2 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 0"),
    "unnest_struct": (unnest_struct, "SELECT p_partkey, p_size AS x, p_name AS y FROM part"),
    "frame_chain": (frame_chain, "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag"),
    "frame_sets": (frame_sets, """WITH a AS (SELECT p_size AS k FROM part), b AS (SELECT n_nationkey AS k FROM nation), s AS (
        SELECT 'u' AS op, k FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'ud', k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'i', k FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b)
        UNION ALL SELECT 'id', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'e', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT 'ed', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b))
        SELECT op, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM s GROUP BY op"""),
    "frame_distinct_on": (frame_distinct_on, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "frame_describe": (frame_describe, "SELECT unnest(['count', 'null_count', 'mean', 'std', 'min', 'max', 'median']) AS describe, round(unnest([count(p_size)::DOUBLE, 0, avg(p_size), stddev_samp(p_size), min(p_size), max(p_size), median(p_size)]), 6) AS p_size FROM part"),
    "frame_fill_null": (frame_fill_null, "SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS s FROM part"),
    "frame_window": (frame_window, "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS running FROM part"),
    "frame_drop": (frame_drop, "SELECT n_nationkey, n_name FROM nation"),
}

QUERIES = {n: in_sql(ours) for n, (ours, _) in SQL.items()} | {n: f for n, (f, _) in FRAMES.items()}
ORACLE = {n: theirs or ours for n, (ours, theirs) in SQL.items()} | {n: sql for n, (_, sql) in FRAMES.items()}
