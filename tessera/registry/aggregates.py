"""Aggregates, grouping and window functions: our SQL and the oracle's."""

from __future__ import annotations

from tessera.registry import in_sql

_BY = "SELECT p_brand, {} AS v FROM part GROUP BY p_brand"
_XY = "CAST(p_retailprice AS DOUBLE), CAST(p_size AS DOUBLE)"
_SAY = "array_to_string({}, ',', 'N')"
_DSAY = "list_aggregate(list_transform({}, lambda e: coalesce(CAST(e AS VARCHAR), 'N')), 'string_agg', ',')"

#: Aggregate, our expression, the oracle's; over part by brand.
BY_BRAND: dict[str, tuple[str, str | None]] = {
    "avg": ("round(avg(p_retailprice), 4)", None),
    "mean": ("round(mean(p_size), 6)", None),
    "bit_and": ("CAST(bit_and(p_size) AS BIGINT)", None),
    "bit_or": ("CAST(bit_or(p_size) AS BIGINT)", None),
    "bit_xor": ("CAST(bit_xor(p_size) AS BIGINT)", None),
    "bool_and": ("bool_and(p_size > 0)", None),
    "bool_or": ("bool_or(p_size > 49)", None),
    "corr": (f"round(corr({_XY}), 6)", None),
    "count": ("count(nullif(p_size, 7))", None),
    "count_star": ("count(*)", None),
    "count_distinct": ("count(DISTINCT p_size)", None),
    "covar_samp": (f"round(covar_samp({_XY}), 4)", None),
    "covar_pop": (f"round(covar_pop({_XY}), 4)", None),
    "first_value": ("first_value(p_name ORDER BY p_retailprice, p_partkey)", "first(p_name ORDER BY p_retailprice, p_partkey)"),
    "last_value": ("last_value(p_name ORDER BY p_retailprice, p_partkey)", "last(p_name ORDER BY p_retailprice, p_partkey)"),
    "nth_value": ("nth_value(p_partkey, 3 ORDER BY p_partkey DESC)", "list_extract(list(p_partkey ORDER BY p_partkey DESC), 3)"),
    "median": ("median(p_retailprice)", None),
    "max": ("max(p_name)", None),
    "min": ("min(p_name)", None),
    **{f: (f"round({f}({_XY}), 5)", None) for f in ("regr_slope", "regr_intercept", "regr_r2", "regr_avgx", "regr_avgy", "regr_sxx", "regr_syy", "regr_sxy")},
    "regr_count": (f"CAST(regr_count({_XY}) AS BIGINT)", None),
    "stddev": ("round(stddev(p_size), 6)", None),
    "stddev_pop": ("round(stddev_pop(p_size), 6)", None),
    "string_agg": ("string_agg(p_name, '|' ORDER BY p_name)", None),
    "string_agg_distinct": ("string_agg(DISTINCT CAST(p_size AS VARCHAR), '|' ORDER BY CAST(p_size AS VARCHAR))", None),
    "sum": ("CAST(sum(p_size) AS BIGINT)", None),
    "sum_distinct": ("CAST(sum(DISTINCT p_size) AS BIGINT)", None),
    "var": ("round(var(p_size), 5)", "round(var_samp(p_size), 5)"),
    "var_pop": ("round(var_pop(p_size), 5)", None),
    "array_agg": (_SAY.format("array_agg(nullif(p_size, 7) ORDER BY p_partkey)"), _DSAY.format("list(nullif(p_size, 7) ORDER BY p_partkey)")),
    "array_agg_desc": (_SAY.format("array_agg(p_size ORDER BY nullif(p_size, 7) DESC, p_partkey)"), _DSAY.format("list(p_size ORDER BY nullif(p_size, 7) DESC NULLS FIRST, p_partkey)")),
    "array_agg_distinct": (_SAY.format("array_sort(array_agg(DISTINCT p_size % 5))"), _DSAY.format("list_sort(list(DISTINCT p_size % 5))")),
    "filter": ("CAST(sum(p_size) FILTER (WHERE p_retailprice > 1200) AS BIGINT)", None),
    "filter_array_agg": (_SAY.format("array_agg(p_partkey ORDER BY p_partkey) FILTER (WHERE p_size < 20)"), _DSAY.format("list(p_partkey ORDER BY p_partkey) FILTER (WHERE p_size < 20)")),
    # approximate: bounds around the exact value
    "approx_distinct": ("abs(approx_distinct(p_partkey) - count(DISTINCT p_partkey)) <= 0.2 * count(*) + 1", "true"),
    "approx_median": ("abs(approx_median(p_retailprice) - median(p_retailprice)) <= 0.1 * median(p_retailprice)", "true"),
    "approx_percentile_cont": ("approx_percentile_cont(0.9) WITHIN GROUP (ORDER BY p_size) BETWEEN min(p_size) AND max(p_size)", "true"),
    "approx_percentile_cont_with_weight": ("approx_percentile_cont_with_weight(p_size, 0.5) WITHIN GROUP (ORDER BY p_retailprice) BETWEEN min(p_retailprice) AND max(p_retailprice)", "true"),
}

_W = "SELECT o_orderkey, {} AS v FROM orders"
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
WINDOWS: dict[str, tuple[str, str | None]] = {
    "row_number": (f"CAST(row_number() {_OVER} AS BIGINT)", None),
    "rank": ("CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)", None),
    "dense_rank": ("CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)", None),
    "percent_rank": ("round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 9)", None),
    "cume_dist": ("round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 9)", None),
    "ntile": (f"CAST(ntile(4) {_OVER} AS BIGINT)", None),
    "lag": (f"lag(o_totalprice, 2, -1.0) {_OVER}", None),
    "lead": (f"lead(o_orderkey) {_OVER}", None),
    "first_value": (f"first_value(o_orderkey) {_OVER}", None),
    "last_value": ("last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "nth_value": ("nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "ignore_nulls": ("lag(nullif(o_orderkey % 3, 0)) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "lag(nullif(o_orderkey % 3, 0) IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "running_sum": (f"round(sum(o_totalprice) {_OVER}, 2)", None),
    "rows_frame": ("round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)", None),
    "range_frame": ("CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT)", None),
    "range_interval": ("CAST(count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30 days' PRECEDING AND CURRENT ROW) AS BIGINT)", None),
    "whole_partition": ("max(o_totalprice) OVER (PARTITION BY o_orderpriority)", None),
    "filter": (f"count(*) FILTER (WHERE o_orderstatus = 'F') {_OVER}", None),
    "default_frame_peers": ("CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)", None),
}

MORE: dict[str, tuple[str, str | None]] = {
    "win_named": ("SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS a, sum(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS a, CAST(sum(o_orderkey) OVER w AS BIGINT) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "agg_global": ("SELECT count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS q FROM lineitem", None),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "agg_grouping_id": ("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_having": ("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5", None),
    "agg_group_by_all": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL", None),
    "agg_group_ordinals": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2", None),
    "agg_group_alias": ("SELECT p_size % 5 AS bucket, count(*) AS n FROM part GROUP BY bucket", None),
    "agg_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "agg_distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", None),
    "agg_multi_distinct": ("SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_decimal": ("SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS s FROM part GROUP BY p_brand", None),
    "agg_topk_groups": ("SELECT l_partkey, max(l_extendedprice) AS m FROM lineitem GROUP BY l_partkey ORDER BY m DESC, l_partkey LIMIT 10", None),
    "agg_no_rows": ("SELECT count(*) AS n, sum(p_size) AS s, max(p_name) AS m FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_name) AS m FROM part WHERE p_size < 0"),
}

QUERIES = {f"agg_{n}": in_sql(_BY.format(ours)) for n, (ours, _) in BY_BRAND.items()}
QUERIES |= {f"win_{n}": in_sql(_W.format(ours)) for n, (ours, _) in WINDOWS.items()}
QUERIES |= {n: in_sql(ours) for n, (ours, _) in MORE.items()}
ORACLE = {f"agg_{n}": _BY.format(theirs or ours) for n, (ours, theirs) in BY_BRAND.items()}
ORACLE |= {f"win_{n}": _W.format(theirs or ours) for n, (ours, theirs) in WINDOWS.items()}
ORACLE |= {n: theirs or ours for n, (ours, theirs) in MORE.items()}
