"""The decision-support queries that the tables allow; where a column is absent a present one stands in."""

from __future__ import annotations

from tessera.registry import in_sql

SQL: dict[str, str] = {
    "tpch_q01": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q03": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate, o_orderpriority
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60 days')
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q06": """
        SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": """
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
            FROM supplier, lineitem, orders, customer, nation n1, nation n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey <> n2.n_regionkey) AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": """
        SELECT o_year, round(sum(CASE WHEN nation = 'BRAZIL' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (
            SELECT CAST(EXTRACT(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
            FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey) AS all_nations
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": """
        SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (
            SELECT n_name AS nation, CAST(EXTRACT(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.1 AS amount
            FROM part, supplier, lineitem, orders, nation
            WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%e%') AS profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q12": """
        SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(sum(CASE WHEN NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (
            SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": """
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'""",
    "tpch_q15": """
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": """
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_size < 25 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS total_qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part
        WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30))""",
    "tpch_q20": """
        SELECT s_name FROM supplier WHERE s_suppkey IN (
            SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'a%' OR p_name LIKE 'b%') GROUP BY l_suppkey HAVING sum(l_quantity) > 100) ORDER BY s_name""",
    "tpch_q21": """
        SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
        GROUP BY c_nationkey ORDER BY c_nationkey""",
    "tpch_q02": """
        SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, lineitem, nation, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
          AND l_extendedprice = (SELECT min(l2.l_extendedprice) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q11": """
        SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier WHERE l_suppkey = s_suppkey
        GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem) ORDER BY value DESC, l_partkey""",
}

QUERIES = {name: in_sql(text) for name, text in SQL.items()}
ORACLE = dict(SQL)
