"""Checks of SQL jobs: scripts, settings, parameters and the breadth of SQL they reach."""

from __future__ import annotations

import re

from lakejobs.plans.registry import QUERIES, TABLES, check, table
from lakejobs.plans.script import run_sql
from lakejobs.session import scratch_path


def use_tables(spark, sf_dir, text):
    """Make the tables a text names visible to it."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_check(name: str, text: str, oracle: str | None = None) -> None:
    """Register one statement that both engines run; ``oracle`` where the wording differs."""

    @check(name, oracle or text)
    def run(spark, sf_dir):
        use_tables(spark, sf_dir, text)
        return run_sql(spark, text)

    QUERIES[name].__name__ = name


@check(
    "q1_script",
    """SELECT c_mktsegment, count(*) AS customers, CAST(sum(spent) AS DOUBLE) AS spent
       FROM customer JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent
                           FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
       WHERE spent > 500000 GROUP BY c_mktsegment""",
)
def q1_script(spark, sf_dir):
    path = scratch_path(spark, "q1_script")
    script = """
        -- what each customer spent; in two statements
        CREATE OR REPLACE TEMPORARY VIEW q1_spent AS
          SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent FROM orders GROUP BY o_custkey;
        SELECT c_mktsegment, count(*) AS customers, CAST(sum(spent) AS DOUBLE) AS spent
        FROM customer JOIN q1_spent ON c_custkey = o_custkey
        WHERE spent > ${q1.low} AND c_mktsegment <> ';' GROUP BY c_mktsegment;
    """
    use_tables(spark, sf_dir, script)
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(path)
    return run_sql(spark, file=f"{path}/*.txt", defines=["q1.low=500000"])


sql_check("q1_select_all", "SELECT * FROM customer")
sql_check("q1_project", "SELECT o_orderkey, o_custkey FROM orders")
sql_check(
    "q1_filter",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority LIKE '1-%'""",
)
sql_check(
    "q1_join_inner",
    """SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name""",
)
sql_check(
    "q1_join_left",
    """SELECT c_custkey, count(o_orderkey) AS orders
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""",
)
sql_check(
    "q1_join_semi",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (
         SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
sql_check(
    "q1_join_anti",
    """SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (
         SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')""",
)
sql_check(
    "q1_join_theta",
    """SELECT o_orderstatus, count(*) AS late FROM orders JOIN lineitem
         ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice * 4 > o_totalprice
       GROUP BY o_orderstatus""",
)
sql_check(
    "q1_group_having",
    """SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem
       GROUP BY l_suppkey HAVING count(*) > 590""",
)
sql_check(
    "q1_distinct_agg",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
)
_FLAGS = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY "
sql_check("q1_rollup", _FLAGS + "ROLLUP (l_returnflag, l_linestatus)")
sql_check("q1_cube", _FLAGS + "CUBE (l_returnflag, l_linestatus)")
sql_check("q1_grouping_sets", _FLAGS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql_check(
    "q1_rank",
    """SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (
         SELECT o_custkey, o_orderkey,
                rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ranked
       WHERE r <= 3""",
)
sql_check(
    "q1_running_frame",
    """SELECT o_custkey, o_orderkey, count(*) OVER w AS n, min(o_orderpriority) OVER w AS lowest FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
sql_check(
    "q1_lag",
    """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
              lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events""",
)
sql_check(
    "q1_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
sql_check(
    "q1_union",
    "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
)
sql_check(
    "q1_intersect",
    "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09",
)
sql_check(
    "q1_except",
    "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
)
sql_check(
    "q1_string",
    """SELECT p_partkey, upper(p_name) AS name, CAST(length(p_type) AS INTEGER) AS size, substring(p_brand, 7) AS brand,
              replace(p_name, ' ', '_') AS snake, concat(p_brand, '/', p_type) AS kind FROM part""",
)
sql_check(
    "q1_date",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS d,
              datediff(o_orderdate, DATE'1992-01-01') AS since FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
              CAST(dayofyear(o_orderdate) AS INTEGER) AS d,
              CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since
       FROM orders""",
)
sql_check(
    "q1_math",
    """SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 7) AS BIGINT) AS weeks, abs(l_discount - 0.05) AS off,
              l_partkey % 10 AS digit, sqrt(l_quantity) AS root FROM lineitem""",
)
sql_check(
    "q1_array_map",
    """SELECT o_orderkey, size(split(o_orderpriority, '-')) AS parts,
              aggregate(sequence(1L, 1 + o_orderkey % 5), 0L, (a, x) -> a + x) AS total,
              map(o_orderstatus, o_custkey)['F'] AS f_customer FROM orders""",
    """SELECT o_orderkey, CAST(len(string_split(o_orderpriority, '-')) AS INTEGER) AS parts,
              CAST(list_sum(range(1, 2 + o_orderkey % 5)) AS BIGINT) AS total,
              CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS f_customer FROM orders""",
)
sql_check(
    "q1_lateral_view",
    """SELECT word, count(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word GROUP BY word""",
    """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""",
)
sql_check(
    "q1_json",
    """SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""",
    """SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""",
)
