"""Checks of scans, sinks and bounded output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakejobs.operators.flow import foreach_generate
from lakejobs.operators.ordered import limit_bytes
from lakejobs.plans.registry import check, table
from lakejobs.session import scratch_path
from lakejobs.sources.delimited import scan_delimited, scan_positional, write_delimited
from lakejobs.sources.files import file_inventory, read_inputs
from lakejobs.sources.json_lines import write_json_lines
from lakejobs.sources.spec import Clustering, Column, RowFormat, SortKey, Storage, TableSpec
from lakejobs.sources.tables import load_overwrite, scan_external, write_table

ORDERS = (
    Column("o_orderkey", "bigint"),
    Column("o_custkey", "bigint"),
    Column("o_totalprice", "double"),
    Column("o_orderdate", "timestamp_ntz"),
    Column("o_orderpriority", "string", "one of five"),
)
STATUS = Column("o_orderstatus", "string")


def fresh_table(label: str) -> str:
    """A table name no other run uses: all checks share one catalog."""
    return f"{label}_{uuid.uuid4().hex[:12]}"


def orders_by_status(spark, sf_dir, label, **spec):
    """The orders as a table partitioned by status, kept in the shared folder."""
    declared = TableSpec(
        fresh_table(label), ORDERS, (STATUS,), location=scratch_path(spark, label), **spec
    )
    write_table(table(spark, sf_dir, "orders"), declared)
    return declared.table


@check("s1_delimited_roundtrip", "SELECT * FROM orders")
def s1_delimited_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "s1")
    write_delimited(orders, path)
    return scan_delimited(spark, path, orders.schema)


@check(
    "s2_nested_roundtrip",
    """SELECT o_orderkey, 3 AS n_items, o_custkey AS second_item, o_orderkey % 7 AS third_item,
              CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS of_status,
              o_orderkey % 6 = 0 AS no_map,
              CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 > 1 THEN o_orderstatus END AS note
       FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)
       WHERE o_orderkey % 6 <> 0
       UNION ALL
       SELECT o_orderkey, 3, o_custkey, o_orderkey % 7, NULL, TRUE,
              CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 > 1 THEN o_orderstatus END
       FROM orders WHERE o_orderkey % 6 = 0""",
)
def s2_nested_roundtrip(spark, sf_dir):
    n = F.col("o_orderkey")
    priority = F.when(n % 5 != 0, F.col("o_orderpriority"))
    nested = table(spark, sf_dir, "orders").select(
        n,
        F.array(n, "o_custkey", n % 7).alias("items"),
        F.when(n % 6 != 0, F.create_map("o_orderstatus", priority)).alias("by_status"),
        F.when(n % 4 == 0, "").when(n % 4 > 1, F.col("o_orderstatus")).alias("note"),
        "o_orderstatus",
    )
    path = scratch_path(spark, "s2")
    write_delimited(nested, path)
    back = scan_delimited(spark, path, nested.schema)
    return back.select(
        "o_orderkey",
        F.size("items").alias("n_items"),
        F.get("items", F.lit(1)).alias("second_item"),
        F.get("items", F.lit(2)).alias("third_item"),
        F.try_element_at("by_status", F.col("o_orderstatus")).alias("of_status"),
        F.col("by_status").isNull().alias("no_map"),
        "note",
    )


@check(
    "s3_positional_project",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS absent
       FROM customer""",
)
def s3_positional_project(spark, sf_dir):
    path = scratch_path(spark, "s3")
    line = F.concat_ws(":", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    table(spark, sf_dir, "customer").select(line).write.text(path)
    return foreach_generate(scan_positional(spark, path, ":"), id=0, segment=2, absent=3)


@check(
    "s4_load_overwrite",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_orderstatus <> 'F' OR o_totalprice > 250000""",
)
def s4_load_overwrite(spark, sf_dir):
    name = orders_by_status(spark, sf_dir, "s4")
    large = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000")
    load_overwrite(spark, large.drop("o_orderstatus"), name, "o_orderstatus='F'")
    return spark.table(name).select("o_orderkey", "o_orderstatus", "o_totalprice")


@check(
    "s5_external_scan",
    """SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, CAST(NULL AS VARCHAR) AS added
       FROM orders GROUP BY o_orderstatus""",
)
def s5_external_scan(spark, sf_dir):
    declared = "o_orderkey bigint, o_orderstatus string, added string"
    data = scan_external(spark, f"{sf_dir}/orders.parquet", declared)
    return data.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("added").alias("added")
    )


def _stored_orders(spark, sf_dir, label, storage):
    spec = TableSpec(
        fresh_table(label), (*ORDERS, STATUS), storage=storage, location=scratch_path(spark, label)
    )
    return write_table(table(spark, sf_dir, "orders"), spec)


@check("s6_orc_roundtrip", "SELECT * FROM orders")
def s6_orc_roundtrip(spark, sf_dir):
    return _stored_orders(spark, sf_dir, "s6_orc", Storage(stored_as="orc"))


@check("s6_textfile_roundtrip", "SELECT * FROM orders")
def s6_textfile_roundtrip(spark, sf_dir):
    storage = Storage(RowFormat(fields="|"), stored_as="textfile")
    return _stored_orders(spark, sf_dir, "s6_text", storage)


@check("s6_rcfile_word", "SELECT * FROM orders")
def s6_rcfile_word(spark, sf_dir):
    return _stored_orders(spark, sf_dir, "s6_rc", Storage(stored_as="rcfile"))


@check("s7_file_inventory")
def s7_file_inventory(spark, sf_dir):
    files = file_inventory(spark, sf_dir, "*.parquet")
    return files.select(F.substring_index("path", "/", -1).alias("file"), "length")


@check(
    "s7_inventory_bytes",
    """SELECT lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang""",
)
def s7_inventory_bytes(spark, sf_dir):
    path = scratch_path(spark, "s7")
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value"), "lang").write.partitionBy("lang").text(path)
    files = file_inventory(spark, path)
    lang = F.nullif(F.url_decode(F.regexp_extract("path", "/lang=([^/]*)/", 1)), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return files.groupBy(lang.alias("lang")).agg(F.sum("length").alias("bytes"))


@check("s8_multi_input", "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")
def s8_multi_input(spark, sf_dir):
    paths = [scratch_path(spark, "s8_customer"), scratch_path(spark, "s8_supplier")]
    table(spark, sf_dir, "customer").select("c_name").write.text(paths[0])
    table(spark, sf_dir, "supplier").select("s_name").write.text(paths[1])
    return read_inputs(spark, ",".join(paths))


COUNTED_ROWS = 1_000_000  # of a table, in one task that counts distinct values


@check(
    "s9_write_table",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS part_sum,
              count(DISTINCT l_orderkey) AS orders
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def s9_write_table(spark, sf_dir):
    spec = TableSpec(
        fresh_table("s9"),
        (Column("l_orderkey", "bigint", "the order"), Column("l_partkey", "bigint"), Column("l_quantity", "double")),
        (Column("l_returnflag", "string"), Column("l_linestatus", "string")),
        Clustering(("l_orderkey",), 8, (SortKey("l_orderkey"), SortKey("l_partkey"))),
        location=scratch_path(spark, "s9"),
        comment="line items by flag",
        properties={"prop1": "val1", "prop2": "val2"},
    )
    lines = table(spark, sf_dir, "lineitem")
    names = [f.name for f in spec.schema()]
    written = write_table(lines.select(names), spec)
    # Dealt anew, else an order would be counted where its bucket is read, in 8 tasks however large the table is.
    tasks = max(spark.sparkContext.defaultParallelism, -(-written.count() // COUNTED_ROWS))
    return (
        written.repartition(tasks, "l_returnflag", "l_linestatus", "l_orderkey")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum("l_partkey").alias("part_sum"),
            F.countDistinct("l_orderkey").alias("orders"),
        )
    )


@check(
    "s10_limit_bytes",
    """SELECT source, doc_id FROM (
         SELECT source, doc_id,
                sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
       WHERE upto <= 65536""",
)
def s10_limit_bytes(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return limit_bytes(documents, "text", 65536, "doc_id", "source").select("source", "doc_id")


@check(
    "s10_limit_bytes_global",
    """SELECT doc_id FROM (
         SELECT doc_id, sum(strlen(text) + 1) OVER (ORDER BY doc_id) AS upto FROM documents)
       WHERE upto <= 1048576""",
)
def s10_limit_bytes_global(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return limit_bytes(documents, "text", 1048576, "doc_id").select("doc_id")


@check(
    "f8_json_roundtrip",
    """SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS o_orderpriority, o_orderkey,
              o_totalprice, 'default' AS "database", 'orders' AS "table" FROM orders""",
)
def f8_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "f8")
    some = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", some, "o_totalprice")
    write_json_lines(orders, path, database="default", table="orders")
    kind = "o_orderkey bigint, o_orderpriority string, o_totalprice double, database string, table string"
    return spark.read.schema(kind).json(path)
