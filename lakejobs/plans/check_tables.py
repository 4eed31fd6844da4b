"""Checks of table layout, partitions, evolution and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.operators.footers import footer_stats
from lakejobs.operators.partitions import (
    NULL_PARTITION,
    add_partition,
    describe_partition,
    drop_partition,
    partition_stats,
    partitions,
)
from lakejobs.operators.sketches import refresh_sketches, sketch_profile
from lakejobs.operators.stats import profile_column, profile_columns, table_stats
from lakejobs.plans.check_sources import ORDERS, STATUS, fresh_table, orders_by_status
from lakejobs.plans.registry import check, table
from lakejobs.session import scratch_path
from lakejobs.sources.spec import Clustering, Column, SortKey, TableSpec
from lakejobs.sources.tables import (
    add_column,
    conform,
    create_like,
    create_table,
    load_overwrite,
    read_evolved,
    write_table,
)


@check(
    "t1_conform",
    """SELECT l_shipdate, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_orderkey AS VARCHAR) AS l_orderkey,
              CAST(NULL AS INTEGER) AS l_added FROM lineitem""",
)
def t1_conform(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    declared = (
        Column("l_shipdate", "timestamp_ntz"),
        Column("l_quantity", "bigint", "whole units"),
        Column("l_orderkey", "chararray"),
        Column("l_added", "int"),
    )
    return conform(lines, declared)


@check(
    "t2_partitioned",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem""",
)
def t2_partitioned(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_returnflag", "l_orderkey", "l_partkey", "l_linenumber"
    )
    spec = TableSpec(
        fresh_table("t2"),
        (Column("l_orderkey", "bigint"), Column("l_partkey", "bigint"), Column("l_linenumber", "int")),
        (Column("l_returnflag", "string"), Column("l_linestatus", "string")),
        location=scratch_path(spark, "t2"),
    )
    return write_table(lines, spec)


def _clustered(spark, sf_dir, label, order):
    cluster = Clustering(("o_custkey",), 8, (SortKey("o_orderkey", order),))
    spec = TableSpec(
        fresh_table(label), (*ORDERS, STATUS), clustered_by=cluster, location=scratch_path(spark, label)
    )
    return write_table(table(spark, sf_dir, "orders"), spec)


@check(
    "t3_clustered",
    "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey",
)
def t3_clustered(spark, sf_dir):
    return (
        _clustered(spark, sf_dir, "t3", "ASC")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))
    )


@check("t3_clustered_desc", "SELECT * FROM orders")
def t3_clustered_desc(spark, sf_dir):
    return _clustered(spark, sf_dir, "t3d", "DESC")


@check("t4_create_like", "SELECT * FROM orders")
def t4_create_like(spark, sf_dir):
    existing, new = orders_by_status(spark, sf_dir, "t4"), fresh_table("t4_like")
    create_like(spark, existing, new, scratch_path(spark, "t4_like"))
    load_overwrite(spark, spark.table(existing), new)
    return spark.table(new)


EVOLVED_SQL = """
  SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority
  FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1"""


@check("t5_evolved_read", EVOLVED_SQL)
def t5_evolved_read(spark, sf_dir):
    orders, path = table(spark, sf_dir, "orders"), scratch_path(spark, "t5")
    first = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    second = orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_totalprice", "o_orderpriority")
    first.write.parquet(f"{path}/generation1")
    second.write.parquet(f"{path}/generation2")
    return read_evolved(spark, [f"{path}/generation1", f"{path}/generation2"], second.schema)


@check("t5_add_column", EVOLVED_SQL)
def t5_add_column(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    columns = (Column("o_orderkey", "bigint"), Column("o_totalprice", "double"))
    spec = TableSpec(fresh_table("t5"), columns, location=scratch_path(spark, "t5_table"))
    first = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    write_table(first, spec)
    evolved = add_column(spark, spec.table, Column("o_orderpriority", "string", "one of five"))
    conform(
        orders.where("o_orderkey % 2 = 1").select(*evolved.columns), evolved.schema
    ).write.insertInto(spec.table)
    return spark.table(spec.table)


@check("t6_add_partition", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def t6_add_partition(spark, sf_dir):
    """A partition per status there is, every second one at a place of its own, and one for no status."""
    orders = table(spark, sf_dir, "orders")
    columns = (Column("o_orderkey", "bigint"), Column("o_custkey", "bigint"))
    spec = TableSpec(fresh_table("t6"), columns, (STATUS,), location=scratch_path(spark, "t6"))
    create_table(spark, spec)
    found = [r[0] for r in orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]  # partition names
    for i, status in enumerate([*found, *([] if None in found else [None])]):
        place = scratch_path(spark, "t6_elsewhere") if i % 2 else None
        rows = orders.where(F.col("o_orderstatus").eqNullSafe(F.lit(status))).select("o_orderkey", "o_custkey")
        named = f"o_orderstatus='{NULL_PARTITION if status is None else status}'"
        add_partition(spark, spec.table, named, rows, location=place)
        add_partition(spark, spec.table, named, rows, if_not_exists=True)
    return spark.table(spec.table)


def _lines_by_flag(spark, sf_dir, label):
    spec = TableSpec(
        fresh_table(label),
        (Column("l_orderkey", "bigint"), Column("l_partkey", "bigint"), Column("l_linenumber", "int")),
        (Column("l_returnflag", "string"), Column("l_linestatus", "string")),
        location=scratch_path(spark, label),
    )
    write_table(table(spark, sf_dir, "lineitem").select([f.name for f in spec.schema()]), spec)
    return spec.table


@check(
    "t7_drop_partition",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
       WHERE l_returnflag <> 'R' AND NOT (l_returnflag = 'A' AND l_linestatus = 'F')""",
)
def t7_drop_partition(spark, sf_dir):
    name = _lines_by_flag(spark, sf_dir, "t7")
    drop_partition(spark, name, "l_returnflag='R'")
    drop_partition(spark, name, "l_returnflag='A',l_linestatus='F'")
    return spark.table(name).drop("l_partkey")


@check(
    "t8_partitions",
    """SELECT 'l_returnflag=''' || l_returnflag || ''',l_linestatus=''' || l_linestatus || '''' AS name,
              count(*) AS rows FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def t8_partitions(spark, sf_dir):
    return partitions(spark, _lines_by_flag(spark, sf_dir, "t8")).select("name", "rows")


@check(
    "t8_footer_rows",
    """SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) - count(l_orderkey) AS l_orderkey_nulls, min(l_orderkey) AS l_orderkey_min, max(l_orderkey) AS l_orderkey_max,
         count(*) - count(l_linenumber) AS l_linenumber_nulls, min(l_linenumber) AS l_linenumber_min, max(l_linenumber) AS l_linenumber_max
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def t8_footer_rows(spark, sf_dir):
    return footer_stats(spark, _lines_by_flag(spark, sf_dir, "t8f"), ["l_orderkey", "l_linenumber"])


@check(
    "t9_describe_partition",
    """SELECT 'o_orderstatus=''F''' AS "partition", 5 AS n_columns, 1 AS n_partition_columns,
              count(*) AS "numberOfRows" FROM orders WHERE o_orderstatus = 'F'""",
)
def t9_describe_partition(spark, sf_dir):
    about = describe_partition(spark, orders_by_status(spark, sf_dir, "t9"), "o_orderstatus='F'")
    return about.select(
        "partition",
        F.size("columns").alias("n_columns"),
        F.size("partitionColumns").alias("n_partition_columns"),
        "numberOfRows",
    )


def _profile_sql(position: int, name: str) -> str:
    return f"""SELECT {position} AS position, '{name}' AS name, count(*) AS rows,
      count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS "distinct",
      CAST(min({name}) AS VARCHAR) AS min, CAST(max({name}) AS VARCHAR) AS max FROM customer"""


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@check("t10_column_profile", " UNION ALL ".join(_profile_sql(i, n) for i, n in enumerate(CUSTOMER)))
def t10_column_profile(spark, sf_dir):
    return profile_columns(table(spark, sf_dir, "customer"), exact_distinct=True)


@check("t10_column_profile_approx")
def t10_column_profile_approx(spark, sf_dir):
    return profile_columns(table(spark, sf_dir, "lineitem"))


def _sketched(columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
            TRUE AS distinct_close, TRUE AS quantiles_close FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'"""
        for c in columns.split()
    )


@check("t10_sketch_profile", _sketched("o_orderkey o_custkey o_totalprice o_orderdate o_orderpriority"))
def t10_sketch_profile(spark, sf_dir):
    """Sketches of a table that lost a partition and got another, beside exact numbers of what it holds then."""
    orders, folder = table(spark, sf_dir, "orders"), scratch_path(spark, "t10_sketches")
    spec = TableSpec(fresh_table("t10"), ORDERS, (STATUS,), location=scratch_path(spark, "t10"))
    write_table(orders.where("NOT o_orderstatus <=> 'P'"), spec)
    refresh_sketches(spark, spec.table, folder)
    add_partition(spark, spec.table, "o_orderstatus='P'", orders.where("o_orderstatus = 'P'").drop("o_orderstatus"))
    drop_partition(spark, spec.table, "o_orderstatus='O'")
    refresh_sketches(spark, spec.table, folder)
    profile = sketch_profile(spark, spec.table, folder)
    now = spark.table(spec.table).drop("o_orderstatus")
    exact = profile_columns(now, exact_distinct=True).select("name", F.col("distinct").alias("truly"))
    quantiles = {r["name"]: r["quantiles"] for r in profile.collect() if r["quantiles"]}  # three numbers per column
    ranks = now.agg(*[F.avg((F.col(c) <= q).cast("double")).alias(f"{c}{i}") for c, qs in quantiles.items() for i, q in enumerate(qs)]).first()
    close = {c: all(abs(ranks[f"{c}{i}"] - at) < 0.03 for i, at in enumerate((0.25, 0.5, 0.75))) for c in quantiles}
    good = F.col("name").isin([c for c, ok in close.items() if ok] + [c for c in now.columns if c not in close])
    near = F.abs(F.col("distinct") - F.col("truly")) <= F.col("truly") * 0.06
    return profile.join(F.broadcast(exact), "name").select("name", "rows", "nulls", "min", "max", near.alias("distinct_close"), good.alias("quantiles_close"))


@check(
    "t11_column",
    """SELECT 'l_returnflag' AS name, count(*) AS rows, count(*) - count(l_returnflag) AS nulls,
              count(DISTINCT l_returnflag) AS "distinct", min(l_returnflag) AS min, max(l_returnflag) AS max
       FROM lineitem""",
)
def t11_column(spark, sf_dir):
    return profile_column(table(spark, sf_dir, "lineitem"), "l_returnflag", exact_distinct=True)


@check("t12_table_stats")
def t12_table_stats(spark, sf_dir):
    stats = table_stats(spark, orders_by_status(spark, sf_dir, "t12"))
    return stats.select("partitioned", "totalNumberFiles", "totalFileSize", "maxFileSize", "minFileSize")


@check(
    "t12_stats_bytes",
    """SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS "totalFileSize",
       FALSE AS partitioned, TRUE AS within FROM documents""",
)
def t12_stats_bytes(spark, sf_dir):
    path = scratch_path(spark, "t12")
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    stats, mean = table_stats(spark, path, "text"), F.col("totalFileSize") / F.col("totalNumberFiles")
    return stats.select("totalFileSize", "partitioned", mean.between(F.col("minFileSize"), F.col("maxFileSize")).alias("within"))


@check(
    "t12_rows_per_file",
    "SELECT o_orderstatus, count(*) AS rows, TRUE AS has_bytes FROM orders GROUP BY o_orderstatus",
)
def t12_rows_per_file(spark, sf_dir):
    stored = spark.table(orders_by_status(spark, sf_dir, "t12"))
    stats = partition_stats(stored, ["o_orderstatus"])
    return stats.select("o_orderstatus", "rows", (F.col("bytes") > 0).alias("has_bytes"))
