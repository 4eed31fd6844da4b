"""Checks of dataflow steps, map/reduce, lists and JSON documents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lakejobs.functions.aggregates import aggregate
from lakejobs.functions.documents import annotate_json, first_entry
from lakejobs.functions.udfs import register_udfs, user_aggregates
from lakejobs.functions.values import row_rand
from lakejobs.operators.flow import foreach_generate, group_all_count
from lakejobs.operators.heavy import top_words
from lakejobs.operators.lists import pack_lists, unpack_lists
from lakejobs.operators.mapreduce import stream_map_reduce, text_wc, word_count
from lakejobs.operators.selection import drop_unset, status_summary, split_valid
from lakejobs.plans import derived
from lakejobs.plans.registry import check, spread, table
from lakejobs.session import scratch_path
from lakejobs.sources.delimited import field, scan_positional

SAMPLE_UDFS = os.path.join(os.path.dirname(__file__), "sample_udfs.py")

WORD_COUNT_SQL = r"""SELECT word, count(*) AS "count" FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
  WHERE word <> '' GROUP BY word"""


@check("q2_row_rand", """SELECT o_orderkey,
  CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS r
  FROM orders""")
def q2_row_rand(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", row_rand("o_custkey").alias("r"))


@check("p1_foreach", """SELECT CAST(o_orderkey AS VARCHAR) AS id, upper(o_orderpriority) AS priority FROM orders""")
def p1_foreach(spark, sf_dir):
    path = scratch_path(spark, "p1")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    return foreach_generate(scan_positional(spark, path), id=0, priority=F.upper(field(1)))


@check("p1_reverse", """SELECT reverse(o_orderkey || chr(9) || o_orderpriority) AS reversed FROM orders""")
def p1_reverse(spark, sf_dir):
    path = scratch_path(spark, "p1r")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    return foreach_generate(spark.read.text(path), reversed=F.reverse("value"))


@check(
    "p2_python_udf",
    """SELECT o_orderkey, 'Hello, World' AS word, length(o_orderpriority) AS size FROM orders""",
)
def p2_python_udf(spark, sf_dir):
    register_udfs(spark, SAMPLE_UDFS, "myfuncs")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "myfuncs_helloworld() AS word", "myfuncs_size(o_orderpriority) AS size"
    )


@check(
    "p2_nested_types",
    """SELECT p_partkey, CAST(place AS INTEGER) AS place, text, CAST(nullif(length(text) - length(replace(text, 'o', '')), 0) AS INTEGER) AS o,
         CAST(nullif(length(text) - length(replace(text, 'r', '')), 0) AS INTEGER) AS r
       FROM (SELECT p_partkey, unnest(range(len(w))) AS place, unnest(w) AS text FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))""",
)
def p2_nested_types(spark, sf_dir):
    register_udfs(spark, SAMPLE_UDFS, "nested")
    found = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.call_function("nested_words", "p_name")))
    letter = lambda c: F.try_element_at("letters", F.lit(c)).alias(c)
    return found.select("p_partkey", "place", "text", letter("o"), letter("r"))


@check(
    "p2_table_function",
    """WITH e AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stay FROM events)
       SELECT user_id, CAST(count(*) AS INTEGER) AS visits, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY user_id, coalesce(stay, 0)""",
)
def p2_table_function(spark, sf_dir):
    register_udfs(spark, SAMPLE_UDFS, "tables")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return spark.sql("SELECT * FROM tables_Stays(TABLE({events}) PARTITION BY user_id ORDER BY event_id)", events=events)


@check(
    "p2_aggregate",
    """SELECT event_type, count(v) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, CAST(sum(v % 2) AS BIGINT) AS odd
       FROM (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events) GROUP BY event_type""",
)
def p2_aggregate(spark, sf_dir):
    """A few hot keys: each task hands on one state per key."""
    cents = F.when(F.col("event_id") % 5 > 0, F.round(F.col("value") * 100).cast("bigint")).alias("cents")
    events = table(spark, sf_dir, "events").select("event_type", cents)
    spread = user_aggregates(spark, SAMPLE_UDFS)["Spread"]
    return aggregate(events, ["event_type"], spread, ["cents"], "spread").select("event_type", "spread.*")


@check("p3_row_count", "SELECT count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS n FROM events")
def p3_row_count(spark, sf_dir):
    return group_all_count(derived.job_events(spark, sf_dir), "val")


@check("m1_pipe_count", f'SELECT CAST(sum("count") AS BIGINT) AS words FROM ({WORD_COUNT_SQL})')
def m1_pipe_count(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "documents").select("text"))
    counted = stream_map_reduce(
        spark, texts, "cat", "awk '{n += $1} END {print n + 0}'", combiner="wc -w"
    )
    return counted.agg(F.sum(F.col("key").cast("bigint")).alias("words"))


@check("m1_pipe_words", WORD_COUNT_SQL)
def m1_pipe_words(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "documents").select("text"))
    words = r"""awk -F '[ \t\r\f]+' '{for (i = 1; i <= NF; i++) if ($i != "") print $i "\t1"}'"""
    total = r"""awk -F '\t' '$1 != k {if (NR > 1) print k "\t" n; k = $1; n = 0} {n += $2}
                             END {if (NR > 0) print k "\t" n}'"""
    counted = stream_map_reduce(
        spark, texts, words, total, combiner=total, env={"LC_ALL": "C"}
    )
    return counted.select(F.col("key").alias("word"), F.col("value").cast("bigint").alias("count"))


@check("m2_word_count", WORD_COUNT_SQL)
def m2_word_count(spark, sf_dir):
    return word_count(table(spark, sf_dir, "documents"), "text")


@check("m2_top_words", WORD_COUNT_SQL + ' ORDER BY "count" DESC, word LIMIT 100')
def m2_top_words(spark, sf_dir):
    return top_words(table(spark, sf_dir, "documents"), "text", 100)


@check(
    "m3_text_wc",
    r"""SELECT source, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines,
          CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> ''))) AS BIGINT) AS words,
          CAST(sum(strlen(text)) AS BIGINT) AS bytes
        FROM documents GROUP BY source""",
)
def m3_text_wc(spark, sf_dir):
    return text_wc(table(spark, sf_dir, "documents"), "text", "source")


# Items with commas, backslashes, empty and null ones.
ITEM_SQL = r"""CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN ''
  WHEN event_id % 9 = 2 THEN 'a\,b' WHEN event_id % 9 = 3 THEN 'x,\' ELSE event_type || ',' || props END"""


def _items(spark, sf_dir):
    n = F.col("event_id")
    item = (
        F.when(n % 9 == 0, None)
        .when(n % 9 == 1, "")
        .when(n % 9 == 2, "a\\,b")
        .when(n % 9 == 3, "x,\\")
        .otherwise(F.concat("event_type", F.lit(","), "props"))
    )
    return table(spark, sf_dir, "events").select("user_id", "event_id", item.alias("item"))


@check(
    "f1_pack",
    rf"""SELECT user_id, 0 AS part,
           string_agg(replace(replace(coalesce(item, ''), '\', '\\'), ',', '\,'), ',' ORDER BY event_id) AS items
         FROM (SELECT *, {ITEM_SQL} AS item FROM events) GROUP BY user_id""",
)
def f1_pack(spark, sf_dir):
    return pack_lists(_items(spark, sf_dir), "user_id", "item", "event_id", "items").select("user_id", "part", "items")


UNPACKED_SQL = f"""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
          coalesce({ITEM_SQL}, '') AS item FROM events"""


@check("f2_pack_unpack", UNPACKED_SQL)
def f2_pack_unpack(spark, sf_dir):
    return unpack_lists(pack_lists(_items(spark, sf_dir), "user_id", "item", "event_id", "items"), "items")


@check("f2_pack_unpack_parts", UNPACKED_SQL)
def f2_pack_unpack_parts(spark, sf_dir):
    # Small parts, so that most lists come in several.
    packed = pack_lists(_items(spark, sf_dir), "user_id", "item", "event_id", "items", max_list_bytes=1_000)
    return unpack_lists(packed, "items")


@check(
    "f3_drop_unset",
    f"""SELECT event_id, item, CAST(event_id % 4 AS INTEGER) AS n_marks FROM (SELECT *, {ITEM_SQL} AS item FROM events)
        WHERE item IS NOT NULL AND item <> '' AND event_id % 4 > 0""",
)
def f3_drop_unset(spark, sf_dir):
    marks = F.array_repeat(F.lit("m"), (F.col("event_id") % 4).cast("int"))
    rows = _items(spark, sf_dir).withColumn("marks", marks)
    kept = drop_unset(rows, ["item", "marks"])
    return kept.select("event_id", "item", F.size("marks").alias("n_marks"))


@check(
    "f4_split_valid",
    """SELECT 'event_type' AS col, event_type AS value, CAST(NULL AS VARCHAR) AS problem FROM events
       WHERE regexp_full_match(event_type, '[a-zA-Z][a-zA-Z0-9_]*')
       UNION ALL
       SELECT 'p_name', p_name, CASE WHEN p_name IS NULL THEN 'Missing'
         WHEN NOT regexp_full_match(p_name, '[a-zA-Z][a-zA-Z0-9_]*') THEN 'Invalid DDL identifier' END
       FROM part""",
)
def f4_split_valid(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.lit("event_type").alias("col"), F.col("event_type").alias("value")
    )
    parts = table(spark, sf_dir, "part").select(F.lit("p_name").alias("col"), F.col("p_name").alias("value"))
    valid, invalid, _ = split_valid(events.unionAll(parts), "value")
    return valid.withColumn("problem", F.lit(None).cast("string")).unionByName(invalid)


@check(
    "f4_problem_counts",
    """SELECT CASE WHEN p_name IS NULL THEN 'Missing'
         WHEN NOT regexp_full_match(p_name, '[a-zA-Z][a-zA-Z0-9_]*') THEN 'Invalid DDL identifier' END AS problem,
       count(*) AS rows FROM part GROUP BY 1""",
)
def f4_problem_counts(spark, sf_dir):
    return split_valid(table(spark, sf_dir, "part").select("p_name"), "p_name")[2]


@check(
    "f5_annotate_json",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{' ELSE '{"k":' || json_extract_string(props, '$.k') || ',' END
         || '"type":"' || event_type || '","event":' || event_id || '}' AS doc FROM events""",
)
def f5_annotate_json(spark, sf_dir):
    whole = annotate_json("props", {"type": F.col("event_type"), "event": F.col("event_id")})
    without = annotate_json("props", {"type": F.col("event_type"), "event": F.col("event_id")}, ["k"])
    doc = F.when(F.col("event_id") % 3 == 0, without).otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


@check(
    "f6_status_summary",
    f"""SELECT coalesce(TRY_CAST(json_extract_string(doc, '$.errorCode') AS INTEGER),
          CASE WHEN list_contains(json_keys(doc), 'error') THEN 500 ELSE 200 END) AS status, count(*) AS documents
        FROM ({derived.RESPONSES_SQL}) GROUP BY 1""",
)
def f6_status_summary(spark, sf_dir):
    return status_summary(derived.responses(spark, sf_dir), "doc")


@check(
    "f7_first_entries",
    f"""SELECT event_id, CASE WHEN doc LIKE '{{"error"%' THEN doc
          ELSE coalesce(CAST(json_extract(doc, '$.tables[0]') AS VARCHAR),
                        '{{"error":"Table t' || event_id || ' does not exist","errorCode":404}}') END AS entry
        FROM ({derived.RESPONSES_SQL})""",
)
def f7_first_entries(spark, sf_dir):
    name = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    rows = derived.responses(spark, sf_dir)
    return rows.select("event_id", first_entry("doc", "tables", name).alias("entry"))
