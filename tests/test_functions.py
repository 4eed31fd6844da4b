"""Value, list, document and log-line functions on the known vectors."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.errors import BadParam, NotFound
from lakejobs.functions.documents import annotate_json, first_entry, response_status
from lakejobs.functions.joblog import parse_child_id, parse_progress
from lakejobs.functions.lists import decode_list, encode_list
from lakejobs.functions.udfs import outputSchema, register_udfs
from lakejobs.functions.values import identifier_problem, is_set, row_rand
from lakejobs.operators.lists import pack_lists, unpack_lists
from lakejobs.operators.selection import drop_unset, split_valid


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_progress(spark):
    lines = [
        "map 7% reduce 0%", "  map 7% reduce 0%", "[3] map  7% reduce 0%", "x map 007%  \t reduce 1234%", " map 7% reduce 0% ",
        "0% complete", "\t0% complete", "step 2: 0% complete", "pre map 1% reduce 2% 3% complete", "", None,
    ]
    expected = [None, "map 7% reduce 0%", None, "map 007%  \t reduce 1234%", None, None, None, "0% complete", "3% complete", None, None]
    assert values(spark, lines, parse_progress("v")) == expected


def test_child_id(spark):
    lines = [" Running job: a", "Running job: a b", "- Running job:  a", "- HadoopJobId: é-1", "- HadoopJobId: x Running job: y", "", None]
    assert values(spark, lines, parse_child_id("v")) == ["a", None, None, "é-1", "y", None, None]


def test_list_vector(spark):
    lists = [["", "a"], ["\\"], ["\\,", "b\\"], [",", "", ""], ["x\ny", " z "], ["é"]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, items array<string>")
    texts = [r[0] for r in rows.orderBy("i").select(encode_list("items")).collect()]
    assert texts == [",a", "\\\\", "\\\\\\,,b\\\\", "\\,,,", "x\ny, z ", "é"]
    assert values(spark, texts, decode_list("v")) == lists
    assert values(spark, ["\\q", "a\\"], decode_list("v")) == [["q"], ["a"]]


ITEM = st.one_of(st.none(), st.text(alphabet="a,\\ \né", max_size=5))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ITEM, max_size=5), min_size=1, max_size=8))
def test_unpack_of_pack(spark, lists):
    flat = [(k, p, item) for k, items in enumerate(lists) for p, item in enumerate(items)]
    df = spark.createDataFrame(flat, "k int, p int, item string")
    for limit in (16 << 20, 40):
        back = unpack_lists(pack_lists(df, "k", "item", "p", "items", limit), "items")
        assert {(r.k, r.pos, r.item) for r in back.collect()} == {(k, p, item or "") for k, p, item in flat}


def test_empty_items_and_positions_over_parts(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), "id", F.lit("").alias("v"))
    packed = pack_lists(df, "k", "v", "id", max_list_bytes=200)
    assert packed.count() > 5
    back = unpack_lists(packed, "list").collect()
    assert sorted(r.pos for r in back) == list(range(500)) and {r.item for r in back} == {""}


def test_long_list_comes_in_parts(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), "id", F.col("id").cast("string").alias("v")
    )
    packed = pack_lists(df, "k", "v", "id", max_list_bytes=10_000).orderBy("part").collect()
    hot = [r.list for r in packed if r.k == "hot"]
    assert len(hot) > 2
    assert ",".join(hot) == ",".join(str(i) for i in range(2900))
    assert [(r.part, r.list) for r in packed if r.k == "cold"] == [
        (0, ",".join(str(i) for i in range(2900, 3000)))
    ]


def test_small_parts_do_not_make_small_tasks(spark, monkeypatch):
    from lakejobs.operators import lists

    pieces, plain = [], lists.range_pieces
    monkeypatch.setattr(lists, "range_pieces", lambda *a: pieces.append(plain(*a)) or pieces[-1])
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), "id", F.concat(F.lit("x,"), "id").alias("v"))
    packed = pack_lists(df, "k", "v", "id", max_list_bytes=100)
    rows = packed.collect()
    assert len(rows) > 500 and max(len(r.list) for r in rows) < 200
    for k in (None, 1, 2):
        mine = sorted((r.part, r.first_pos, r.n_items) for r in rows if r.k == k)
        assert [m[0] for m in mine] == list(range(len(mine))) and all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:]))
    assert sorted((r.k or 0, r.pos, r.item) for r in unpack_lists(packed, "list").collect()) == [(i % 3, i // 3, f"x,{i}") for k in range(3) for i in range(k, 4000, 3)]
    assert pieces[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_is_set(spark):
    schema = "i int, s string, a array<int>, m map<string,int>"
    rows = [(1, "x", [1], {"k": 1}), (2, "", [1], {"k": 1}), (3, "x", [], {"k": 1}), (4, "x", [1], {}), (5, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r.i for r in drop_unset(df, ["s", "a", "m"]).collect()] == [1]
    assert [r[0] for r in df.select(is_set("s", T.StringType())).collect()] == [True, False, True, True, False]


def test_identifiers(spark):
    texts = ["abc", "a_1", "1a", "", "a b", "café", "abc\n", None]
    bad = "Invalid DDL identifier"
    assert values(spark, texts, identifier_problem("v")) == [None, None, bad, bad, bad, bad, bad, "Missing"]
    valid, invalid, counts = split_valid(spark.createDataFrame([(t,) for t in texts], "v string"), "v")
    assert (valid.count(), invalid.count()) == (2, 6)
    assert {r.problem: r["rows"] for r in counts.collect()} == {None: 2, bad: 5, "Missing": 1}


def test_row_rand(spark):
    one = values(spark, ["1", "2", "1"], row_rand("v"))
    assert one[0] == one[2] != one[1] and all(0 <= r < 1 for r in one)


def test_annotate_json(spark):
    docs = ['{"a":1,"n":null,"o":{"x":[1,2.5]}}', "", None, '{"a":1,"a":2}', "[1]", "nonsense", '{"t":"z"}']
    put = {"t": F.lit("new"), "never": F.lit(None).cast("string")}
    out = values(spark, docs, annotate_json("v", put, ["n"]))
    parsed = [None if d is None else json.loads(d) for d in out]
    assert parsed == [
        {"a": 1, "o": {"x": [1, 2.5]}, "t": "new"}, {"t": "new"}, {"t": "new"}, {"a": 2, "t": "new"}, None, None, {"t": "new"},
    ]
    assert values(spark, ['{"a":1}', '{"b":"1"}'], annotate_json("v", remove=["a"])) == ["{}", '{"b":"1"}']
    numbers = '{"a":1.0,"b":' + "7" * 40 + ',"c":0.' + "123456789" * 3 + ',"d":"1.0","e\\"":[1.0,"q"]}'
    assert values(spark, [numbers], annotate_json("v", remove=["x"])) == [numbers]
    nested = annotate_json("v", {"s": F.struct(F.lit(1).alias("q")), "l": F.array(F.lit("x"))})
    assert json.loads(values(spark, ["{}"], nested)[0]) == {"s": {"q": 1}, "l": ["x"]}


def test_values_of_all_kinds_stay_as_they_are(spark, monkeypatch):
    """Documents parsed once give what those parsed twice give, which is what stands there."""
    import json
    import random

    from lakejobs.functions import documents

    rng = random.Random(4)

    def value(depth=0):
        kind = rng.randrange(10 if depth < 3 else 6)
        if kind < 6:
            return rng.choice([0, -7, 10**17, 12345678901234567890123, 1.5, -0.25, True, False, None, "", "a\"b", "x.5 {y,z}", "é漢\n", '"{\\"k\\":1,2}"'])
        if kind < 8:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice("zyxab") + str(i): value(depth + 1) for i in range(rng.randrange(3))}

    docs = [json.dumps({f"k{i}": value() for i in range(rng.randrange(4))}, separators=(",", ":"), ensure_ascii=False) for _ in range(300)]
    docs += ['{"a":-0}', '{"a":1e2}', '{"a":[{"b":1}],"c":{"z":1,"a":2}}', '{"a":{"z":{"y":1}}}', "[1]", "x", "", None]
    once = values(spark, docs, annotate_json("v", {"put": F.lit(1)}, ["k1"]))
    monkeypatch.setattr(documents, "_NOT_PLAIN", "")
    assert once == values(spark, docs, annotate_json("v", {"put": F.lit(1)}, ["k1"]))
    plain = values(spark, docs[:300], annotate_json("v"))
    assert plain == docs[:300]


@pytest.mark.parametrize(
    ("doc", "status"),
    [
        ("{}", 200), ("", 200), (None, 200), ('{"a":1}', 200), ('{"error":"x"}', 500), ('{"error":null}', 500),
        ('{"error":"x","errorCode":404}', 404), ('{"error":"x","errorCode":"404"}', 404),
        ('{"errorCode":409}', 409), ('{"errorCode":"soon"}', 200), ('{"error":1,"errorCode":"soon"}', 500),
        ('{"errorCode":404.7}', 404), ('{"errorCode":null}', 200), ("[]", 500), ("nonsense", 500),
    ],
)
def test_response_status(spark, doc, status):
    assert values(spark, [doc], response_status("v")) == [status]


def test_first_entry(spark):
    docs = ['{"tables":[{"id":1},{"id":2}]}', '{"error":"x"}', '{"tables":[]}', ""]
    absent = '{"error":"Table t does not exist","errorCode":404}'
    assert values(spark, docs, first_entry("v", "tables", "t")) == ['{"id":1}', '{"error":"x"}', absent, absent]
    texts = ['{"a.b":["abc"]}', '{"a.b":[""]}', '{"a.b":[2.0,1]}', '{"a.b":"[1]"}', '{"a.b":[null]}']
    assert values(spark, texts, first_entry("v", "a.b", "t")) == ['"abc"', '""', "2.0", absent, absent]


def test_user_functions_by_batch(spark, tmp_path):
    path = tmp_path / "batches.py"
    path.write_text(
        'import pandas as pd\nimport pyarrow as pa\nimport pyarrow.compute as pc\n\n'
        '@outputSchema("n:bigint")\ndef double(v: pd.Series) -> pd.Series:\n    return v * 2\n\n'
        '@outputSchema("n:bigint")\ndef third(v: pa.Array) -> pa.Array:\n    return pc.multiply(v, 3)\n'
    )
    register_udfs(spark, str(path), "b")
    rows = spark.range(4).selectExpr("id", "b_double(id) AS d", "b_third(id) AS t").collect()
    assert all((r.d, r.t) == (2 * r.id, 3 * r.id) for r in rows)


def test_user_functions(spark, tmp_path):
    path = tmp_path / "udfs.py"
    path.write_text(
        '@outputSchema("word:chararray")\ndef helloworld():\n    return "Hello, World"\n\n'
        '@outputSchema("n:int")\ndef add(a, b):\n    return a + b\n\ndef plain():\n    return 1\n'
    )
    assert set(register_udfs(spark, str(path), "u")) == {"u_helloworld", "u_add"}
    rows = spark.range(3).selectExpr("u_helloworld() AS w", "u_add(id, 2) AS n").collect()
    assert [(r.w, r.n) for r in rows] == [("Hello, World", i + 2) for i in range(3)]
    register_udfs(spark, f"file:{path}", "far")
    assert spark.sql("SELECT far_add(1, 2) AS n").first().n == 3
    with pytest.raises(NotFound):
        register_udfs(spark, str(tmp_path / "none.py"), "u")
    with pytest.raises(BadParam):
        outputSchema("")
