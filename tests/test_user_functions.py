"""Nested output schemas, table functions and aggregates from user files, and the most frequent values."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.errors import BadParam
from lakejobs.functions import aggregates
from lakejobs.functions.aggregates import UserAggregate, aggregate
from lakejobs.functions.output_schema import output_fields, output_type
from lakejobs.functions.udfs import register_udfs, user_aggregates
from lakejobs.operators import heavy
from lakejobs.operators.heavy import FrequentItems, top_values, top_words


@pytest.mark.parametrize(
    ("schema", "ddl"),
    [
        ("word:chararray", "string"), ("long", "bigint"), ("d: decimal(10,2)", "decimal(10,2)"), ("a:array<int>", "array<int>"),
        ("t:(a:int, b:chararray)", "struct<a:int,b:string>"), ("t:tuple(a:int)", "struct<a:int>"), ("a:int, b:datetime", "struct<a:int,b:timestamp>"),
        ("b:{t:(a:int,b:long)}", "array<struct<a:int,b:bigint>>"), ("b:bag{(a:int)}", "array<struct<a:int>>"), ("{a:int}", "array<struct<a:int>>"), ("b:{a:int, c:double}", "array<struct<a:int,c:double>>"),
        ("m:[]", "map<string,string>"), ("m:map[double]", "map<string,double>"), ("m:[{t:(x:biginteger)}]", "map<string,array<struct<x:decimal(38,0)>>>"),
        ("t:(a:int, u:(b:{v:(c:bytearray)}, bool:boolean))", "struct<a:int,u:struct<b:array<struct<c:binary>>,bool:boolean>>"), ("(int, chararray)", "struct<val_0:int,val_1:string>"),
    ],
)
def test_output_schemas(spark, schema, ddl):
    assert output_type(schema).simpleString() == ddl


@pytest.mark.parametrize("schema", ["", "a:", "t:(a:int", "t:a:int)", "{(a:int}", "a:nosuchtype", "(a:int,)", "b:{]"])
def test_bad_output_schemas(spark, schema):
    with pytest.raises(BadParam):
        output_type(schema)


def test_fields_keep_their_names(spark):
    assert [f.name for f in output_fields("a:int, (b:long), c:{(d:int)}")] == ["a", "val_1", "c"]


SOURCE = '''
@outputSchema("r:{p:(n:int, t:(a:chararray, b:[long]), l:{(x:double)})}")
def nested(n):
    return None if n is None else [(i, (str(i), {"k": i}), [(i / 2,), (None,)]) for i in range(n)]

@outputSchema("a:int, b:chararray")
def pair(n):
    return (n, "x" * n)

@outputSchema("letters:{(c:chararray, n:int)}")
class Letters:
    def eval(self, text):
        for i, c in enumerate(text or ""):
            yield (c, i)

@outputSchema("k:chararray, n:long")
class Sums:
    def __init__(self):
        self.k, self.n = None, 0
    def eval(self, row):
        self.k, self.n = row["k"], self.n + row["v"]
    def terminate(self):
        yield (self.k, self.n)

@outputSchema("longest:(n:int, word:chararray)")
class Longest:
    state_schema = "words:{(n:int, word:chararray)}"
    def initial(self, rows):
        return self._best([(len(w), w) for w, _ in rows if w is not None])
    def _best(self, words):
        return sorted(set(words), key=lambda x: (-x[0], x[1]))[:2]
    def intermediate(self, states):
        return self._best([w for s in states for w in s])
    def final(self, states):
        best = self.intermediate(states)
        return best[0] if best else None

def unmarked(n):
    return n
'''


@pytest.fixture
def user_file(tmp_path):
    path = tmp_path / "user.py"
    path.write_text(SOURCE)
    return str(path)


def test_nested_results_come_back_as_they_were(spark, user_file):
    assert set(register_udfs(spark, user_file, "n1")) == {"n1_nested", "n1_pair", "n1_Letters", "n1_Sums"}
    rows = spark.createDataFrame([(0,), (2,), (None,)], "n int").selectExpr("n", "n1_nested(n) AS r").collect()
    got = {r.n: r.r for r in rows}
    assert got[None] is None and got[0] == []
    assert [(p.n, p.t.a, p.t.b, [x.x for x in p.l]) for p in got[2]] == [(0, "0", {"k": 0}, [0.0, None]), (1, "1", {"k": 1}, [0.5, None])]
    assert spark.sql("SELECT n1_pair(3) AS p").first().p == (3, "xxx")


def test_table_functions(spark, user_file):
    register_udfs(spark, user_file, "n2")
    assert [tuple(r) for r in spark.sql("SELECT * FROM n2_Letters('aba') ORDER BY n").collect()] == [("a", 0), ("b", 1), ("a", 2)]
    joined = spark.sql("SELECT id, c FROM VALUES (1, 'xy'), (2, ''), (3, NULL) AS t(id, s), LATERAL n2_Letters(s)").collect()
    assert Counter(map(tuple, joined)) == Counter([(1, "x"), (1, "y")])
    rows = spark.createDataFrame([(k, v) for v, k in enumerate("aabbbac")], "k string, v int")
    got = spark.sql("SELECT * FROM n2_Sums(TABLE({rows}) PARTITION BY k ORDER BY v)", rows=rows).collect()
    assert Counter(map(tuple, got)) == Counter([("a", 6), ("b", 9), ("c", 6)])


@pytest.mark.parametrize("at_once", [50_000, 3])
def test_aggregates(spark, user_file, monkeypatch, at_once):
    monkeypatch.setattr(aggregates, "KEYS_AT_ONCE", at_once)
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(3), rng.choice([None, "x" * rng.randrange(9), f"w{i}"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, j int, w string, n int").repartition(7)
    user = user_aggregates(spark, user_file)
    assert set(user) == {"Longest"}
    for by in (["k", "j"], ["k"], []):
        groups = defaultdict(list)
        for k, j, w, _ in rows:
            groups[tuple({"k": k, "j": j}[b] for b in by)].append(w)
        expected = {g: min(((-len(w), w) for w in ws if w is not None), default=None) for g, ws in groups.items()}
        got = {tuple(r)[:-1]: r.best for r in aggregate(df, by, user["Longest"], ["w", "n"], "best").collect()}
        assert {g: None if b is None else (-b.n, b.word) for g, b in got.items()} == expected
    assert aggregate(df.limit(0), ["k"], user["Longest"], ["w", "n"], "best").count() == 0
    with pytest.raises(BadParam):
        aggregate(df, ["k"], user["Longest"], ["w", "n"], "k")
    with pytest.raises(BadParam, match="no final"):
        UserAggregate("x", type("X", (), {"initial": print, "intermediate": print}))


def test_a_hot_key_meets_in_small_groups(spark, user_file, monkeypatch):
    """However many rows a key has, no later group holds more than one state per task."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.concat(F.lit("w"), "id").alias("w"), "id").repartition(40)
    user = user_aggregates(spark, user_file)["Longest"]
    partial_type = T.StructType([T.StructField("k0", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("state", user.state_type)])
    rows = df.select(F.col("k").alias("k0"), F.struct(F.col("w").alias("c0"), F.col("id").alias("c1")).alias("row"))
    sizes = rows.mapInArrow(aggregates._first_step(user, ["k0"], partial_type), partial_type).groupBy("k0", "salt").count().collect()
    assert sum(r["count"] for r in sizes) == 40 and len(sizes) == aggregates.SALTS and max(r["count"] for r in sizes) == 3
    assert aggregate(df, ["k"], user, ["w", "id"], "best").first().best == (6, "w10000")


# --- most frequent values -------------------------------------------------------------------------


def test_summaries_are_within_their_error():
    rng = random.Random(2)
    for counters in (1, 5, 40):
        items, truly = FrequentItems(counters), Counter()
        for _ in range(30):
            batch = Counter(min(int(rng.paretovariate(0.7)), 200) for _ in range(100))
            truly += batch
            items.add(list(batch), list(batch.values()))
        assert len(items.held) <= counters and items.error <= truly.total() / (counters + 1)
        for value, n in truly.items():
            assert items.held.get(value, 0) <= n <= items.held.get(value, 0) + items.error


@pytest.mark.parametrize("counters", [20_000, 30, 1])
def test_top_words(spark, counters, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.8)), 500)}" for _ in range(rng.randrange(80))) for _ in range(200)] + [None, "", "  \t\n"]
    counts = Counter(w for t in texts for w in (t or "").split())
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 10, len(counts) + 5):
        assert [tuple(r) for r in top_words(df, "text", k, counters).collect()] == expected[:k]
    monkeypatch.setattr(heavy, "MOST_COUNTERS", 0)  # all are counted
    assert [tuple(r) for r in top_words(df, "text", 7, counters).collect()] == expected[:7]
    assert top_words(df.limit(0), "text", 5).count() == 0


def test_top_values_of_a_column(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert [tuple(r) for r in top_values(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
