"""SQL jobs."""

from __future__ import annotations

import pytest

from lakejobs.errors import BadParam, NotFound, StatementFailed
from lakejobs.plans.script import fill_params, run_sql, split_statements


def test_statements():
    text = "-- a; b\nSELECT ';' ; /* ; */ SELECT \"it\\\";\" , `a;b`;;\n-- end\n;"
    assert split_statements(text) == ["-- a; b\nSELECT ';'", '/* ; */ SELECT "it\\";" , `a;b`']
    assert split_statements(" ; -- nothing\n") == []


def test_params(spark):
    assert fill_params("a $X ${Y} $X1", {"X": 5, "X1": "z"}) == "a 5 ${Y} z"
    with pytest.raises(BadParam, match="NOPE"):
        fill_params("$NOPE", {})
    out = run_sql(spark, "SELECT $N AS n, '${script.v}' AS v", defines=["script.v=7"], params={"N": 3})
    assert tuple(out.first()) == (3, "7")
    assert run_sql(spark, "SELECT '$kept' AS v").first().v == "$kept"


def test_execute_wins_over_file(spark, tmp_path):
    path = tmp_path / "s.sql"
    path.write_text("\n-- two statements\nCREATE OR REPLACE TEMP VIEW script_v AS SELECT 1 AS a;\nSELECT a + 1 AS b FROM script_v\n")
    assert run_sql(spark, file=str(path)).first().b == 2
    assert run_sql(spark, "SELECT 9 AS b", str(path)).first().b == 9
    with pytest.raises(NotFound):
        run_sql(spark, file=str(tmp_path / "none.sql"))


def test_bad_requests(spark):
    for call in ({}, {"execute": ""}, {"execute": " ; -- x\n"}):
        with pytest.raises(BadParam, match="Either execute or file parameter required"):
            run_sql(spark, **call)
    with pytest.raises(BadParam, match="define"):
        run_sql(spark, "SELECT 1", defines=["novalue"])
    with pytest.raises(StatementFailed) as caught:
        run_sql(spark, "SELECT 1; SELECT nothing FROM nowhere; SELECT 2")
    assert caught.value.details["statement"] == "SELECT nothing FROM nowhere" and caught.value.code == 500


def test_check_runs_nothing(spark):
    run_sql(spark, "CREATE TABLE script_t (a INT) USING parquet; DROP TABLE script_t", check=True)
    assert not spark.catalog.tableExists("script_t")
    for bad in ("SELEC 1", "SELECT nothing FROM range(1)"):
        with pytest.raises(StatementFailed):
            run_sql(spark, f"SELECT 1; {bad}", check=True)


def test_databases_tables_properties(spark, tmp_path):
    run_sql(spark, f"CREATE DATABASE IF NOT EXISTS script_db COMMENT 'c' LOCATION '{tmp_path}/db' WITH DBPROPERTIES ('a'='b')")
    about = {r.info_name: r.info_value for r in run_sql(spark, "DESCRIBE DATABASE EXTENDED script_db").collect()}
    assert about["Comment"] == "c" and "(a,b)" in about["Properties"]
    assert "script_db" in [r[0] for r in run_sql(spark, "SHOW DATABASES LIKE 'script*'").collect()]
    run_sql(
        spark,
        """CREATE TABLE script_db.one (a INT) USING parquet TBLPROPERTIES ('prop1'='val1');
           ALTER TABLE script_db.one RENAME TO script_db.two;
           ALTER TABLE script_db.two SET TBLPROPERTIES ('prop3'='val3');
           ALTER TABLE script_db.two SET TBLPROPERTIES ('prop3'='newval3');""",
    )
    props = {r.key: r.value for r in run_sql(spark, "SHOW TBLPROPERTIES script_db.two").collect()}
    assert (props["prop1"], props["prop3"]) == ("val1", "newval3")
    assert [r.tableName for r in run_sql(spark, "SHOW TABLES IN script_db LIKE 't*'").collect()] == ["two"]
    with pytest.raises(StatementFailed, match="SCHEMA_NOT_EMPTY"):
        run_sql(spark, "DROP DATABASE script_db RESTRICT")
    run_sql(spark, "DROP DATABASE script_db CASCADE; DROP DATABASE IF EXISTS script_db")
