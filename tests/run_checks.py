"""Run all (or the named) checks once and print time and outcome: python tests/run_checks.py [name...]

CHECK_SF_DIR names the tables, CHECK_CONF further settings such as
``spark.sql.session.timeZone=America/New_York spark.sql.ansi.enabled=false``.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import difference, oracle_connection  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from lakejobs.session import build_session  # noqa: E402


def main(wanted):
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    extra = dict(pair.split("=") for pair in os.environ.get("CHECK_CONF", "").split())
    spark = build_session(
        "checks", "local[8]", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__sql__shuffle__partitions=8, spark__ui__showConsoleProgress="false", **extra,
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = oracle_connection(sf_dir), []
    for name, query in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql:
                problem = difference(spark, sf_dir, query, sql, connection)
            else:
                problem = None if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - reported below
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not problem else 'FAIL ' + problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
