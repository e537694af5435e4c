"""Run registered queries against their SQL texts: ``python tests/check_queries.py [names or prefixes]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        # NO_BROADCAST=1 forces the shuffle joins that large tables take
        .config("spark.sql.autoBroadcastJoinThreshold", "-1" if os.environ.get("NO_BROADCAST") else "10MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    wanted = sys.argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, function in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in oracles:
                problems = differences(df, oracles[name], db)
                kind = "sql"
            else:
                n = df.toArrow().num_rows
                problems, kind = ([] if n else ["no rows"]), f"rows={n}"
        except Exception as error:  # noqa: BLE001
            problems, kind = [f"{type(error).__name__}: {str(error)[:600]}"], "error"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} {kind:10s} {time.time() - start:6.2f}s {problems or ''}", flush=True)
    print(f"{failed} failed")
