"""Command line: python tests/check_all.py [name prefix ...] compares queries with their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tidegate import catalog  # noqa: E402
from tidegate.session import build_session  # noqa: E402


def main(names):
    if os.environ.get("PLAIN"):
        # A session without any of this library's settings.
        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = build_session("check", master="local[8]", spark_sql_shuffle_partitions="8",
                              spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    for name, query in catalog.load().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in catalog.ORACLE_SQL:
                problem = compare(spark, name, query, catalog.ORACLE_SQL[name], sf)
            else:
                problem = None if query(spark, sf).count() else f"{name}: no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{name}: {type(error).__name__} {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        mark = "sql " if name in catalog.ORACLE_SQL else "rows"
        print(f"{'FAIL' if problem else 'ok'} {mark} {time.time() - start:6.2f}s {problem or name}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
