"""python tests/run_oracle.py [folder] [name prefix ...]: compare queries with their SQL."""

import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from sluice import build_session  # noqa: E402
from sluice.queries import QUERIES  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    if os.environ.get("PLAIN"):  # a session without our settings
        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
            "spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
            "spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                              spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(folder), 0
    for name, q in QUERIES.items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        t = time.time()
        try:
            if q.sql:
                found = compare(q, spark, db, folder)
                found = "ok" if found is None else "DIFF " + found[:600]
            else:
                found = f"rows only: {q(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            found = "ERROR " + str(e)[:900]
        bad += found.startswith(("DIFF", "ERROR"))
        print(f"{name:38s} {time.time() - t:6.2f}s {found}", flush=True)
    print("bad:", bad)
