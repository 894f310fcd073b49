"""Compare every registered query with its SQL: python tests/check_all.py DIR [name part ...]."""

import os
import sys
import time

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(here), here]

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck  # noqa: E402
from moveproof import build_session  # noqa: E402

root, wanted = sys.argv[1], sys.argv[2:]
spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8",
                                     "spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
con = duck(root)
queries, oracles = entry.queries(), entry.oracle_sql()
failed = 0
for name, plan in queries.items():
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        if name in oracles:
            diff = difference(spark, con, plan, oracles[name], root)
            verdict = "ok" if diff is None else f"DIFF {diff[:900]}"
        else:
            verdict = f"rows {plan(spark, root).count()}"
    except Exception as error:  # report and go on to the next query
        verdict = f"ERROR {type(error).__name__} {str(error)[:700]}"
    failed += not verdict.startswith(("ok", "rows"))
    print(f"{name:34s} {time.time() - start:6.2f}s {verdict}", flush=True)
print("failed:", failed, "of", len(queries), "| with SQL:", len(oracles))
spark.stop()
