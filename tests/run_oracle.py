"""Command line: python tests/run_oracle.py SF [name-part ...]"""
import os, sys, time, traceback
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession
import oracle
from strandframe.plans.catalog import load

sf, parts = sys.argv[1], sys.argv[2:]
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
d = f"/root/testdata/sf{sf}"
con = oracle.connect(d)
queries, sqls = load()
bad = 0
for name, fn in queries.items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = fn(spark, d)
        if name in sqls:
            diff = oracle.compare(df, con, sqls[name])
            note = "ok" if diff is None else "DIFF " + diff
        else:
            rows = df.collect()
            note, diff = f"rows-only {len(rows)} e.g. {rows[:1]}"[:300], None
    except Exception as e:
        note, diff = "ERROR " + str(e).strip()[:700], True
    bad += diff is not None
    print(f"{name:45s} {time.time() - t:6.2f}s {note}", flush=True)
print("failures", bad)
