"""Command line check: python tests/run_oracle.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare  # noqa: E402

from ledgerlift.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(qs)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                res = compare(spark, n, qs[n], sqls[n], f"/root/testdata/sf{sf}")
            else:
                res = f"rows only: {qs[n](spark, f'/root/testdata/sf{sf}').count()}"
        except Exception as e:
            res = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(res)
        print(f"{'ok ' if not res else 'BAD' if n in sqls else '-- '} {n} {time.time() - t:.1f}s {res or ''}", flush=True)
    print("not ok:", bad)
