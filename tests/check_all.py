"""Run every registered query against its SQL: python tests/check_all.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lethe.session import local_session  # noqa: E402


def main(argv):
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(cpus=os.environ.get("CPUS", "8"))
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                problems = compare(df, checks[name], sf_dir)
                status = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                status = f"rows {df.toArrow().num_rows}"
        except Exception as e:
            status = "ERROR " + str(e).split("\nJVM stack")[0][:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:40s} {time.time() - start:6.2f}s {status}", flush=True)
    print("bad:", bad)


main(sys.argv[1:])
