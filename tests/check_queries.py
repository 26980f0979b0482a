"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf] [name part ...]``."""

import os
import sys
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from comparing import DATA, difference  # noqa: E402

from logtel.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("HEAP", "4g")})
    spark.sparkContext.setLogLevel("ERROR")
    from logtel.plans.catalog import ORACLES, QUERIES

    wanted = [n for n in QUERIES if not sys.argv[2:] or any(n == p or p in n for p in sys.argv[2:])]
    failed = 0
    for name in wanted:
        try:
            wrong, rows, took = difference(spark, f"{DATA}/sf{sf}", name, QUERIES, ORACLES)
        except Exception as error:  # report and go on
            wrong, rows, took = "ERROR " + str(error)[:1500], 0, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += wrong is not None
        mark = "ok  " if wrong is None else "FAIL"
        print(f"{mark} {name:32s} rows={rows:<7d} {took:6.2f}s {'' if name in ORACLES else '(rows only)'} {wrong or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
