"""Command line: compare registered queries with their oracles.

python tests/check_queries.py SF_DIR [prefix ...]
"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from harness import compare_rows, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corrobora.session import build_session  # noqa: E402


def main():
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                rows = [tuple(r) for r in df.collect()]
                note = f" spark {time.time() - t:.1f}s"
                problem = compare_rows(df.columns, rows, con, oracles[name])
            else:
                n = df.count()
                problem, note = (None if n else "EMPTY"), f" rows-only n={n}"
        except Exception as e:  # noqa: BLE001
            problem, note = f"ERROR {type(e).__name__}: {str(e)[:700]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - t:.1f}s{note} {problem or ''}", flush=True)
    print("bad:", bad)


main()
