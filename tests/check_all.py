"""Compare every registered query with its oracle: python tests/check_all.py FOLDER [key ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tests.compare import connect, spark_rows, sql_rows
from velobus.session import local_session


def main(folder, keys):
    spark = local_session("8", int(os.environ.get("PARTITIONS", "8")))
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for key, build in entry.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            names, rows = spark_rows(build(spark, folder))
        except Exception as error:
            print(f"FAIL {key}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if key not in oracles:
            print(f"rows {key}: {len(rows)} rows, {took:.2f}s", flush=True)
            continue
        start = time.time()
        try:
            expected_names, expected = sql_rows(con, oracles[key])
        except Exception as error:
            print(f"FAIL {key} (sql): {str(error)[:800]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        same = names == expected_names and rows == expected
        print(
            f"{'ok  ' if same else 'DIFF'} {key}: {len(rows)}/{len(expected)} rows, "
            f"spark {took:.2f}s sql {sql_took:.2f}s",
            flush=True,
        )
        if not same:
            bad += 1
            print("  ", names, expected_names if names != expected_names else "")
            left, right = set(rows), set(expected)
            for row in sorted(left - right)[:3]:
                print("   spark", row)
            for row in sorted(right - left)[:3]:
                print("   sql  ", row)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
