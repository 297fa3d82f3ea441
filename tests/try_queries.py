"""python tests/try_queries.py SF [name-prefix ...]: compare registered queries with their SQL, with timings."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare  # noqa: E402
from conftest import session  # noqa: E402

if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = session()
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                n, spark_types, duck_types = compare(spark, f"/root/testdata/{sf}", fn, sqls[name])
                same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
                kind = "sql " + str({c: (t, duck_types[c]) for c, t in spark_types.items()
                                     if same.get(t) != duck_types[c]} or "")
            else:
                n, kind = len(fn(spark, f"/root/testdata/{sf}").collect()), "rows"
            print(f"ok   {name:28s} {n:7d} {time.time() - start:6.2f}s {kind}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name:28s} {type(e).__name__} {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
