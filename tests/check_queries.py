"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

from palaver.session import local_session  # noqa: E402

args = sys.argv[1:]
sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
queries, oracles = entry.queries(), entry.oracle_sql()
names = [n for n in queries if not args or queries[n].__module__.rsplit(".", 1)[-1] in args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
spark, con = local_session(), connect(sf)
bad = 0
for name in names:
    t = time.time()
    try:
        rows, diff = differences(spark, con, sf, queries[name], oracles.get(name))
    except Exception as e:  # noqa: BLE001
        rows, diff = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
    mark = "ok " if not diff else "BAD"
    bad += bool(diff)
    kind = "hash" if name in oracles else "rows"
    print(f"{mark} {name:28s} {kind} rows={rows} {time.time() - t:.2f}s", flush=True)
    for d in diff:
        print("     ", d, flush=True)
print(f"{len(names)} queries, {bad} bad")
