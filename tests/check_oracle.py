"""Run registered queries against their oracle SQL: python tests/check_oracle.py [sf] [name part ...]"""

from __future__ import annotations

import math
import sys
import threading
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LIMIT_S = 100
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{round(value, 6) + 0.0:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in order) for row in rel.fetchall())
    types = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    off = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if types.get(t, t) != kinds[c]]
    note = f" types {off}" if off else ""
    if got == want:
        return True, f"{len(got)} rows{note}"
    a, b = set(got), set(want)
    return False, f"{len(got)} vs {len(want)} rows; ours {sorted(a - b)[:2]} theirs {sorted(b - a)[:2]}{note}"[:1500]


def _cause(text: str) -> str:
    at = text.rfind("Caused by")
    return text[:300] + " ... " + (text[at : at + 500] if at > 0 else "")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    from lectern.session import build_session

    spark = build_session("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    bad = 0
    for name, fn in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        guard = threading.Timer(LIMIT_S, spark.sparkContext.cancelAllJobs)
        guard.start()
        try:
            df = fn(spark, folder)
            if name in oracle:
                ok, note = compare(df, con, oracle[name])
            else:
                ok, note = True, f"{df.count()} rows, no oracle"
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {_cause(str(exc))}"
        guard.cancel()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
