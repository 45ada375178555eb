"""Compare registered queries with their SQL twins: python -m tests.parity [folder] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{where}'")
    return con


def canon(row: dict) -> tuple:
    out = []
    for key in sorted(row):
        v = row[key]
        if isinstance(v, float):
            v = "nan" if math.isnan(v) else round(v, 5) + 0.0
        elif hasattr(v, "as_tuple"):
            v = round(float(v), 5)
        out.append((key, str(v)))
    return tuple(out)


def compare(spark, folder: str, name: str, query, sql: str, con) -> tuple[bool, str]:
    df = query(spark, folder)
    ours = sorted(canon(r.asDict()) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = sorted(canon(dict(zip(names, r, strict=True))) for r in cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return True, f"{len(ours)} rows"
    a, b = set(ours), set(theirs)
    return False, f"{len(ours)} and {len(theirs)} rows; ours only {list(a - b)[:2]}, theirs only {list(b - a)[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tamiz.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("parity"), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sorted(sql):
        began = time.time()
        try:
            ok, what = compare(spark, folder, name, queries[name], sql[name], con)
        except Exception as e:
            ok, what = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - began:.1f}s", what[:700], flush=True)
    print("failed:", bad)
