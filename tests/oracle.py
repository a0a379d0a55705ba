"""Run registered queries next to their DuckDB twins and compare values.

    python tests/oracle.py [-d SF_DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import datetime
    import decimal
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.12g}"))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    n = sum(got.values())
    if sql is None:
        return f"rows-only {n}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"FAIL columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    if got != want:
        extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"FAIL rows {n} vs {sum(want.values())}; spark-only {extra}; sql-only {lost}"
    types = {c: type(next((r[i] for r in got if r[i] is not None), None)).__name__ for i, c in enumerate(cols)}
    wtypes = {c: type(next((r[i] for r in want if r[i] is not None), None)).__name__ for i, c in enumerate(cols)}
    return f"ok {n}" + ("" if types == wtypes else f" TYPES {types} {wtypes}") + (" EMPTY" if n == 0 else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    ap.add_argument("parts", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from blocklens.session import build_session
    spark = build_session("local[8]", extra={"spark.driver.memory": "12g"})
    con = duck(args.dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args.parts and not any(p in name for p in args.parts):
            continue
        t0 = time.time()
        try:
            res = compare(spark, con, fn, sqls.get(name), args.dir)
        except Exception as e:  # noqa: BLE001
            lines = [x for x in str(e).splitlines() if x.strip()]
            res = f"FAIL {type(e).__name__} " + " | ".join(lines[:3] + lines[-4:])[:1200]
        bad += res.startswith("FAIL")
        print(f"{name:36s} {time.time() - t0:6.1f}s {res}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
