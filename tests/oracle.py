"""Compare registered queries with their SQL twins; also usable from the command line."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date,)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        if hasattr(v, "asDict"):
            return _norm(v.asDict())
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    want_cols = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    got_cols = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    want = sorted(want_cols)
    if [c[0] for c in got_cols] != [c[0] for c in want]:
        return f"columns {[c[0] for c in got_cols]} != {[c[0] for c in want]}"
    for (n, a), (_, b) in zip(got_cols, want, strict=True):
        if a in _KIND and _KIND[a] != b:
            return f"type of {n}: spark {a} duckdb {b}"
    names = [c[0] for c in got_cols]
    idx = [[c[0] for c in want_cols].index(n) for n in names]
    b = [tuple(_norm(r[i]) for i in idx) for r in con.execute(sql).fetchall()]
    a = [tuple(_norm(r[n]) for n in names) for r in df.collect()]
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ka, kb = sorted(a, key=repr), sorted(b, key=repr)
    bad = [(x, y) for x, y in zip(ka, kb, strict=True) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, e.g. {names}\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    if not a:
        return "EMPTY"
    return None


def main() -> int:
    from skyledger.session import local_session
    import __spark_entry__ as e

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    pats = sys.argv[1:]
    spark = local_session(8)
    con = connect(sf)
    oracle = e.oracle_sql()
    fails = 0
    for name, fn in e.queries().items():
        if pats and not any(name.startswith(p) for p in pats):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                msg = compare(df, con, oracle[name])
            else:
                n = df.count()
                msg = None if n else "EMPTY"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - t
        tag = "ok  " if msg is None else "FAIL"
        fails += msg is not None
        print(f"{tag} {name} {took:.1f}s{'' if name in oracle else ' (no twin)'} {msg or ''}", flush=True)
    print("failures:", fails)
    return fails


if __name__ == "__main__":
    sys.exit(main())
