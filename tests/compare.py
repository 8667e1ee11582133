"""Run queries and their DuckDB counterparts on the same tables and compare.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
         "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(value(r[i])) for i in order) for r in rows)


def check(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s, t = time.time() - t, time.time()
    if sql is None:
        return f"rows only: {len(got)} ({spark_s:.1f}s)" if got else "NO ROWS"
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [x[0] for x in cur.description]
    types = {x[0]: str(x[1]) for x in cur.description}
    duck_s = time.time() - t
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [(n, s, types[n]) for n, s in df.dtypes if TYPES.get(s, s) != types[n]]
    if wrong:
        return f"types {wrong}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; duck only {only_b}"
    print(f"  ok {name}: {len(a)} rows, spark {spark_s:.1f}s duck {duck_s:.1f}s", flush=True)
    return None if got else "EMPTY on both sides"


def main() -> None:
    import __spark_entry__ as entry
    from veilspan.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert not set(sqls) - set(queries), set(sqls) - set(queries)
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in args or queries:
        try:
            out = check(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            out = f"{type(e).__name__}: {str(e)[:1500]}"
        if out:
            bad += not out.startswith("rows only")
            print(f"!! {name}: {out[:2500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
