"""Runs registered queries beside their SQL in DuckDB and compares columns and values.

    python -m tests.oracle_check [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, (str, int)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return 0.0 if v == 0 else float(f"{float(v):.12g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(cell(x) for x in v.values())
    return v


KIND = {"long": "int", "int": "int", "integer": "int", "short": "int", "double": "float", "float": "float"}


def spark_kind(t: str) -> str:
    return KIND.get(t.split("(")[0], t.split("(")[0].split("<")[0])


def duck_kind(t: str) -> str:
    t = str(t)
    if t.endswith("[]"):
        return "array"
    return {
        "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float",
        "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
    }.get(t, t.lower().split("(")[0])


def compare(spark, con, fn, sql, sf_dir):
    """None when both sides agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got_rows = df.select(*[df[f"`{c}`"] for c in cols]).collect()
    if sql is None:
        return None, len(got_rows)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: duck_kind(d[1]) for d in res.description}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got_rows)
    st = {n: spark_kind(t) for n, t in df.dtypes}
    st = {n: {"bigint": "int", "struct": "struct", "timestamp_ntz": "timestamp", "smallint": "int"}.get(t, t) for n, t in st.items()}
    bad = [(n, st[n], types[n]) for n in cols if st[n] != types[n]]
    if bad:
        return f"types {bad}", len(got_rows)
    order = [names.index(c) for c in cols]
    want = Counter(tuple(cell(r[i]) for i in order) for r in res.fetchall())
    got = Counter(tuple(cell(x) for x in r) for r in got_rows)
    if want != got:
        only_got = list((got - want).items())[:3]
        only_want = list((want - got).items())[:3]
        return f"rows {sum(got.values())} vs {sum(want.values())}; spark-only {only_got}; sql-only {only_want}; cols {cols}", len(got_rows)
    return None, len(got_rows)


def main(argv):
    import __spark_entry__ as entry
    from tripscope.session import build_session

    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    extra = set(oracle) - set(queries)
    if extra:
        print("ORACLE WITHOUT QUERY", extra)
    fails = 0
    empty = []
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            diff, n = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as e:  # reported, not hidden
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        took = time.time() - t0
        if diff:
            fails += 1
            print(f"FAIL {name} [{took:.1f}s] {diff}", flush=True)
        elif took > 5 or prefixes:
            print(f"ok   {name} rows={n} [{took:.1f}s]" + ("" if name in oracle else " (rows only)"), flush=True)
        if n == 0:
            empty.append(name)
    print("failures", fails, "of", len(queries), "empty:", empty)


if __name__ == "__main__":
    main(sys.argv[1:])
