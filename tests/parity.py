"""Compare registered queries with their SQL: ``python -m tests.parity [key prefix ...]``."""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time

import duckdb

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
          "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if v is not None and v.__class__.__name__.startswith(("int", "float")) and hasattr(v, "item"):
        return v.item()
    return v


def compare(spark, con, key, queries, oracles, sf_dir: str = SF_DIR) -> str:
    """Empty text when rows, names and types agree, else what differs."""
    df = queries[key](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if key not in oracles:
        return "" if got else "no rows"
    cur = con.execute(oracles[key])
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    spark_types = dict(df.dtypes)
    wrong = [f"{n}: {spark_types[n]} vs {types[n]}" for n in names
             if _TYPES.get(types[n], types[n].lower()) != spark_types[n]]
    order = [cols.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{names}\n   spark {g!r:.700}\n   sql   {w!r:.700}"
    if wrong:
        return "types " + ", ".join(wrong)
    return "" if got else "no rows"


def main(prefixes: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from textlake.session import local_session
    spark, con = local_session(), connect()
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for key in qs:
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, key, qs, os_)
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(diff)
        note = "" if key in os_ else " (rows only)"
        print(f"{'FAIL' if diff else 'ok  '} {key}{note} {time.time() - start:.1f}s {diff}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
