"""Compare a Spark DataFrame with a DuckDB query over the same parquet tables.

Rows are compared as multisets after normalising values (floats to 9
significant digits, timestamps to ISO text, arrays to tuples); column names
are compared as sets, like the driver's check.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating, float, decimal.Decimal)):
        f = float(v)
        if f == 0:
            return 0.0
        if os.environ.get("ORACLE_STRICT"):
            return f
        return float(f"{f:.9g}")
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (_dt.datetime, np.datetime64)):
        if isinstance(v, np.datetime64):
            v = v.astype("datetime64[us]").astype(_dt.datetime)
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=repr)
    return out


def _family(t: str) -> str:
    t = t.lower()
    for fam, keys in (("list", ("array", "[]", "list")), ("struct", ("struct",)), ("map", ("map",)),
                      ("timestamp", ("timestamp",)), ("bool", ("bool",)), ("string", ("string", "varchar", "json")),
                      ("int", ("bigint", "int", "long", "short", "tinyint", "smallint", "hugeint")),
                      ("float", ("double", "float", "real", "decimal"))):
        if any(k in t for k in keys):
            return fam
    return t


def type_mismatches(spark_df, sql: str, con) -> list:
    d = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE ({sql})").fetchall()}
    out = []
    for f in spark_df.schema.fields:
        a, b = _family(f.dataType.simpleString()), _family(d.get(f.name, "?"))
        if a != b:
            out.append((f.name, f.dataType.simpleString(), d.get(f.name)))
    return out


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                names = sorted(s_cols)
                diff = [(names[i], x[i], y[i]) for i in range(len(x)) if x[i] != y[i]]
                return False, f"values differ ({len(s_rows)} rows), first: {diff[:4]}"
    tm = type_mismatches(spark_df, sql, con)
    if tm:
        return True, f"{len(s_rows)} rows, TYPE FAMILY DIFF {tm}"
    return True, f"{len(s_rows)} rows"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from fleetlens.session import build_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = build_session()
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                ok, msg = compare(df, sqls[name], con)
            else:
                ok, msg = True, f"no oracle, {df.count()} rows"
        except Exception as ex:  # report and continue
            ok, msg = False, f"ERROR {type(ex).__name__}: {str(ex)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print(f"{len(qs) - bad}/{len(qs)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
