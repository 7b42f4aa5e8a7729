"""Compare a Spark DataFrame with a DuckDB query on the same parquet tables.

Mirrors the driver's gate: row count, column names and an order-insensitive
hash of the values (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb

from rollcall.session import DRIVER_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v) -> str:
    if v is None:
        return "NULL"
    try:
        if v != v:  # NaN / NaT
            return "NULL"
    except Exception:
        pass
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isfinite(f) and f == int(f) and abs(f) < 1e15:
            return str(int(f))
        return f"{f:.6g}"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _canon(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], out


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def compare(df, con, sql):
    sc, sr = canonical_rows(*spark_rows(df))
    dc, dr = canonical_rows(*duck_rows(con, sql))
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    if len(sr) != len(dr):
        problems.append(f"row count differs: spark={len(sr)} duck={len(dr)}")
    hs = hashlib.sha256("\n".join(sr).encode()).hexdigest()
    hd = hashlib.sha256("\n".join(dr).encode()).hexdigest()
    if hs != hd:
        diff_s = sorted(set(sr) - set(dr))[:5]
        diff_d = sorted(set(dr) - set(sr))[:5]
        problems.append(f"values differ; spark-only={diff_s} duck-only={diff_d}")
    return problems, len(sr)
