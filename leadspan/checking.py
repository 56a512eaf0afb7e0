"""Compare a registered query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import decimal
import time

import duckdb

from leadspan.catalog.views import BASE_TABLES


LAST: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    start = time.time()
    a_cols, a = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    LAST["spark"] = time.time() - start
    cur = con.execute(sql)
    b_cols, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return [f"columns {a_cols} != {b_cols}"]
    types = {type(v) for r in a for v in r} - {type(None)}
    problems = []
    if not types <= {bool, int, float, str}:
        problems.append(f"non-scalar output types {types}")
    if len(a) != len(b):
        problems.append(f"row count {len(a)} != {len(b)}")
    for x, y in zip(a, b):
        if not all(_same(p, q) for p, q in zip(x, y)):
            problems.append(f"first difference: {dict(zip(a_cols, x))} != {dict(zip(a_cols, y))}")
            break
    if not a:
        problems.append("no rows")
    return problems


def _same(p, q) -> bool:
    if isinstance(p, (int, float)) and isinstance(q, (int, float)) and not isinstance(p, bool):
        return abs(p - q) <= 1e-5
    return p == q
