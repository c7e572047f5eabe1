"""Compare a Spark result with its SQL check in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else float(f"{v:.10g}")
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> tuple[str | None, int]:
    """What differs (None when equal), and the number of rows."""
    relation = con.execute(sql)
    theirs = [d[0] for d in relation.description]
    if sorted(theirs) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(theirs)}", 0
    kinds = {d[0]: str(d[1]) for d in relation.description}
    expected = _rows(theirs, relation.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    n = sum(got.values())
    if got == expected:
        return None, n
    extra, missing = got - expected, expected - got
    return (
        f"{n} rows against {sum(expected.values())}; only Spark {list(extra)[:3]}; "
        f"only SQL {list(missing)[:3]}; columns {sorted(theirs)}; {kinds}",
        n,
    )
