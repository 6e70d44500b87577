"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def views(con, sf: str) -> None:
    for t in TABLES:
        con.execute(f"create or replace view {t} as select * from '{sf}/{t}.parquet'")


def differences(df, rows, cur) -> list[str]:
    want = cur.fetchall()
    cols = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(cols)}"]
    dt, msg = dict(df.dtypes), []
    for c, k in zip(cols, kinds):
        if KIND.get(dt[c], dt[c]) != k:
            msg.append(f"type {c}: {dt[c]} vs {k}")
    order = sorted(cols)
    ix = [cols.index(c) for c in order]
    a = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in ix) for r in want)
    if a != b:
        sa, sb = set(a), set(b)
        d1 = [x for x in a if x not in sb][:2]
        d2 = [x for x in b if x not in sa][:2]
        off = [c for k, c in enumerate(order) if d1 and d2 and d1[0][k] != d2[0][k]]
        msg.append(f"{len(a)} vs {len(b)} rows, first differing columns {off}\n   spark {d1}\n   duck  {d2}")
    return msg
