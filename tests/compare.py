"""Run a query and its SQL side by side and say where they differ."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


FAMILY = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32", "bigint": "int64",
    "double": "double", "float": "float", "string": "string", "varchar": "string", "boolean": "bool",
    "timestamp_ntz": "timestamp", "timestamp": "timestamp", "date": "date",
}


def compare(con, df, sql: str) -> list[str]:
    """Differences in columns, types and values, ignoring row and column order."""
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want_types = {d[0]: FAMILY.get(str(d[1]).lower(), str(d[1]).lower()) for d in res.description}
    want = res.fetchall()
    got_types = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    problems = []
    if sorted(want_cols) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} sql {sorted(want_cols)}"]
    for c in want_cols:
        if want_types[c] != got_types[c]:
            problems.append(f"type of {c}: spark {got_types[c]} sql {want_types[c]}")
    order = sorted(want_cols)
    got = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    pos = [want_cols.index(c) for c in order]
    exp = sorted(tuple(_cell(r[p]) for p in pos) for r in want)
    if len(got) != len(exp):
        problems.append(f"rows: spark {len(got)} sql {len(exp)}")
    if got != exp:
        a, b = set(got), set(exp)
        problems.append(f"order {order}; only spark {list(a - b)[:3]}; only sql {list(b - a)[:3]}")
    return problems
