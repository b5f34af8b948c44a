"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else round(v, 5) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    names = df.columns
    ours = rows_of(names, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs = rows_of(theirs_names, result.fetchall())
    if sorted(names) != sorted(theirs_names):
        return [f"columns {sorted(names)} and {sorted(theirs_names)}"]
    out = [f"{len(ours)} and {len(theirs)} rows"] if len(ours) != len(theirs) else []
    left, right = Counter(ours), Counter(theirs)
    return out + [f"only ours {x}" for x in sorted((left - right), key=repr)[:3]] + [f"only theirs {x}" for x in sorted((right - left), key=repr)[:3]]
