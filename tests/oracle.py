"""Runs a query's SQL in DuckDB and compares names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

TYPES = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}, "timestamp": {"TIMESTAMP"}, "date": {"DATE"}}


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if all agrees, else what doesn't."""
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    wrong = [(n, t, theirs[n]) for n, t in df.dtypes if theirs[n].split("(")[0] not in TYPES.get(t, {t})]
    if wrong:
        return f"types {wrong}"
    order = [list(theirs).index(n) for n in names]
    expected = _sorted([r[i] for i in order] for r in result.fetchall())
    found = _sorted(tuple(r) for r in df.select(*names).collect())
    if found != expected:
        some = [x for x in zip(found, expected, strict=False) if x[0] != x[1]][:2]
        return f"{len(found)} and {len(expected)} rows; {some}"
    return ""
