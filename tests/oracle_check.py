"""Compare query results with their SQL: names, types, rows, values regardless of order."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path


def connect(data_dir: str):
    import duckdb

    con = duckdb.connect()
    for file in sorted(Path(data_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, Decimal):
        return str(value)
    return value


def _rows(table, names):
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    ours = spark_df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} != {sorted(theirs.column_names)}"
    types = [
        (n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in names
        if str(ours.schema.field(n).type).replace("large_", "") != str(theirs.schema.field(n).type).replace("large_", "")
    ]
    a, b = _rows(ours, names), _rows(theirs, names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
            return f"row differs: {bad} in {x[:4]}"
    if types:
        return f"types {types}"
    return None
