"""Spark result against DuckDB result: same columns, same rows in any order, same values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(row[i] for i in order) for row in rows]
    for row in out:
        assert not any(isinstance(v, float) and math.isnan(v) for v in row), "NaN in a result"
    return sorted(out, key=lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row))


# Spark type -> DuckDB types that hold the same values
_TYPES = {
    "string": {"VARCHAR"},
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
}


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    relation = con.sql(sql)
    names, types = list(relation.columns), [str(t) for t in relation.types]
    found = []
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} != {sorted(names)}"]
    theirs = dict(zip(names, types))
    for column, kind in result.dtypes:
        if theirs[column] not in _TYPES.get(kind, set()):
            found.append(f"type of {column}: {kind} vs {theirs[column]}")
    ours = _plain([tuple(r) for r in result.collect()], result.columns)
    expected = _plain(relation.fetchall(), names)
    if len(ours) != len(expected):
        found.append(f"rows {len(ours)} != {len(expected)}")
    wrong = [(a, b) for a, b in zip(ours, expected) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return found
