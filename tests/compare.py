"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return value


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def assert_same(df, sql: str, db: duckdb.DuckDBPyConnection) -> None:
    theirs = db.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(names)
    ours, expected = rows(df.columns, df.collect()), rows(names, theirs.fetchall())
    assert len(ours) == len(expected), (len(ours), len(expected))
    wrong = [(a, b) for a, b in zip(ours, expected, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
