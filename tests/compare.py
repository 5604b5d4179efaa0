"""Row-for-row comparison of two results, whatever their row and column order."""

from __future__ import annotations

import datetime
import decimal
import math

import numpy as np


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(table: list[dict]) -> list[tuple]:
    """Sorted rows with the columns in the order of their names."""
    return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in table), key=repr)


def spark_rows(df) -> list[tuple]:
    return rows_of([r.asDict() for r in df.collect()])


def duck_rows(con, sql: str) -> list[tuple]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows_of([dict(zip(names, r, strict=True)) for r in got.fetchall()])
