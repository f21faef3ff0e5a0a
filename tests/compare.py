"""Rows of two engines, made comparable."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_duck(con, sql):
    names = sorted(con.sql(sql).columns)
    picked = ", ".join(f'"{n}"' for n in names)
    return names, sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {picked} FROM ({sql})").fetchall())
