"""Run registered queries next to their SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


KINDS = {
    "long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, folder, name, build, sql):
    """Return None when equal, else a short description of the difference."""
    df = build(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    other = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (kinds[c], other[c]) for c in kinds if kinds[c] != other[c]}
    if diff:
        return f"types {diff}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, {sorted(df.columns)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None if got else "empty result"
