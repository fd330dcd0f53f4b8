"""Compare registered queries with their SQL on one set of tables."""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


def family(t: str) -> str:
    t = t.lower()
    for key, fam in (("bool", "bool"), ("int", "int"), ("long", "int"), ("double", "float"), ("float", "float"),
                     ("decimal", "decimal"), ("varchar", "string"), ("string", "string")):
        if key in t:
            return fam
    return t


def compare(df, con, sql):
    """None when equal, otherwise a short description of the difference."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: family(str(c[1])) for c in cur.description}
    expected = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    bad = {c: (mine[c], types[c]) for c in names if mine[c] != types[c]}
    got = df.collect()
    a, b = bag(df.columns, got), bag(names, expected)
    if a != b:
        return f"{len(got)} rows vs {len(expected)}; only spark {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}"[:900]
    if bad:
        return f"types {bad}"
    return None
