"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes edges fuzzy_mapping_report chunks ref_entities extractors subjects doc_labels mix_targets".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    """'' if they agree, else how they differ."""
    got_cols, got = df.columns, df.collect()
    rel = con.execute(sql)
    want_cols, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} and {sorted(want_cols)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    if a == b:
        return ""
    x, y = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only here {sorted(x - y, key=repr)[:2]}, only there {sorted(y - x, key=repr)[:2]}"[:900]
