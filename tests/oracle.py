"""Holding a query against its SQL, in DuckDB."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame) -> list[tuple]:
    def value(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 9)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def by_sql(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con.sql(sql).df()
