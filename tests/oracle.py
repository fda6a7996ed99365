"""Holds queries against their SQL twins, as sorted rows with columns by name."""

from __future__ import annotations

import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def both(spark, con, query, sql: str, sf_dir: str) -> tuple[list, list, list, list]:
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    return sorted(df.columns), sorted(rel.columns), rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
