"""A Spark result held against DuckDB's on the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, ([None if x != x or x is None else x for x in r] for r in frame.astype(object).itertuples(index=False, name=None))))


def oracle(sql, sf_dir):
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        return db.sql(sql).df()
