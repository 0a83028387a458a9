"""Rows of a Spark query and of its DuckDB SQL in one comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def same_rows(frame, connection, sql: str) -> None:
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
    assert ours == theirs
