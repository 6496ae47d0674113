"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, name, function, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = function(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    types = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t, t) != kinds[c]}
    if types:
        return f"types {types}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)} rows; first {mine[:1]} {theirs[:1]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"rows differ: {str(a)[:600]} and {str(b)[:600]}"
    return None if mine else "equal but empty"


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from inkwell.session import build_session

    directory = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session("oracle", "8")
    session.sparkContext.setLogLevel("ERROR")
    database = duck(directory)
    wanted = sys.argv[1:]
    bad = 0
    for key, run in entry.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(session, database, key, run, entry.oracle_sql().get(key), directory)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{key:26s} {time.time() - start:6.2f}s {'ok' if problem is None else 'DIFFERS ' + problem}", flush=True)
    print("failures:", bad)
