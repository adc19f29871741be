"""Run queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def spark_result(df) -> tuple[list[str], list[str]]:
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def duck_result(connection, sql: str) -> tuple[list[str], list[str]]:
    cursor = connection.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from tests.conftest import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, connection = make_session(), duck(folder)
    for name in names:
        began = time.time()
        try:
            ours = spark_result(entry.queries()[name](spark, folder))
            theirs = duck_result(connection, entry.oracle_sql()[name])
            verdict = "ok" if ours == theirs else "DIFFERS"
            print(f"{verdict:8}{name:24}{len(ours[1]):8}{len(theirs[1]):8}{time.time() - began:8.2f}s", flush=True)
            if ours != theirs:
                print("   spark ", ours[0], [r for r in ours[1] if r not in set(theirs[1])][:3])
                print("   duckdb", theirs[0], [r for r in theirs[1] if r not in set(ours[1])][:3])
        except Exception as problem:  # report and go on
            print(f"ERROR   {name}: {str(problem)[:600]}", flush=True)
