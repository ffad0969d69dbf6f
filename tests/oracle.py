"""Runs registered queries beside their oracle SQL and compares all rows.

    python tests/oracle.py [sf folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from coterie.workload import ORACLES, QUERIES  # noqa: E402
from coterie.workload.relational import TABLES  # noqa: E402


TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """What differs, or None."""
    result = QUERIES[name](spark, sf_dir)
    ours = rows_of(result.columns, [tuple(row) for row in result.collect()])
    cursor = connection.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} / {sorted(names)}"
    types = {c[0]: str(c[1]) for c in cursor.description}
    wrong = [
        f"{f.name} {f.dataType.simpleString()}/{types[f.name]}"
        for f in result.schema.fields
        if TYPES.get(f.dataType.simpleString()) != types[f.name]
    ]
    if wrong:
        return f"types {wrong}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def main() -> None:
    from coterie.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session("coterie-oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name in chosen:
        started = time.perf_counter()
        try:
            if name in ORACLES:
                verdict = compare(spark, connection, sf_dir, name) or "ok"
            else:
                verdict = f"{QUERIES[name](spark, sf_dir).count()} rows, no oracle"
        except Exception as error:  # the other queries still run
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24} {time.perf_counter() - started:7.2f} s  {verdict}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
