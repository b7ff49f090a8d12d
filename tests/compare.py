"""Run a registered query on Spark and its SQL twin on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name; rows sorted, with missing values last."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_cell(r[i]) for i in order) for r in rows]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return [columns[i] for i in order], sorted(picked, key=key)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(db, sql: str):
    result = db.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def differences(ours, theirs) -> list[str]:
    out = []
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} against {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        out.append(f"{len(ours[1])} rows against {len(theirs[1])}")
    mine, other = set(ours[1]), set(theirs[1])
    for label, rows in (("only here", mine - other), ("only in SQL", other - mine)):
        if rows:
            out.append(f"{len(rows)} {label}, such as {str(sorted(rows, key=str)[:2])[:600]}")
    kinds = [
        {type(v).__name__ for v in column if v is not None} for column in zip(*ours[1])
    ], [{type(v).__name__ for v in column if v is not None} for column in zip(*theirs[1])]
    if kinds[0] != kinds[1]:
        out.append(f"types {kinds[0]} against {kinds[1]}")
    return out


def main(sf_dir: str, names: list[str]) -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from tests.session import session

    spark = session()
    db = connect(sf_dir)
    bad = 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            ours = spark_rows(query(spark, sf_dir))
            middle = time.time()
            wrong = differences(ours, duck_rows(db, sql[name])) if name in sql else []
            end = time.time()
        except Exception as error:  # noqa: BLE001
            wrong, middle, end, ours = [f"{type(error).__name__}: {str(error)[:1500]}"], start, start, ([], [])
        bad += bool(wrong)
        print(
            f"{'BAD ' if wrong else 'ok  '}{name}: {len(ours[1])} rows, "
            f"{middle - start:.1f} s, SQL {end - middle:.1f} s",
            flush=True,
        )
        for line in wrong:
            print("      ", line, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
