"""Compare registered queries with their SQL twins: check.py FOLDER [name ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from docloom.plans.catalog import QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, db, query, folder):
    """(ok, message) for one query."""
    began = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if query.sql is None:
        return True, f"{len(got)} rows, no twin, {took:.1f}s"
    began = time.time()
    result = db.execute(query.sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    message = f"{len(got)} rows, {took:.1f}s (twin {time.time() - began:.1f}s)"
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, message
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return False, f"{message}, twin {len(want)} rows\n   spark only: {only_a}\n   twin only:  {only_b}"


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    bad = 0
    for name, query in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        try:
            ok, message = compare(spark, db, query, folder)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message[:2500]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
