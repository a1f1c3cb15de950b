"""Run registered queries and their SQL checks side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else round(number, 6)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_result(df):
    return sorted(df.columns), canonical(df.columns, df.collect())


def duck_result(db, sql):
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), canonical(names, cursor.fetchall())


def difference(spark, db, sf, run, sql) -> str | None:
    names, rows = spark_result(run(spark, sf))
    want_names, want = duck_result(db, sql)
    if names != want_names:
        return f"columns {names} expected {want_names}"
    if rows != want:
        wrong = [(a, b) for a, b in zip(rows, want) if a != b][:2]
        return f"{len(rows)} rows, expected {len(want)}; first differences {wrong}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tierglass.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    checks = oracle_sql()
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name in checks:
                problem = difference(spark, db, sf, run, checks[name])
            else:
                problem = f"rows only: {run(spark, sf).count()}"
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:700]}"
        print(f"RES {'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}"[:1500])
