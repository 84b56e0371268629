"""Run every query beside its SQL and compare rows: python -m checks.compare [folder] [name ...]"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

from checks.oracle import ORACLE
from pagemill import build_session
from pagemill.plans.queries import QUERIES


def canonical(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, db, folder: str, name: str) -> str:
    start = time.time()
    frame = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if name not in ORACLE:
        return f"ROWS  {name}: {len(rows)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    kinds = [str(d[1]).lower() for d in result.description]
    expected = result.fetchall()
    sql_spent = time.time() - start
    if sorted(columns) != sorted(frame.columns):
        return f"FAIL  {name}: columns {sorted(frame.columns)} against {sorted(columns)}"
    got, want = bag(frame.columns, rows), bag(columns, expected)
    types = dict(zip(columns, kinds))
    mixed = [(c, t, types[c]) for c, t in frame.dtypes if t != {"varchar": "string", "integer": "int"}.get(types[c], types[c])]
    note = f" types {mixed}" if mixed else ""
    if got != want:
        return (
            f"FAIL  {name}: {len(rows)} rows against {len(expected)};{note}"
            f"\n   only here {list((got - want).items())[:2]}\n   only SQL  {list((want - got).items())[:2]}"
        )
    return f"OK    {name}: {len(rows)} rows, {spent:.1f}s, SQL {sql_spent:.1f}s{note}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    spark = build_session(
        "compare", master="local[8]", shuffle_partitions=8,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in names:
        try:
            line = compare(spark, db, folder, name)
        except Exception as error:  # noqa: BLE001
            line = f"FAIL  {name}: {str(error)[:600]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
