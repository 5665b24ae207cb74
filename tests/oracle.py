"""Run registered queries against DuckDB on the same tables.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from colloquy.plans import PLANS


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return repr(value)


# Spark type name -> DuckDB type name; the driver compares schemas too.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    plan = PLANS[name]
    df = plan.query(spark, sf_dir)
    got = df.collect()
    if plan.sql is None:
        return None if df.columns else "no columns"
    cursor = con.execute(plan.sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema.fields:
        spark_type = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kinds[field.name] != spark_type:
            return f"type of {field.name}: {spark_type} != {kinds[field.name]}"
    if not want:
        return "the SQL gives no rows"
    left, right = _rows(df.columns, got), _rows(want_names, want)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            pairs = zip(sorted(df.columns), a, b, strict=True)
            return "; ".join(f"{n}: {x[:300]} != {y[:300]}" for n, x, y in pairs if x != y)
    return None


def main() -> int:
    from colloquy.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(PLANS)
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"\n{mark} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"\n{len(names) - bad}/{len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
