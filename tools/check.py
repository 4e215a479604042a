"""Compare every query with its SQL on one scale folder.

    python tools/check.py [folder] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("maskwright-check")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(r[i] for i in order)) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


KIND = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "FLOAT": "float", "TIMESTAMP": "timestamp_ntz"}


def compare(df, con, sql: str) -> str:
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    problems = []
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in columns:
        if KIND.get(types[c], types[c]) != mine[c]:
            problems.append(f"type {c}: {mine[c]} != {types[c]}")
    a, la = digest(df.columns, got)
    b, lb = digest(columns, want)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if a != b:
        sa, sb = set(la), set(lb)
        problems.append(f"values differ, spark only {sorted(sa - sb)[:2]} sql only {sorted(sb - sa)[:2]}")
    return "; ".join(problems) or f"ok ({len(got)} rows)"


def main() -> int:
    from maskwright.plans import all_queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries.QUERIES)
    spark, con, bad = session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = all_queries.QUERIES[name](spark, folder)
            if name in all_queries.ORACLES:
                result = compare(df, con, all_queries.ORACLES[name])
            else:
                result = f"ok, no SQL ({df.count()} rows)"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            result = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        bad += not result.startswith("ok")
        print(f"{name:28s} {time.time() - start:6.1f}s {result}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
