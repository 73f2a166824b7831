"""Compare registered Spark plans with their oracle SQL in DuckDB.

Usage: python tests/oracle.py [--sf 0.01] [--module scans] [names...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return "dec" + str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    for needle, name in (("bigint", "long"), ("integer", "int"), ("hugeint", "HUGE"), ("double", "double"),
                         ("varchar", "string"), ("timestamp", "ts"), ("date", "date"), ("bool", "bool"),
                         ("decimal", "DECIMAL"), ("smallint", "short"), ("tinyint", "byte"), ("float", "float")):
        if needle in t and "[" not in t and "struct" not in t and "map" not in t:
            return name
    return "nested" if any(x in t for x in ("[", "struct", "map", "array")) else t


def compare(spark, con, q, sf_dir, show=3):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t0
    names, got = rows_of(df.columns, rows)
    if q.sql is None:
        return "ROWS" if rows else "EMPTY", len(rows), spark_s, 0.0, ""
    t0 = time.time()
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    exp_rows = cur.fetchall()
    duck_s = time.time() - t0
    exp_names, exp = rows_of(cols, exp_rows)
    if names != exp_names:
        return "COLUMNS", len(rows), spark_s, duck_s, f"{names} != {exp_names}"
    spark_kinds = {f.name: {"bigint": "long", "timestamp_ntz": "ts", "timestamp": "ts", "boolean": "bool"}.get(
        f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    bad = {c: (spark_kinds[c], types[c]) for c in names
           if spark_kinds[c] != types[c] and types[c] != "nested"}
    if bad:
        return "TYPES", len(rows), spark_s, duck_s, str(bad)
    if got != exp:
        a, b = set(got), set(exp)
        detail = f"spark {len(got)} oracle {len(exp)} rows; columns {names} only spark {sorted(a - b)[:show]} only oracle {sorted(b - a)[:show]}"
        return "VALUES", len(rows), spark_s, duck_s, detail
    return ("OK" if rows else "EMPTY"), len(rows), spark_s, duck_s, ""


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from riskweave import registry

    if a.module:
        registry.PLAN_MODULES = tuple(a.module.split(","))
        queries = registry.load_all()
    else:
        import __spark_entry__ as entry

        sql = entry.oracle_sql()
        queries = {name: registry.Query(name, run, sql.get(name)) for name, run in entry.queries().items()}
    from riskweave.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = connect(sf_dir)
    failed = 0
    for name, q in queries.items():
        if a.names and name not in a.names:
            continue
        try:
            status, n, s1, s2, detail = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            msg = str(e)
            status, n, s1, s2, detail = "ERROR", 0, 0, 0, (msg[:700] if len(a.names) < 3 else msg[:400])
            if a.names and os.environ.get("TB"):
                traceback.print_exc()
        failed += status not in ("OK", "ROWS")
        print(f"{status:8s}{name:34s} rows={n:<8d} spark={s1:5.1f}s duck={s2:5.1f}s {detail}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
