"""Run every registered query against its SQL on the given tables: python -m tests.parity [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, (int,)):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(canon(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, canon(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((str(k), canon(v)) for k, v in value.items()))
    return str(value)


def compare(names, rows, oracle_names, oracle_rows):
    if sorted(names) != sorted(oracle_names):
        return f"columns differ: {sorted(names)} / {sorted(oracle_names)}"
    a_order, b_order = sorted(range(len(names)), key=lambda i: names[i]), sorted(range(len(names)), key=lambda i: oracle_names[i])
    a = sorted((tuple(canon(r[i]) for i in a_order) for r in rows), key=repr)
    b = sorted((tuple(canon(r[i]) for i in b_order) for r in oracle_rows), key=repr)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return f"rows {len(a)} / {len(b)}\n   spark: {only_a}\n   sql:   {only_b}"


def main(argv):
    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    from pdpspark.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"},
    )
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    plans, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = plan(spark, folder)
            rows = df.collect()
            took = time.time() - t0
            if name not in oracles:
                print(f"rows  {name:28s} {len(rows):8d} {took:6.2f}s")
                continue
            t0 = time.time()
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            res = compare(df.columns, rows, cols, cur.fetchall())
            print(f"{'OK   ' if res is None else 'DIFF '} {name:28s} {len(rows):8d} {took:6.2f}s  sql {time.time() - t0:5.2f}s" + (f"\n   {res}"[:1800] if res else ""))
            bad += res is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:900]}")
        sys.stdout.flush()
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
