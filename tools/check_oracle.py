"""Compare every registered query with its SQL on DuckDB: rows, column names, values.

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import importlib.util
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def main() -> int:
    from tomeweave.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            rows = df.collect()
        except Exception as error:
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows {name}: {len(rows)} rows {took:.2f}s {df.columns}")
            continue
        start = time.time()
        try:
            cur = con.execute(oracle[name])
            want = cur.fetchall()
        except Exception as error:
            print(f"FAIL {name}: SQL {str(error)[:1500]}")
            bad += 1
            continue
        names = [d[0] for d in cur.description]
        order = sorted(names)
        types = {d[0]: str(d[1]) for d in cur.description}
        if sorted(df.columns) != order:
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {order}")
            bad += 1
            continue
        got = sorted([repr(tuple(plain(r[c]) for c in order)) for r in rows])
        exp = sorted([repr(tuple(plain(r[names.index(c)]) for c in order)) for r in want])
        kinds = {c: t for c, t in df.dtypes}
        pairs = [f"{c}:{kinds[c]}/{types[c]}" for c in order]
        if got != exp:
            bad += 1
            print(f"FAIL {name}: {len(got)} vs {len(exp)} rows")
            for g in [x for x in got if x not in set(exp)][:3]:
                print("   spark ", g[:400])
            for e in [x for x in exp if x not in set(got)][:3]:
                print("   duckdb", e[:400])
        else:
            print(f"ok   {name}: {len(got)} rows {took:.2f}s sql {time.time() - start:.2f}s {' '.join(pairs)}")
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
