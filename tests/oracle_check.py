"""Spark vs DuckDB comparison for registered computations.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark_pdf, duck_pdf):
    sc = sorted(spark_pdf.columns)
    dc = sorted(duck_pdf.columns)
    if sc != dc:
        return f"columns differ: spark={sc} duck={dc}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows differ: spark={len(spark_pdf)} duck={len(duck_pdf)}"
    a = sorted((tuple(_norm(r[c]) for c in sc) for _, r in spark_pdf.iterrows()), key=repr)
    b = sorted((tuple(_norm(r[c]) for c in sc) for _, r in duck_pdf.iterrows()), key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"value mismatch cols={sc}\n spark={x}\n duck ={y}"
    return None


def main(argv):
    sf = "/root/testdata/sf0.01"
    pats = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            pats.append(a)
    from cohortspark.session import get_spark
    import __spark_entry__ as E
    spark = get_spark()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sp = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(sp)} rows ({t1 - t0:.1f}s)")
            continue
        try:
            dk = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(sp, dk)
        if msg:
            bad += 1
            print(f"FAIL {name}: {msg}")
        else:
            print(f"OK   {name}: {len(sp)} rows ({t1 - t0:.1f}s)")
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
