"""Run registered queries in Spark and their SQL oracle in DuckDB; compare results.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Comparison: same column names, same row count, and equal multisets of rows
after rounding floats to 6 significant decimals.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from weft.plans.catalog import load_all  # noqa: E402
from weft.session import get_spark  # noqa: E402
from weft.sources.tables import TABLES  # noqa: E402


def norm(v):
    """Canonical value: None for null/NaN (pandas turns null longs into NaN),
    integral floats as ints, other floats rounded to 6 decimals."""
    if hasattr(v, "tolist") and not isinstance(v, (list, tuple)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if v is None or (not isinstance(v, (str, bytes)) and pd.isna(v)):
        return None
    if isinstance(v, float):
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if v.is_integer():
            return int(v)
        return round(v, 6) + 0.0
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    reg = load_all()
    names = a.names or list(reg)
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for n in names:
        q = reg[n]
        t0 = time.time()
        try:
            sp = q.build(spark, a.sf).toPandas()
        except Exception:
            print(f"FAIL {n}: spark error\n{traceback.format_exc()[-3000:]}")
            bad += 1
            continue
        dt = time.time() - t0
        if q.sql is None:
            print(f"rows {n}: {len(sp)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            dd = con.execute(q.sql).df()
        except Exception as e:
            print(f"FAIL {n}: duckdb error {e}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        if c1 != c2:
            print(f"FAIL {n}: columns {c1} vs {c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"FAIL {n}: rows {len(r1)} vs {len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(x, y) for x, y in zip(r1, r2) if x != y][:3]
            print(f"FAIL {n}: values differ, e.g. {diff}")
            bad += 1
        else:
            print(f"ok   {n}: {len(r1)} rows {dt:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
