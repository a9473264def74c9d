"""Run registered queries and their DuckDB oracles side by side (developer check).

usage: python tools/compare.py [sf_dir] [name-substring ...]
"""
from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from pathweave.session import get_session  # noqa: E402
from pathweave.plans.catalog import ORACLES, QUERIES  # noqa: E402
from pathweave.sources.views import TABLES  # noqa: E402


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in sorted(QUERIES):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sp = QUERIES[name](spark, sf).toPandas()
        except Exception as exc:
            print(f"FAIL-SPARK {name}: {str(exc)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"rows-only  {name}: {len(sp)} rows ({ts:.1f}s)")
            continue
        try:
            t1 = time.time()
            ora = con.sql(ORACLES[name]).df()
            to = time.time() - t1
        except Exception as exc:
            print(f"FAIL-ORACLE {name}: {str(exc)[:800]}")
            bad += 1
            continue
        c1, r1 = canon(sp)
        c2, r2 = canon(ora)
        if c1 != c2:
            print(f"COLS {name}: spark={c1} oracle={c2}")
            bad += 1
        elif r1 != r2:
            diff1 = [r for r in r1 if r not in set(r2)][:3]
            diff2 = [r for r in r2 if r not in set(r1)][:3]
            print(f"MISMATCH {name}: rows {len(r1)} vs {len(r2)}\n  spark-only {diff1}\n  oracle-only {diff2}")
            bad += 1
        else:
            print(f"ok         {name}: {len(r1)} rows (spark {ts:.1f}s, duckdb {to:.1f}s)")
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
