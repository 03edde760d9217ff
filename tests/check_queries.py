"""Run registered queries against their SQL twins: ``python tests/check_queries.py [prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from plumbline.plans.registry import TABLES  # noqa: E402
from plumbline.session import build_session  # noqa: E402


def norm(value):
    if isinstance(value, float):
        return f"{value:.9g}" if value == value else "nan"
    return str(value)


def compare(spark, con, name, sf):
    """None when equal, else a description of the difference."""
    df = entry.queries()[name](spark, sf)
    got = df.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    rel = con.sql(sql)
    want, columns = rel.fetchall(), list(rel.columns)
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}", len(got)
    order = [columns.index(c) for c in sorted(columns)]
    rows = df.select(*sorted(columns)).collect()
    left = sorted(tuple(norm(v) for v in r) for r in rows)
    right = sorted(tuple(norm(r[i]) for i in order) for r in want)
    if left != right:
        extra = [r for r in left if r not in set(right)][:3]
        lack = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} vs {len(right)} rows; spark only {extra}; sql only {lack}", len(got)
    return None, len(got)


def main(prefixes):
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    failed = []
    for name in entry.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, sf)
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        kind = "oracle" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} {kind} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
