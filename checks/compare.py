"""Run every query in Spark and its SQL in DuckDB and compare: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.catalog import ORACLES, QUERIES
from trafficloom import build_session


def _rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    plain = ordered.astype(object).where(ordered.notna(), None)
    return sorted((tuple(repr(v) for v in row) for row in plain.itertuples(index=False, name=None)))


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    failed = []
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows {took:.2f}s")
                continue
            want = duck.execute(ORACLES[name]).df()
            same = _rows(got) == _rows(want) and sorted(got.columns) == sorted(want.columns)
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:600]}")
            failed.append(name)
            continue
        types = [c for c in got.columns if c in want.columns and str(got[c].dtype) != str(want[c].dtype)]
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(got)}/{len(want)} rows {took:.2f}s {types or ''}")
        if not same:
            failed.append(name)
            a, b = _rows(got), _rows(want)
            print("   columns", sorted(got.columns), sorted(want.columns))
            print("   only spark", sorted(set(a) - set(b))[:3])
            print("   only sql  ", sorted(set(b) - set(a))[:3])
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
