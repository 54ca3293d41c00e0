"""Run registered queries and their SQL side by side.

``python -m tools.compare [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from promptweave.session import local_session
from workload.oracles import ORACLES
from workload.queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> list[str]:
    """Reasons why the two results of a query are not the same; none if they are."""
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows"]
    ours, theirs = _sorted(ours), _sorted(theirs)
    found = []
    for c in ours.columns:
        kinds = ours[c].dtype.kind, theirs[c].dtype.kind
        if kinds[0] != kinds[1]:
            found.append(f"{c}: types {ours[c].dtype} and {theirs[c].dtype}")
        unequal = ~((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna()))
        if unequal.any():
            row = unequal.idxmax()
            found.append(f"{c}: {unequal.sum()} values, as {ours[c][row]!r} and {theirs[c][row]!r}")
    return found


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ORACLES)
    spark = local_session("compare", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in names:
        start = time.perf_counter()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.perf_counter() - start:.1f}s", *found, flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
