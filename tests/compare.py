"""Run queries and their SQL twins on one folder and compare all values.

python tests/compare.py SF_DIR [NAME...]
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return x.item() if hasattr(x, "item") else x

    columns = [[value(x) for x in df[c].tolist()] for c in sorted(df.columns)]
    return sorted(zip(*columns, strict=True), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for a, b in zip(canonical(got), canonical(want), strict=True):
        if a != b:
            if all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b, strict=True)):
                continue
            return f"{a} / {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '6')}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connection(sys.argv[1])
    bad = 0
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            got = queries[name](spark, sys.argv[1]).toPandas()
            said = difference(got, con.sql(oracles[name]).df()) if name in oracles else f"(rows only: {len(got)})"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("(")
        print(f"{name:28} {time.time() - began:6.1f} s  {said or f'ok {len(got)}'}", flush=True)
    print("bad:", bad)
