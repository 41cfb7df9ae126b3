"""Runs registered queries beside their DuckDB oracles.

``python tests/parity.py <sf_dir> [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# DuckDB type to Spark type name.
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "SMALLINT": "smallint"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows, order) -> Counter:
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v

    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    """(equal, message) for one query: column names, types and rows in any order."""
    df = fn(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want_types = {d[0]: str(d[1]) for d in want.description}
    want_rows = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    got_rows = df.collect()
    types = dict(df.dtypes)
    odd = {n: (types[n], want_types[n]) for n in names if TYPES.get(want_types[n], want_types[n]) != types[n]}
    columns = sorted(names)
    got = _rows(got_rows, [df.columns.index(c) for c in columns])
    exp = _rows(want_rows, [names.index(c) for c in columns])
    if got != exp:
        return False, (
            f"rows {sum(got.values())} against {sum(exp.values())}; only spark {list((got - exp).items())[:2]}; "
            f"only oracle {list((exp - got).items())[:2]} ({columns})"
        )
    if odd:
        return False, f"types differ: {odd}"
    return True, f"{sum(got.values())} rows"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, picked = sys.argv[1], sys.argv[2:]
    spark_session, duck, oracles, failed = session(), connect(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if (picked and name not in picked) or name not in oracles:
            continue
        began = time.time()
        try:
            ok, message = compare(spark_session, duck, sf, query, oracles[name])
        except Exception as e:  # noqa: BLE001  (report and go on)
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {message}", flush=True)
    print("failed:", failed)
