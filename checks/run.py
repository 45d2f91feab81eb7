"""Run registered queries next to their SQL and compare the rows.

    python -m checks.run [sf_dir] [key prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from checks import all_checks
from lectern.session import build_session
from lectern.sources.star_views import STAR_TABLES


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def bag(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, key: str) -> tuple[str, int]:
    one = all_checks()[key]
    df = one.run(spark, sf_dir)
    rows = df.collect()
    if one.sql is None:
        return "no sql", len(rows)
    found = con.execute(one.sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}", len(rows)
    mine, theirs = bag(rows, df.columns), bag(found.fetchall(), names)
    if mine == theirs:
        return "ok", len(rows)
    return (
        f"rows differ: {sum(mine.values())} vs {sum(theirs.values())};"
        f" only spark {list((mine - theirs).items())[:2]}; only sql {list((theirs - mine).items())[:2]};"
        f" columns {sorted(names)}",
        len(rows),
    )


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(
        "checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key in all_checks():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, key)
        except Exception as error:
            verdict, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        bad += verdict not in ("ok", "no sql")
        print(f"{key:32s} {n:7d} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
