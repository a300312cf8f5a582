"""Run catalogue queries next to their SQL and report the differences.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def _table(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    start = time.time()
    df = fn(spark, folder)
    got = _table(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"ROWS {name}: {len(got[1])} rows, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = _table(names, rel.fetchall())
    sql_took = time.time() - start
    if got == want:
        return f"SAME {name}: {len(got[1])} rows, {took:.1f}s, sql {sql_took:.1f}s"
    if got[0] != want[0]:
        return f"DIFF {name}: columns {got[0]} vs {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    lost = [r for r in want[1] if r not in set(got[1])][:2]
    return f"DIFF {name}: {len(got[1])} vs {len(want[1])} rows\n   engine only {str(extra)[:700]}\n   sql only    {str(lost)[:700]}"


def main() -> None:
    import __spark_entry__ as entry
    from attesta.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            line = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001
            line = f"FAIL {name}: {type(exc).__name__} {str(exc)[:600]}"
        print("\n" + line, flush=True)


if __name__ == "__main__":
    main()
