"""Runs catalog queries next to their SQL and compares names, types and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


seconds: dict[str, tuple[float, float]] = {}
_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, run, sql: str, folder: str) -> str:
    """'' when equal, else what differs."""
    start = time.time()
    df = run(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    seconds[name] = (middle - start, time.time() - middle)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    odd = {c: (t, types[c]) for c, t in df.dtypes if _SAME.get(t) != types[c]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not want:
        return "no rows at all"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(sorted(df.columns), g, w) if a != b]
            return f"first difference {bad[:3]} in {str(g)[:300]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from ledgerloom.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    wanted = sys.argv[1:]
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in sql:
                verdict = compare(spark, con, name, run, sql[name], folder) or "ok"
            else:
                verdict = f"rows only: {run(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001 - the loop reports and goes on
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {verdict} [{time.time() - t:.1f}s, spark/sql {seconds.get(name)}]", flush=True)


if __name__ == "__main__":
    main()
