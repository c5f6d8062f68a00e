"""Run registered queries against their DuckDB SQL: python tests/oracle_check.py SF [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty string if equal, else a description of the difference."""
    rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    got, want = table(spark_df.columns, rows), table(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}; {got[1][:2]} vs {want[1][:2]}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(diff)} of {len(rows)} rows differ, first {str(diff[0])[:600]}" if diff else ""


def main():
    from __spark_entry__ import oracle_sql, queries

    from tablescope.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, todo, sqls = duck(sf_dir), queries(), oracle_sql()
    bad = []
    for name, fn in todo.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                built = time.time()
                note = compare(df, con, sqls[name])
                note = note or f"ok ({built - start:.1f}s build)"
                if not note.startswith("ok"):
                    bad.append(name)
            else:
                note = f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            note = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
            bad.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
