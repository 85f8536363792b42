"""Runs registered queries and compares them with their SQL on DuckDB: check_queries.py [pattern] [sf]."""
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from ionweave.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if not isinstance(v, str) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return ("rows" if got else "EMPTY"), len(got), took, ""
    t2 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t2
    if sorted(cols) != sorted(df.columns):
        return "COLS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return ("ok" if a else "EMPTY"), len(a), took, f"sql {sql_took:.1f}s" if sql_took > 3 else ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return "DIFF", len(a), took, f"want {len(b)} cols {sorted(cols)}\n   only spark {list(sa - sb)[:3]}\n   only sql {list(sb - sa)[:3]}"


def main(pattern=".", sf="sf0.01"):
    spark = build_session(master="local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    bad = []
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        try:
            verdict, n, took, note = compare(spark, con, name, fn, entry.oracle_sql().get(name), path)
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, n, took, note = "ERROR", 0, 0.0, str(e)[:700]
        if verdict not in ("ok", "rows"):
            bad.append(name)
        print(f"{verdict:6s} {name:34s} rows={n:<8d} {took:6.2f}s {note}", flush=True)
        spark.catalog.clearCache()
    print("BAD:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
