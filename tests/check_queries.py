"""Run registered queries against their check SQL: python tests/check_queries.py [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: "NULL" if v is None or v != v else (f"{v:.9g}" if isinstance(v, float) else str(v))
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    if sql is None:
        return len(got) >= 0, f"{len(got)} rows, not compared"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = canonical(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return False, f"{len(got)} vs {len(want)} rows, first difference {str(diff[:1])[:700]}"
    return True, f"{len(got)} rows"


def main(names: list[str], sf_dir: str) -> int:
    import __spark_entry__ as entry
    from msgspark.session import get_spark

    spark = get_spark(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or sorted(queries):
        t = time.time()
        try:
            ok, note = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) else 0)
