"""Runs a query on Spark and its SQL on DuckDB and compares the rows without regard to order.

    python tests/compare.py SF_DIR [NAME ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_cell(r[i]) for i in order) for r in rows)


SQL_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double"}


def type_difference(df, con, sql: str) -> list:
    """Columns whose types are not the same on both sides."""
    other = {r[0]: SQL_TYPES.get(r[1], r[1]) for r in con.execute("describe " + sql).fetchall()}
    return [(n, t, other.get(n)) for n, t in df.dtypes if other.get(n) != t]


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    types = type_difference(df, con, sql)
    if types:
        return f"types {types}"
    left_names, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right_names, right = _rows(names, cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        a, b = left - right, right - left
        return (f"{sum(left.values())} vs {sum(right.values())} rows; only Spark {sum(a.values())}:"
                f" {list(a)[:2]}; only SQL {sum(b.values())}: {list(b)[:2]}")
    return None


def main() -> int:
    import __spark_entry__ as entry
    from riskloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        sql = entry.oracle_sql().get(name)
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                verdict = f"rows only: {df.count()}"
                wrong = None
            else:
                wrong = difference(df, con, sql)
                verdict = "ok" if wrong is None else f"DIFF {wrong}"
        except Exception as e:  # noqa: BLE001
            wrong = verdict = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += wrong is not None
        print(f"{name:26s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
