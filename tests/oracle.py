"""Compare the registered queries with their SQL, as sets of rows."""

from __future__ import annotations

import datetime
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: str(r)
    )


SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE",
    "double": "DOUBLE", "boolean": "BOOLEAN",
}


def mismatch(df, con, sql: str) -> str | None:
    """None when result and SQL agree, else what differs."""
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want_types = {c[0]: str(c[1]) for c in result.description}
    want = _rows(want_columns, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    types = {
        c: (SPARK_TO_DUCK.get(t, t), want_types[c])
        for c, t in df.dtypes
        if SPARK_TO_DUCK.get(t, t) != want_types[c]
    }
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for mine, other in zip(got, want):
        if mine != other:
            return f"{str(mine)[:700]}\n != {str(other)[:700]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from lexsnap.session import build_session

    directory = sys.argv[1]
    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    sqls = entry.oracle_sql()
    for name in sys.argv[2:] or entry.queries():
        started = time.time()
        try:
            df = entry.queries()[name](spark, directory)
            if name in sqls:
                state = mismatch(df, con, sqls[name]) or "ok"
            else:
                state = f"no SQL, {df.count()} rows"
        except Exception as error:
            state = f"FAILED {str(error)[:1200]}"
        print(f"{name:26s} {time.time() - started:6.2f}s {state}", flush=True)
