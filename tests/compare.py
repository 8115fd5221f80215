"""Run registered queries against their SQL twins: ``python tests/compare.py <sf> [names]``."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, connection, build, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree on columns, types that matter and all values."""
    df = build(spark, sf_dir)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} <> {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{sorted(names)}: {mine!r:.400} <> {theirs!r:.400}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from quirefold.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    session = build_session("compare", "local[8]", 8)
    database = open_oracle(sf_dir)
    oracle, registered = oracle_sql(), queries()
    print("without oracle:", sorted(set(registered) - set(oracle)), "unknown:", sorted(set(oracle) - set(registered)))
    failed = 0
    for key in sys.argv[2:] or list(registered):
        began = time.time()
        try:
            found = difference(session, database, registered[key], oracle[key], sf_dir)
        except Exception as error:  # report and go on
            found = f"error {error!s:.1200}"
        failed += found is not None
        print(f"{key:26s} {time.time() - began:6.2f} {'ok' if found is None else found}", flush=True)
    print("failed:", failed)
