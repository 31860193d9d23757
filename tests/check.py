"""Run the named queries and their SQL side by side: ``python tests/check.py SF_DIR [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from ghgspark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as comparable tuples, columns by name, in sorted order."""

    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return ""
        if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(round(float(value), 6))
        return str(value)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            found = query(spark, sf_dir).toPandas()
            took, started = time.time() - started, time.time()
            problem = compare(found, connection.execute(oracles[name]).df()) if name in oracles else "no SQL"
        except Exception as exc:  # noqa: BLE001
            problem, took, found = f"FAILED {str(exc)[:600]}", time.time() - started, []
        bad += problem not in ("", "no SQL")
        print(f"{name:26s} {len(found):7d} {took:6.2f}s {time.time() - started:6.2f}s {problem[:900] or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
