"""Run queries next to their SQL and report rows, columns and values that differ.

    python -m checks.compare [sf_dir] [query ...]
"""

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks import oracle
from wearline import catalog
from wearline.session import build_session
from wearline.sources.fixtures import DRIVER_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _text(value: object) -> str:
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        try:
            return repr(float(value) + 0.0)
        except (TypeError, ValueError):
            return str(value)
    return str(value)


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    texts = pd.DataFrame({c: [_text(v) for v in frame[c]] for c in frame.columns})
    return texts.sort_values(list(texts.columns), ignore_index=True)


def difference(actual: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both sides agree."""
    left, right = canonical(actual.toPandas()), canonical(con.execute(sql).df())
    if list(left.columns) != list(right.columns):
        return f"columns {set(left.columns) ^ set(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows, expected {len(right)}"
    for column in left.columns:
        wrong = left[column] != right[column]
        if wrong.any():
            pairs = list(zip(left[column][wrong].head(3), right[column][wrong].head(3)))
            return f"{column}: {int(wrong.sum())} of {len(left)} differ, e.g. {pairs}"
    return ""


def main(sf_dir: str, wanted: list[str], spark: SparkSession | None = None) -> int:
    spark = spark or build_session("local[8]", **{"spark.driver.memory": "16g", "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, statements, failures = connect(sf_dir), oracle.statements(), 0
    for name, run in catalog.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            result = run(spark, sf_dir)
            if name in statements:
                verdict = difference(result, con, statements[name])
            else:
                verdict = "" if result.count() else "no rows"
        except Exception as error:  # the report goes on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(verdict)
        kind = "" if name in statements else " (rows only)"
        print(f"{'FAIL' if verdict else 'ok  '} {name}{kind} {time.time() - began:.1f}s {verdict}", flush=True)
    missing = set(statements) - set(catalog.queries())
    print(f"{failures} failures; statements without a query: {sorted(missing)}")
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(bool(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:])))
