"""Comparison of Spark and DuckDB results."""

import os

import duckdb
import pandas as pd

TESTDATA = "/root/testdata"


def duckdb_over(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def comparable(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(value) -> str:
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "NULL"
        return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(text(value) for value in row) for row in ordered.itertuples(index=False))
