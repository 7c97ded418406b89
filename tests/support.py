"""Comparison of a query's rows with those of DuckDB on the same tables."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if value != value:
            return None
        return int(value) if abs(value) < 1e15 and value == int(value) else round(value, 8)
    return value.tolist() if hasattr(value, "tolist") else value


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in row]) for row in frame.astype(object).itertuples(index=False))


def same_rows(found, expected) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)
