"""Runs a registered query and its SQL side by side; usable as a script on larger data."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(
        drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = normal(ours), normal(theirs)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"column {c}, {(~same).sum()} rows; {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return None


def main(sf: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.driver.maxResultSize", "4g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            began = time.time()
            ours = run(spark, sf).toPandas()
            took, began = time.time() - began, time.time()
            if name not in oracles:
                print(f"rows  {name}: {len(ours)} ({took:.1f}s)", flush=True)
                continue
            diff = difference(ours, db.execute(oracles[name]).df())
            print(f"{'DIFF ' if diff else 'ok   '} {name}: {len(ours)} rows "
                  f"({took:.1f}s, sql {time.time() - began:.1f}s) {diff or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
