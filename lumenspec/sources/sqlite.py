"""Small vendor tables in SQLite."""

from __future__ import annotations

import sqlite3
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row numbers of a table that a task reads at a time.
ROWS = 100_000


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def tables(file: str) -> set[str]:
    """The names of the tables that a file holds."""
    db = _open(file)
    try:
        return {name for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    finally:
        db.close()


def read(spark: SparkSession, file: str, name: str, schema: str) -> DataFrame:
    """A table's columns (a DDL schema with their names), read in tasks by ranges of row numbers; executors must see the file."""
    db = _open(file)
    try:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
    finally:
        db.close()
    if low is None:
        return spark.createDataFrame([], schema)
    columns = [c.split()[0] for c in schema.split(", ")]
    wanted = ", ".join(f'"{c}"' for c in columns)
    step = ROWS

    def run(batches):
        db = _open(file)
        try:
            for batch in batches:
                for start in batch["id"]:
                    rows = db.execute(f'SELECT {wanted} FROM "{name}" WHERE rowid >= ? AND rowid < ?', (int(start), int(start) + step)).fetchall()
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
        finally:
            db.close()

    parts = -(-(high + 1 - low) // step)
    return spark.range(low, high + 1, step, numPartitions=min(parts, 10_000)).select(F.col("id")).mapInPandas(run, schema)


def table(spark: SparkSession, file: str, query: str, schema: str) -> DataFrame | None:
    """A vendor's side table, or none if the file lacks it; they are small and read at the driver."""
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        try:
            rows = db.execute(query).fetchall()
        except sqlite3.OperationalError:
            return None
    return spark.createDataFrame(rows, schema)


def global_metadata(folder: str) -> dict[str, str] | None:
    """Key and value pairs of a run; the line file goes before the frame file; none if empty."""
    for name in ("analysis.tsf", "analysis.tdf"):
        if (Path(folder) / name).exists():
            with sqlite3.connect(f"file:{Path(folder) / name}?mode=ro", uri=True) as db:
                found = dict(db.execute("SELECT Key, Value FROM GlobalMetadata"))
            return found or None
    return None
