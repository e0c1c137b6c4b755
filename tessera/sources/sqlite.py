"""Tables as SQLite databases, a file a task, in a folder that driver and executors share.

A database inside one process can't be asked by another, so in a cluster an embedded one has no rows for the
executors. SQLite's files can be read by any number of processes at once: each task of a write makes one, and a
query is run by every file for its own rows. The folder must be mounted, since SQLite reads no other kind.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.storage import materialise, new_path

KINDS = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "string": "TEXT"}


def write(df: DataFrame, table: str, index: str | None = None) -> DataFrame:
    """(file, rows) of the databases written, with ``df``'s columns as ``table`` and an index on the column ``index``.

    Files are made in a task's own folder and then moved; of a task that runs twice only the committed one is named.
    NaN, which SQLite has no value for, raises an error.
    """
    kinds = [KINDS.get(t) for _, t in df.dtypes]
    if None in kinds:
        raise ValueError(f"columns must be of {sorted(KINDS)}: {df.dtypes}")
    folder = new_path(df.sparkSession, table)
    if not folder.startswith(("file:", "/")):
        raise ValueError(f"{folder} is not a mounted folder")
    folder = folder.removeprefix("file://").removeprefix("file:")
    columns = ", ".join(f'"{c}" {k}' for c, k in zip(df.columns, kinds, strict=True))
    marks = ", ".join("?" * len(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name = f"{uuid.uuid4().hex}.sqlite"
        with tempfile.TemporaryDirectory() as own:
            con, rows = sqlite3.connect(f"{own}/{name}"), 0
            con.execute(f'CREATE TABLE "{table}" ({columns})')
            for batch in batches:
                values = [c.to_pylist() for c in batch.columns]
                if any(isinstance(x, float) and x != x for column in values for x in column):
                    raise ValueError("SQLite has no NaN")
                con.executemany(f'INSERT INTO "{table}" VALUES ({marks})', zip(*values, strict=True))
                rows += batch.num_rows
            if index:
                con.execute(f'CREATE INDEX "by_{index}" ON "{table}" ("{index}")')
            con.commit()
            con.close()
            if rows:
                shutil.move(f"{own}/{name}", f"{folder}/{name}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([rows], pa.int64())], names=["file", "rows"])

    return materialise(df.mapInArrow(run, "file string, rows long"), "databases", few=True)


def read(files: DataFrame, table: str, schema: StructType, conditions: list[str] | None = None) -> DataFrame:
    """The rows of each condition, all by default, of every database of ``write``: a query each, run in parallel.

    Conditions are SQLite's, and must divide the rows: one that fulfils two is read twice.
    """
    asked = files.select("file", F.explode(F.array(*[F.lit(c) for c in conditions or ["1"]])).alias("condition"))
    columns, arrow = ", ".join(f'"{c}"' for c in schema.names), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, condition in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                con = sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)
                found = con.execute(f'SELECT {columns} FROM "{table}" WHERE {condition}')
                while some := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)
                con.close()

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return asked.repartition(tasks, "file", "condition").mapInArrow(run, schema)


def ranges(files: DataFrame, table: str, column: str, parts: int) -> list[str]:
    """Conditions that divide the rows into ``parts`` ranges of a whole-numbered column; nulls are in the first."""
    ends = read(files, table, StructType().add(column, "long")).agg(F.min(column), F.max(column)).first()
    if ends[0] is None or ends[0] == ends[1]:
        return ["1"]
    cuts = sorted({ends[0] + (ends[1] - ends[0]) * k // parts for k in range(1, parts)} - {ends[0]})
    cuts = [None, *cuts, None]
    parts_of = lambda lo, hi: " AND ".join([f'"{column}" >= {lo}'] * (lo is not None) + [f'"{column}" < {hi}'] * (hi is not None)) or "1"
    first, *rest = [parts_of(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    return [f'({first} OR "{column}" IS NULL)', *rest]
