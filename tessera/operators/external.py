"""External programs as mappers and reducers: lines in, lines out."""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _run(command: list[str], lines: Iterable[str]) -> Iterator[str]:
    """The program's output, while its input is written beside; a status that isn't 0 raises."""
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as program:
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                with program.stdin as out:
                    for line in lines:
                        out.write(line.encode() + b"\n")
            except BrokenPipeError:  # the program has read enough
                pass
            except BaseException as e:  # noqa: BLE001
                failed.append(e)

        writer = threading.Thread(target=feed, daemon=True)
        writer.start()
        for line in program.stdout:
            yield line.removesuffix(b"\n").decode()
        writer.join()
        if failed:
            raise failed[0]
        if program.wait():
            raise RuntimeError(f"{command[0]} ended with status {program.returncode}")


def pipe(df: DataFrame, command: list[str], column: str = "line") -> DataFrame:
    """(line): each partition's lines sent through one run of ``command``, in their order. Null lines are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in batch.column(0).to_pylist())
        block: list[str] = []
        for line in _run(command, lines):
            block.append(line)
            if len(block) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(block)], names=["line"])
                block = []
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.string())], names=["line"])

    return df.select(F.col(column).alias("line")).where("line is not null").mapInArrow(run, "line string")


def map_reduce(df: DataFrame, mapper: list[str], reducer: list[str], column: str = "line", sep: str = "\t") -> DataFrame:
    """(key, value) that ``reducer`` writes for the lines of ``mapper``, which it gets dealt and sorted by key.

    A key's lines go to one run of the reducer, as that program expects.
    """
    key = F.substring_index("line", sep, 1)
    dealt = pipe(df, mapper, column).withColumn("key", key).repartition("key").sortWithinPartitions("key", "line")
    out = pipe(dealt, reducer)
    return out.select(key.alias("key"), F.substring(F.col("line"), F.length(key) + 1 + len(sep), F.length("line")).alias("value"))
