"""What the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def groups_of(texts: list, max_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` (null allowed) of about ``max_chars`` characters, to bound memory."""
    lo = total = 0
    for i, text in enumerate(texts):
        total += len(text or "") + 50
        if total >= max_chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def column(batch: pa.RecordBatch, i: int) -> list:
    return batch.column(i).to_pylist()


_holder: list = ["", None]


def _trim() -> None:
    """Give freed memory back to the system, as far as the allocators can, and let them keep little from now on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        c = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 17), (-1, 1 << 17), (-8, 1)):  # blocks of their own from 128 KB, trimming from there, one arena
            c.mallopt(option, value)
        c.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hold(name: str, release: Callable[[], None] | None = None) -> None:
    """Called by a worker's step before it uses its memo: lets go of the memo of the step before.

    Python workers outlive stages, so without this each operator's table would stay beside the next one's.
    """
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
        _holder[:] = [name, release]
        _trim()


ROWS_A_BATCH = 1000
#: Tasks that a bounded sample of rows is dealt to.
SAMPLE_TASKS = 24


def small_batches(spark: SparkSession) -> None:
    """Lets the session send ``ROWS_A_BATCH`` rows at a time to Python, where it has Spark's default of 10,000.

    Whole documents are large rows: 10,000 of them at once cost each worker and the JVM beside it some 100 MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ROWS_A_BATCH)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut smaller, so that few texts at a time become Python strings."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
