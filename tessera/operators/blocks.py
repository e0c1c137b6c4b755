"""Rows packed into matrix blocks, and sums over them, round after round.

A block is a row of a written table: a binary matrix of features, labels and a key per row. A pass over the
blocks is a matrix product a block; each task adds its blocks up, and a tree of tasks adds up the tasks. Rounds
read the blocks, kept by the executors and behind them in the written table, never the source.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialise

#: Bytes of blocks that a task of a barrier stage may keep; beyond the first ``HELD_BYTES`` they are in a file of its temp folder.
TASK_BYTES, HELD_BYTES = 16 << 30, 64 << 20
#: Blocks that such a task gets at once.
BLOCKS_A_BATCH = 64
#: From so many tasks their sums are added up by other tasks first, not by the driver alone.
TREE = 64

Block = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (blocks, state, round) -> what these blocks add to the round's sum
Part = Callable[[Iterable[Block], np.ndarray, int], np.ndarray]
#: (sum, state, round) -> the next state, or None to stop
Step = Callable[[np.ndarray, np.ndarray, int], np.ndarray | None]


def _decode(batch: pa.RecordBatch, width: int) -> Iterator[Block]:
    for x, y, key in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "key")), strict=True):
        yield np.frombuffer(x).reshape(-1, width), np.frombuffer(y), np.frombuffer(key, np.int64)


class Held:
    """A task's blocks, to be read many times: the first in memory, the rest one at a time from a temporary file."""

    def __init__(self, width: int, most: int):
        self.width, self.room, self.memory, self.filed, self.file = width, most, [], [], None

    def add(self, block: Block) -> None:
        size = sum(a.nbytes for a in block)
        if size <= self.room:
            self.room -= size
            self.memory.append(block)
            return
        self.room = 0  # order is kept: what follows is filed too
        self.file = self.file or tempfile.TemporaryFile(prefix="tessera-")
        for a in block:
            a.tofile(self.file)
        self.filed.append(len(block[1]))

    def __len__(self) -> int:
        return len(self.memory) + len(self.filed)

    def __iter__(self) -> Iterator[Block]:
        yield from self.memory
        if self.file:
            self.file.seek(0)
        for n in self.filed:
            x, y, key = (np.fromfile(self.file, kind, size) for kind, size in ((np.float64, n * self.width), (np.float64, n), (np.int64, n)))
            yield x.reshape(-1, self.width), y, key


@dataclass
class Blocks:
    """A written table of blocks, ``width`` features wide."""

    table: DataFrame
    width: int
    rows: int
    keep: bool = True

    def __post_init__(self) -> None:
        width = self.width
        kept = self.table.select("x", "y", "key").rdd.map(lambda r: (np.frombuffer(r[0]).reshape(-1, width), np.frombuffer(r[1]), np.frombuffer(r[2], np.int64)))
        # what memory can't hold goes to the executors' disks; what an executor loses is read from the table again
        self.kept = kept.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else kept

    def discard(self) -> None:
        self.kept.unpersist()
        discard(self.table)

    def total(self, part: Part, state: np.ndarray, k: int = 0) -> np.ndarray | None:
        """The sum of ``part`` over all blocks: added up in each task, then by a tree of tasks; None without rows."""
        now = self.kept.context.broadcast(state)

        def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
            out = None
            for block in blocks:  # one at a time
                one = part([block], now.value, k)
                out = one if out is None else out + one
            return iter([] if out is None else [out])

        sums = self.kept.mapPartitions(run)
        add = lambda a, b: b if a is None else a if b is None else a + b
        out = sums.treeAggregate(None, add, add, 2) if sums.getNumPartitions() > TREE else sums.fold(None, add)
        now.destroy()
        return out

    def iterate(self, part: Part, step: Step, state: np.ndarray, rounds: int) -> np.ndarray:
        """The state after ``rounds`` rounds of ``part`` and ``step``, or when ``step`` stops; a job a round."""
        for k in range(rounds if self.rows else 0):
            ahead = step(self.total(part, state, k), state, k)
            if ahead is None:
                break
            state = ahead
        return state

    def in_one_stage(self, part: Part, step: Step, state: np.ndarray, rounds: int, tasks: int | None = None) -> np.ndarray:
        """The same by one barrier stage of ``tasks`` tasks (default: the cores), where ``part`` gets all blocks of its task.

        The tasks exchange their parts by ``allGather``, which takes Spark a second: for few rounds of much work.
        Each task keeps its blocks, ``HELD_BYTES`` of them in memory and the rest in a temporary file; more than ``TASK_BYTES``
        a task raise an error, and so does a session that allocates executors dynamically, which Spark allows no barrier.
        """
        context, width, most = self.kept.context, self.width, HELD_BYTES
        tasks = tasks or context.defaultParallelism
        if self.rows * (width + 2) * 8 > tasks * TASK_BYTES:
            raise ValueError(f"{self.rows} rows of {width} features need more than {tasks} tasks of {TASK_BYTES} bytes")
        if not self.rows:
            return state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import BarrierTaskContext

            own = Held(width, most)
            for batch in batches:
                for block in _decode(batch, width):
                    own.add(block)
            task, now = BarrierTaskContext.get(), state
            for k in range(rounds):
                mine = base64.b64encode(part(own, now, k).tobytes()).decode() if own else ""
                # in the order of the tasks, so that all of them get the same sum
                found = [np.frombuffer(base64.b64decode(m)) for m in task.allGather(mine) if m]
                ahead = step(np.sum(found, axis=0), now, k)
                if ahead is None:
                    break
                now = ahead
            if task.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([now.tolist()], pa.list_(pa.float64()))], names=["state"])

        conf, name = self.table.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        conf.set(name, str(BLOCKS_A_BATCH))  # a row is a block
        try:
            # no first() or limit may follow a barrier; the result is one row
            return np.array(self.dealt(tasks).select("x", "y", "key").mapInArrow(run, "state array<double>", barrier=True).collect()[0]["state"])
        finally:
            conf.set(name, before)

    def dealt(self, tasks: int) -> DataFrame:
        """The blocks in shares by a hash of their numbers, so that each run has the same, each in the numbers' order."""
        return self.table.repartition(tasks, "number").sortWithinPartitions("number")


def pack(df: DataFrame, features: Column, label: Column, key: Column | None = None, rows_a_block: int = 4096, written: bool = True) -> Blocks:
    """Blocks of rows: ``features`` array<double>, ``label`` double, ``key`` long (default: a hash of features and label).

    A row with a null among its features, label or key is left out. All rows must have the same number of
    features; another number raises an error. Blocks that are not ``written`` are made anew by each pass, for a few passes over
    many rows; these aren't counted.
    """
    key = F.xxhash64(features, label) if key is None else key
    rows = df.select(features.cast("array<double>").alias("f"), label.cast("double").alias("y"), key.cast("long").alias("k"))
    rows = rows.where("f IS NOT NULL AND y IS NOT NULL AND k IS NOT NULL AND NOT exists(f, x -> x IS NULL)")
    first = rows.first()
    width = len(first["f"]) if first else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_a_block):
                part = batch.slice(lo, rows_a_block)
                lists = part.column(0)
                x = np.asarray(lists.flatten(), float)
                if len(x) != part.num_rows * width:
                    raise ValueError(f"every row must have {width} features")
                y, k = np.asarray(part.column(1), float), np.asarray(part.column(2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (x, y, k))], names=["n", "x", "y", "key"])

    packed = rows.mapInArrow(run, "n long, x binary, y binary, key binary").withColumn("number", F.monotonically_increasing_id())
    if not written:
        return Blocks(packed, width, -1, keep=False)
    table = materialise(packed, "blocks")
    return Blocks(table, width, int(table.agg(F.sum("n")).first()[0] or 0))
