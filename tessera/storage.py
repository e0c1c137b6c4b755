"""Table loading and fault-tolerant intermediates.

Intermediates are Parquet tables in the folder named by ``spark.checkpoint.dir``: unlike cached
blocks they outlive an executor, and unlike a recomputed lineage they are read, not redone.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_local_root: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a single-process master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _local_root[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def _fewer_tasks(df: DataFrame, few: bool) -> DataFrame:
    """``df`` in fewer partitions, where it has more than the cores and its size call for.

    Each file costs a listing, a footer and, in some file systems, a process; tables of thousands of tiny
    files are slower to write and to read than the same rows in a few. ``few``: the rows are known to be
    light, so a few tasks a core are enough; else a task is left 64 MB of the plan's estimate.
    """
    n = 4 * max(1, df.sparkSession.sparkContext.defaultParallelism)
    if not few:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        n = max(n, min(1 << 30, size >> 26))
    return df.coalesce(n)


_stage = threading.local()


@contextlib.contextmanager
def stage_tables(docs: DataFrame, stage: str) -> Iterator[None]:
    """Tables written inside belong to a stage of this thread.

    The next stage deletes those of the stage before that its own input doesn't read: by contract that
    stage's result has been written by then. A result that wasn't is among the files that ``docs`` reads.
    """
    read = None
    for path, owner in list(getattr(_stage, "tables", {}).items()):
        if read is None:
            read = docs.inputFiles()
        if owner != stage and not any(path.split("://")[-1] in f for f in read):
            _delete(docs.sparkSession, path)
    _stage.name, before = stage, getattr(_stage, "name", None)
    try:
        yield
    finally:
        _stage.name = before


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A handle on what operators write: tables that this thread writes inside are deleted when the block ends.

    Lazy results read such tables, so they must be written or collected inside. Gives the paths so far; blocks
    may be nested, and a table that an operator has deleted itself is no error.
    """
    paths: list[str] = []
    before = getattr(_open, "lists", ())
    _open.lists = (*before, paths)
    try:
        yield paths
    finally:
        _open.lists = before
        for path in paths:
            _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder; a ``scratch`` block around the call owns it."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_open, "lists", ()):
        paths.append(path)
    return path


def materialise(df: DataFrame, name: str, codec: str = "zstd", few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written; ``few``: as few files as cores need."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _fewer_tasks(df, few).write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    if getattr(_stage, "name", None):
        _stage.tables = {**getattr(_stage, "tables", {}), path: _stage.name}
    return back


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    getattr(_stage, "tables", {}).pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialise`` returned, once nothing reads it."""
    path = getattr(df, "_tessera_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's rows as a frame, by Arrow: no Python worker starts to read them."""
    kinds = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    fields = to_arrow_schema(kinds)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
    return spark.createDataFrame(table, kinds)
