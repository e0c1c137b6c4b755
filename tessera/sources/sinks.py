"""Writers: tables, single files, packed small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, single: bool = True) -> None:
    """JSON lines; one file only where the result is known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_key_values(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).csv(path)


def create_table_as(spark: SparkSession, name: str, df: DataFrame, fmt: str = "parquet", path: str | None = None) -> None:
    """A table of the session's catalogue from a query, in its warehouse or at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def insert_into(df: DataFrame, table: str) -> None:
    df.write.insertInto(table)


def pack_files(files: DataFrame, path: str) -> None:
    """Files as rows (filename, content, checksum), compressed; bytes are kept exactly."""
    files.select("filename", "content", F.sha2("content", 256).alias("checksum")).write.mode("overwrite").option("compression", "snappy").parquet(path)


def verified(packed: DataFrame) -> DataFrame:
    """Packed rows whose content matches the checksum; any other raises when it is read."""
    ok = F.sha2("content", 256) == F.col("checksum")
    wrong = F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("filename"))).cast("binary")
    return packed.select("filename", F.when(ok, F.col("content")).otherwise(wrong).alias("content"), "checksum")


def unpack_files(packed: DataFrame, folder: str, root: str = "") -> int:
    """Write each verified row as a file below a folder that all executors share; returns how many.

    Names keep their folders, less ``root`` and a scheme in front of them. A name that leaves the folder, or
    that two rows share, raises before anything is written.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("files can be written to a mounted folder only")
    folder = folder.removeprefix("file://")
    bare = F.regexp_replace("filename", "^[a-z0-9]+:(//)?", "")
    start = F.lit(root.split(":", 1)[-1].replace("///", "/").rstrip("/") if root else "")
    bare = F.when((F.length(start) > 0) & F.startswith(bare, start), F.substring(bare, F.length(start) + 1, F.length(bare))).otherwise(bare)
    named = verified(packed).withColumn("target", F.regexp_replace(bare, "^/+", ""))
    outside = named.where(F.col("target").rlike(r"(^|/)\.\.?(/|$)") | (F.col("target") == "")).select("filename").first()
    if outside:
        raise ValueError(f"{outside[0]!r} isn't a name below the folder")
    twice = named.groupBy("target").count().where("count > 1").first()
    if twice:
        raise ValueError(f"{twice['target']!r} is the name of several files")

    def write(batches):
        import os
        import uuid

        import pandas as pd

        for b in batches:
            for name, content in zip(b["target"], b["content"], strict=True):
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pd.DataFrame({"n": [len(b)]})

    return named.select("target", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20, group_pattern: str | None = None) -> None:
    """Rewrite a table of many small files as files near a target size, optionally one group a path pattern.

    A group of more than ``target_bytes`` is dealt to as many tasks and files as it is times larger.
    """
    df = spark.read.option("recursiveFileLookup", True).parquet(source)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source)
    group = lambda path: F.regexp_extract(path, group_pattern, 1)
    if not group_pattern:
        total = files.agg(F.sum("length")).first()[0] or 1
        df.repartition(max(1, -(-total // target_bytes))).write.mode("overwrite").parquet(target)
        return
    sizes = files.groupBy(group(F.col("path")).alias("file_group")).agg(F.ceil(F.sum("length") / target_bytes).alias("parts"))
    rows = df.withColumn("file_group", group(F.input_file_name())).join(sizes, "file_group")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("parts")))
    parts = sizes.agg(F.sum("parts")).first()[0] or 1
    rows.repartition(int(parts), "file_group", "part").drop("parts", "part").write.mode("overwrite").partitionBy("file_group").parquet(target)
