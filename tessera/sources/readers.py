"""Readers: explicit schemas, sentinels as null, small files, optional formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False, sep: str = ",", null: str | None = None, drop_malformed: bool = False) -> DataFrame:
    """Delimited text, plain or gzipped, under a declared schema; rows that don't fit become nulls or are dropped."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    return (reader.option("nullValue", null) if null is not None else reader).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A header and inferred types; names lose white space around them and dots."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*[c.strip().replace(".", "") for c in df.columns])


def read_positional(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Text columns by position; casts are the caller's, and explicit."""
    return read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]), sep=sep)


def numeric_schema(columns: int, label: str | None = "label", label_first: bool = True, prefix: str = "feature_") -> T.StructType:
    names = [f"{prefix}{i}" for i in range(columns)]
    if label:
        names = [label, *names] if label_first else [*names, label]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(filename, content, checksum, size): files as rows, found recursively by a name pattern.

    Spark's file sources pass over files of no bytes, so those have no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return files.select(F.col("path").alias("filename"), "content", F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro by the session's own data source, or where it has none by this package's reader."""
    from pyspark.errors import AnalysisException

    from tessera.sources import avro

    try:
        return spark.read.format("avro").load(path)
    except AnalysisException as e:
        if "avro" not in str(e).lower() or "path_not_found" in str(e).lower():
            raise
        return avro.read(spark, path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 8, where: str | None = None, **options: str) -> DataFrame:
    """A database's table or query over JDBC; filters and columns that follow are left to the database.

    ``column``: a numeric, date or timestamp column by whose range rows are read in ``partitions`` parallel
    queries; its bounds are asked for first, one row. Rows with a null there are in the first part. An empty
    table, or one whose column has one value, is one query. ``where`` is a condition for the database.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) part" if where else table
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("dbtable", source).load()
    ends = reader.option("dbtable", f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source}) ends").load().first()
    if ends[0] is None or ends[0] == ends[1]:
        return spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", source).load()
    # a stride is (hi - lo) / partitions: the last part is open, so that it has the largest value as well
    parts = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", source).option("partitionColumn", column)
    return parts.option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).option("numPartitions", partitions).load()


def read_jdbc_parts(spark: SparkSession, url: str, table: str, conditions: list[str], **options: str) -> DataFrame:
    """The rows of each condition by a query of its own, in parallel: for tables without an even column.

    Conditions must divide the table: a row that fulfils two is read twice, one that fulfils none isn't read.
    """
    return spark.read.jdbc(url, table, predicates=conditions, properties=options)


def read_merged(spark: SparkSession, paths: list[str], skip_unreadable: bool = True) -> DataFrame:
    """Parquet files as one table: the first file's columns, missing ones null, unreadable files skipped."""
    from pyspark.errors import PySparkException

    out, skipped = None, []
    for p in paths:
        try:
            df = spark.read.option("ignoreCorruptFiles", skip_unreadable).parquet(p)
        except PySparkException:
            if not skip_unreadable:
                raise
            skipped.append(p)
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True).select(*out.columns)
    if out is None:
        raise FileNotFoundError(f"none of {len(paths)} files can be read: {skipped[:3]}")
    return out


def people(spark: SparkSession, rows: int, ids: int, seed: int = 42) -> DataFrame:
    """Synthetic (name, student_id, grade 0..100); an id repeats when rows exceed ids."""
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    pick = lambda k: F.element_at(letters, (F.pmod(F.xxhash64(F.col("id"), F.lit(seed + k)), F.lit(26)) + 1).cast("int"))
    return spark.range(rows).select(
        F.initcap(F.concat(*[pick(k) for k in range(6)])).alias("name"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 50)), F.lit(ids)).alias("student_id"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 60)), F.lit(101)).cast("int").alias("grade"),
    )
